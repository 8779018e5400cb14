from devicelode.session import spread


def test_rows_are_spread_by_shuffle_partitions_where_few_cores_are_known(spark):
    """An executor that has not registered yet is not among the cores."""
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        few, enough = spark.range(0, 600, 1, cores), spark.range(0, 600, 1, 3 * cores)
        wide = spread(few)
        assert wide.rdd.getNumPartitions() == 3 * cores
        assert sorted(r["id"] for r in wide.collect()) == list(range(600))
        assert spread(enough) is enough
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
