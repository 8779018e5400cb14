"""Shared pieces: tables written to the shared folder, ranks without hot tasks, components of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from devicelode.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, with Arrow batches of at most 8 MB in its session: a batch is by default cut by rows alone, however long they are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > 8 << 20:
        conf.set(name, str(8 << 20))
    return df


def saved(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut and lost executors cost only reads.

    With ``clean`` the shuffle files of the write go with its end and not when the driver next collects garbage.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(setting)
    try:
        if clean:
            spark.conf.set(setting, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z and of nothing else."""
    return F.translate(text, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed() -> Column:
    """A random-like number per row, to be saved with the row; equal rows get different ones."""
    return F.xxhash64(F.monotonically_increasing_id())


def ranked(df: DataFrame, key: str, order: list[Column], counts: dict, name: str) -> DataFrame:
    """Adds ``name``: the rows of each key numbered from 0 without gaps.

    ``df`` must be a saved table with the column ``_mix``. ``counts`` gives the rows per key, of which there must be a
    bounded number. A key's rows are dealt by ``_mix`` into chunks of at most half a mean shuffle partition, numbered
    inside the chunk, and shifted by the rows of the chunks before; so a key holding all rows is still many tasks.
    """
    spark = df.sparkSession
    total = max(1, sum(counts.values()))
    parts = 2 * shuffle_parts(spark)
    schema = T.StructType([df.schema[key], T.StructField("_chunks", T.LongType())])
    chunks = spark.createDataFrame([(k, 1 + n * parts // total) for k, n in counts.items()], schema)
    rows = df.join(F.broadcast(chunks), key).withColumn("_chunk", F.pmod("_mix", "_chunks")).drop("_chunks")
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    return (rows.join(starts, [key, "_chunk"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_chunk", "_start"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, root) per linked node, ``root`` the smallest node reachable.

    Every round the nodes of one root take the smallest root among all their neighbours, then the root of that root, so a
    chain of roots is halved per round. Each round is a saved table; only whether a root changed reaches the driver.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")), name)
    while True:
        offers = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        hooked = saved(roots.join(offers, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root")), name)
        best = saved(hooked.groupBy("was").agg(F.min("root").alias("best")), name)
        moved = hooked.join(best, "was").select("node", "was", F.least("root", "best").alias("root"))
        up = best.join(hooked.select(F.col("node").alias("best"), F.col("root").alias("top")), "best").select(
            F.col("best").alias("root"), F.least("best", "top").alias("top")).distinct()
        jumped = saved(moved.join(up, "root").select("node", "was", F.least("root", "top").alias("root")), name)
        roots = jumped.select("node", "root")
        if jumped.filter(F.col("was") != F.col("root")).isEmpty():
            return roots


def star_pairs(lists: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``a, b``: each list's head, its member of largest weight, with every other member that ``near(n, n)`` lets through.

    ``lists``: value, node, n, weight. As many rows as the lists have, however large one list is.
    """
    heads = saved(lists.groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("head")).select(
        "value", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "heads")
    met = lists.join(heads, "value").filter((F.col("node") != F.col("head")) & near(F.col("n"), F.col("head_n")))
    return saved(met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "stars")


def open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one component, with ``root``, the list's ``size``, and ``outside`` its largest component."""
    members = saved(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    sizes = members.groupBy("value", "root").agg(F.count(F.lit(1)).alias("part"))
    mixed_lists = sizes.groupBy("value").agg(F.max(F.struct("part", "root")).alias("top"), F.sum("part").alias("size"), F.count(F.lit(1)).alias("parts"))
    mixed_lists = saved(mixed_lists.filter("parts > 1").select("value", "size", F.col("top.root").alias("largest")), "open")
    return saved(members.join(mixed_lists, "value").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"), "open_rows")
