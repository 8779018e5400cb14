import json

import pytest
from pyspark.sql import functions as F

from devicelode.operators import catalog as C
from devicelode.operators import ordered as O
from devicelode.operators import recommend as R
from devicelode.operators import refresh as X
from devicelode.sources import append_rows, overwrite_swap, read_brand_snapshot, read_catalogue, read_current, read_specs, write_brand_snapshot

CAT = "pos bigint, brand_name string, device_name string, device_url string, device_image string"


def catalogue(spark, rows):
    return spark.createDataFrame([(i, b, n, f"u{i}", "") for i, (b, n) in enumerate(rows)], CAT)


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), F.lit("B").alias("brand_name"), F.concat(F.lit("d"), "id").alias("device_name"),
                                 F.concat(F.lit("u"), "id").alias("device_url"), F.lit("").alias("device_image"))


def test_read_catalogue_short_and_long_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'brand_name,device_name,device_url,device_image\nA,one,u1,i1\nA,two\nB,"th,ree",u3\nB,"fo""ur",u4,i4,extra,more\n')
    rows = read_catalogue(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.device_name, r.device_url, r.device_image) for r in rows] == [
        (0, "one", "u1", "i1"), (1, "th,ree", "u3", ""), (2, 'fo"ur', "u4", "i4")]


def test_positions_follow_files_and_splits(spark, tmp_path):
    for f in range(3):
        lines = "".join(f"B,d{f}-{i:05d},u{f}-{i:05d},\n" for i in range(4000))
        (tmp_path / f"f{f}.csv").write_text("brand_name,device_name,device_url,device_image\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_catalogue(spark, str(tmp_path)).orderBy("pos").select("pos", "device_url").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.pos for r in rows] == list(range(12000))
    assert [r.device_url for r in rows] == [f"u{f}-{i:05d}" for f in range(3) for i in range(4000)]


def test_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("brand_name,device_name,device_url,device_image\n")
    assert read_catalogue(spark, str(tmp_path)).count() == 0


def test_read_specs_quoted_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text('device_url,name,pictures,specifications\nu1,n,[],"{""a"":\n {""b"": ""x""}}"\nu2,n\n')
    rows = read_specs(spark, str(tmp_path)).collect()
    assert [r.device_url for r in rows] == ["u1"] and '"b": "x"' in rows[0].specifications


def test_search_treats_text_as_text(spark):
    cat = catalogue(spark, [("A+", "X (1)"), ("B", "x.1"), ("B", "xa1")])
    assert [r.pos for r in C.search(cat, "x.1").collect()] == [1]
    assert [r.pos for r in C.search(cat, "(1").collect()] == [0]
    assert C.search(cat, "").count() == 3
    assert C.by_brand(cat, None).count() == 3 and C.by_brand(cat, "b").count() == 2


def test_pages_shallow_and_deep_agree(spark, monkeypatch):
    df = numbered(spark, 500)
    shallow = [tuple(r) for r in C.paginate(df, 30, 480).collect()]
    monkeypatch.setattr(C, "TOP_K_ROWS", 0)
    assert sorted(tuple(r) for r in C.paginate(df, 30, 480).collect()) == shallow and len(shallow) == 20
    assert C.paginate(df, 10, 600).count() == 0


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 90, 100])
def test_tiers_of_small_pools(spark, n):
    cat = numbered(spark, n)
    want = {"high_end": list(range(min(30, n))), "mid_range": list(range(n // 3, min(n, n // 3 + 30))),
            "budget": list(range(max(0, n - 30), n))}
    got = R.tier_slices(cat, focuses=None).collect()
    for tier, rows in want.items():
        assert sorted(r.pos for r in got if r.tier == tier) == rows


def test_popular_first_by_bucket_equals_plain_rank(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_ROWS", 7)
    cat = numbered(spark, 200).withColumn("brand_name", F.when(F.col("pos") % 3 == 0, F.lit("Apple")).otherwise(F.lit("Zed")))
    got = [r.pos for r in R.popular_first(cat).orderBy("rank").collect()]
    assert got == [i for i in range(200) if i % 3 == 0] + [i for i in range(200) if i % 3]
    slices = R.tier_slices(cat, focuses=None).filter("tier = 'mid_range'").orderBy("rank").collect()
    assert [r.pos for r in slices] == got[66:96]


def test_concat_distinct_has_no_repeats(spark):
    cat = catalogue(spark, [("Apple", "a"), ("X", "b")]).drop("device_url")
    both = cat.unionByName(cat.withColumn("pos", F.col("pos") + 10))
    out = C.popular_split(both).collect()
    assert sorted((r.pos, r.part) for r in out) == [(0, 0), (1, 1)]


def test_brand_lists_are_numbered_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "bucket_of", lambda order: F.floor(F.col(order) / 10))
    rows = C.brands_with_devices(numbered(spark, 25)).collect()
    assert sorted((r.place, r.pos) for r in rows) == [(i, i) for i in range(25)]


def test_rows_without_an_order_value_come_first(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 500, 3), (None, None, 4)], "k string, n bigint, v bigint")
    ranks = {r.v: (r["rank"], r.t) for r in O.dense_position(df, ["n", "v"], ["k"], total="t", bucket=O.bucket_of("n", 10)).collect()}
    assert ranks == {1: (1, 3), 2: (2, 3), 3: (3, 3), 4: (1, 1)}
    last = {r.v: r.n for r in O.running_last(df, ["n"], ["n", "v"], ["k"], O.bucket_of("n", 10)).collect()}
    assert last == {1: None, 2: 5, 3: 500, 4: None}


def test_delete_brands_splits_the_rows(spark):
    cat = catalogue(spark, [("A", "1"), ("B", "2"), (None, "3")])
    spec = cat.select("device_url")
    kept, left = C.delete_brands(cat, spec, ["A"])
    assert sorted(r.pos for r in kept.collect()) == [1, 2] and left.count() == 2


# ---- ordered rules ------------------------------------------------------------

def test_dense_position_and_look_back_with_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                  (F.col("id") * 37 % 1009).alias("n"))
    rows = [(r.k, r.n) for r in df.collect()]
    ranked = O.dense_position(df, ["n"], ["k"], total="size", bucket=O.bucket_of("n", 50)).collect()
    for r in ranked:
        own = sorted(n for k, n in rows if k == r.k)
        assert own[r["rank"] - 1] == r.n and r["size"] == len(own)
    back = O.look_back(df, F.col("n"), ["n"], ["k"], 4, "last", bucket=O.bucket_of("n", 50), chunk_rows=9).collect()
    assert len(back) == 1000
    for r in back:
        own = sorted(n for k, n in rows if k == r.k)
        i = own.index(r.n)
        assert r["last"] == own[max(0, i - 3):i + 1]


def test_dense_position_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, n bigint")
    assert sorted((r.n, r["rank"]) for r in O.dense_position(df, ["n"], ["k"]).collect()) == [(1, 1), (2, 2), (3, 1)]


# ---- refresh ----------------------------------------------------------------------

def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "device_url string")


def test_new_and_untracked_are_apart(spark):
    listing, cat, ledger = urls(spark, "a", "b", "c", "d"), urls(spark, "b", "c", "c"), urls(spark, "c", "x")
    new = {r[0] for r in X.new_devices(listing, cat).collect()}
    old = {r[0] for r in X.untracked_devices(listing, cat, ledger).collect()}
    assert new == {"a", "d"} and old == {"b"}
    assert X.untracked_devices(listing, cat, ledger.limit(0)).count() == 2


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "device_url string, n int")
    updates = spark.createDataFrame([("b", 9), ("c", 8), ("c", 7)], "device_url string, n int")
    once = X.upsert(target, updates, order="n")
    assert sorted(tuple(r) for r in once.collect()) == [("a", 1), ("b", 9), ("c", 8)]
    assert sorted(map(tuple, X.upsert(once, updates, order="n").collect())) == sorted(map(tuple, once.collect()))


def test_unify_keeps_all_and_equals_left_join(spark):
    cat = urls(spark, "a", "b", "b", "c")
    specs = spark.createDataFrame([("b", 1), ("b", 2), ("z", 3)], "device_url string, n int")
    want = sorted(map(str, cat.join(specs, "device_url", "left").collect()))
    assert sorted(map(str, X.unify(cat, specs).collect())) == want
    assert X.unify(cat, specs, dedupe=True, order="n").count() == 4


def test_append_and_swap(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", "u1", "")], "brand_name string, device_name string, device_url string, device_image string")
    for _ in range(2):
        append_rows(rows, str(tmp_path / "t"))
    assert read_catalogue(spark, str(tmp_path / "t")).count() == 2
    root = str(tmp_path / "v")
    overwrite_swap(rows, root)
    before = read_current(spark, root)
    overwrite_swap(read_current(spark, root).withColumn("device_name", F.lit("y")), root)
    assert read_current(spark, root).first().device_name == "y" and before.first().device_name == "x"


def test_completion_and_checks_without_data(spark):
    cat = catalogue(spark, [("A", "1")])
    brands = spark.createDataFrame([("A", 0), ("B", 5)], "name string, device_count bigint")
    assert sorted(map(tuple, C.completion(cat, brands).collect())) == [("A", 1, 0), ("B", 0, 5)]
    checks = {r.name: r for r in C.brand_checks(brands, cat, urls(spark, "u0", "q")).collect()}
    assert checks["A"].exists and checks["A"].brand_specs == 1 and checks["A"].total_specs == 2
    assert not checks["B"].exists and checks["B"].brand_specs == 0


def test_readers_keep_blank_fields_and_leave_out_short_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text('brand_name,device_name,device_url,device_image\nA,one,,i\nA,two,\nA,"th,ree"\nA,four,"",\n,,,\nA,five,u5,i,x\nA\n')
    rows = read_catalogue(spark, str(tmp_path / "c.csv")).orderBy("pos")
    want = [("one", ""), ("two", ""), ("four", ""), ("", ""), ("five", "u5")]
    assert [tuple(r) for r in rows.select("device_name", "device_url").collect()] == want and rows.count() == rows.select("pos").count() == 5
    (tmp_path / "s.csv").write_text('device_url,name,pictures,specifications\nu1,n,[],\n,n2,,"{""a"": ""x,\n y""}"\nu3,"a,b",[]\nu4,n,,,tech\nu5\n')
    specs = read_specs(spark, str(tmp_path / "s.csv"))
    assert sorted(tuple(r) for r in specs.select("device_url", "specifications").collect()) == [("", '{"a": "x,\n y"}'), ("u1", ""), ("u4", "")]
    assert specs.count() == 3


def test_deep_pages_by_a_text_column(spark, monkeypatch):
    df = spark.range(400).selectExpr("concat('n', lpad(cast(id * 7 % 400 as string), 4, '0')) name", "id").repartition(5)
    shallow = [tuple(r) for r in C.paginate(df, 30, 200, order="name").collect()]
    monkeypatch.setattr(C, "TOP_K_ROWS", 10)
    assert sorted(tuple(r) for r in C.paginate(df, 30, 200, order="name").collect()) == shallow and len(shallow) == 30


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "double"])
def test_deep_pages_of_null_heavy_and_equal_values(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "TOP_K_ROWS", 50)
    monkeypatch.setattr(C, "SAMPLE", 60)
    monkeypatch.setattr(C, "CUTS", 4)
    value = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 40)
    value = F.date_add(F.lit("2024-01-01"), value.cast("int")) if kind == "date" else F.lpad(value.cast("string"), 3, "0") if kind == "string" else value.cast(kind)
    df = spark.range(900).select("id", value.alias("v")).repartition(4)
    every = df.withColumn("_tie", F.xxhash64("id", "v")).orderBy("v", "_tie").select("id").collect()
    for offset, limit in ((100, 30), (290, 40), (300, 1), (880, 100), (250, 500), (899, 5)):
        got = C.paginate(df, limit, offset, order="v").collect()
        assert {r.id for r in got} == {r.id for r in every[offset:offset + limit]} and {r.total for r in got} == {900}
    assert C.paginate(df, 10, 900, order="v").count() == 0


def test_deep_pages_write_and_shuffle_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "TOP_K_ROWS", 50)
    df = spark.range(5000).selectExpr("id * 7 % 5000 AS pos", "concat('x', id) AS name")
    plan = C.paginate(df, 20, 3000)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_snapshot_is_one_document_of_any_size(spark, tmp_path, n):
    rows = spark.range(n).select((F.col("id") * 37 % max(n, 1)).alias("pos"), F.concat(F.lit('Bränd "x",'), "id").alias("name"), F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("device_count"))
    path = str(tmp_path / "s")
    write_brand_snapshot(rows.repartition(3), path, "2025-04-24T07:54:13")
    text = "".join((tmp_path / "s" / f).read_text() for f in sorted(p.name for p in (tmp_path / "s").glob("part-*")))
    doc = json.loads(text)
    want = [(r.name, r.url, r.device_count) for r in rows.orderBy("pos").collect()]
    assert doc["timestamp"] == "2025-04-24T07:54:13" and doc["brand_count"] == n and [(b["name"], b["url"], b["device_count"]) for b in doc["brands"]] == want
    back = read_brand_snapshot(spark, path, parts=True).collect()
    assert sorted((r.name, r.url, r.device_count) for r in back) == sorted(want) and all(r.brand_count == n and str(r.snapshot_ts) == "2025-04-24 07:54:13" for r in back)
