import os

import pytest
from pyspark.sql import functions as F

from devicelode.plans.refreshing import last_full_update, refresh
from devicelode.sources import ConcurrentWrite, compact, create_keyed, overwrite_swap, read_current, read_keyed, upsert_keyed
from devicelode.sources.keyed import latest_commit, publish
from devicelode.streaming import streams as S

ROW = "device_url string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_rows_are_replaced_by_key_without_touching_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    create_keyed(spark.createDataFrame([(f"u{i}", i) for i in range(40)] + [("u1", 100), (None, 7)], ROW), path, buckets=8)
    before = files(path)
    upsert_keyed(spark.createDataFrame([("u1", -1), ("u2", -2), ("new", 5), (None, 8)], ROW), path)
    upsert_keyed(spark.createDataFrame([("u2", -3), ("u2", -4), ("u2", -9)], ROW).withColumn("at", F.col("n") * 2), path, order="at")
    want = sorted([(f"u{i}", i) for i in range(40) if i not in (1, 2)] + [("u1", -1), ("u2", -3), ("new", 5), (None, 8)], key=repr)
    assert rows(read_keyed(spark, path)) == want
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    held = latest_commit(spark, path)[1]
    old = read_keyed(spark, path)
    compact(spark, path)
    now = latest_commit(spark, path)[1]
    assert rows(read_keyed(spark, path)) == rows(old) == want and now["deltas"] == []
    touched = {b for d in held["deltas"] for b in d["buckets"]}
    assert 0 < len(touched) < 8 and {b for b in now["base"] if now["base"][b] != held["base"].get(b)} == {str(b) for b in touched}
    assert compact(spark, path) == latest_commit(spark, path)[0]


def test_deltas_are_compacted_by_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    create_keyed(spark.createDataFrame([], ROW), path, buckets=4)
    assert read_keyed(spark, path).count() == 0
    for i in range(4):
        upsert_keyed(spark.createDataFrame([("a", i), (f"b{i}", i)], ROW), path, most_deltas=2)
    assert rows(read_keyed(spark, path)) == [("a", 3), *[(f"b{i}", i) for i in range(4)]]
    assert len(latest_commit(spark, path)[1]["deltas"]) <= 2
    upsert_keyed(spark.createDataFrame([], ROW), path)
    assert read_keyed(spark, path).count() == 5


def test_two_writers_cant_both_publish(spark, tmp_path):
    path, swapped = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.createDataFrame([("a", 1)], ROW)
    seen = create_keyed(df, path)
    upsert_keyed(df.withColumn("n", F.lit(2)), path, seen=seen)
    with pytest.raises(ConcurrentWrite):
        upsert_keyed(df, path, seen=seen)
    with pytest.raises(ConcurrentWrite):
        publish(spark, path, latest_commit(spark, path)[0], {})
    with pytest.raises(ConcurrentWrite):
        create_keyed(df, path)
    assert rows(read_keyed(spark, path)) == [("a", 2)]
    first = overwrite_swap(df, swapped)
    overwrite_swap(df.withColumn("n", F.lit(5)), swapped, seen=first)
    with pytest.raises(ConcurrentWrite):
        overwrite_swap(df.withColumn("n", F.lit(6)), swapped, seen=first)
    assert rows(read_current(spark, swapped)) == [("a", 5)]
    with pytest.raises(FileNotFoundError):
        read_current(spark, str(tmp_path / "none"))


def test_a_commit_cut_off_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_swap(spark.createDataFrame([("a", 1)], ROW), path)
    (tmp_path / "t" / "commits" / f"{2:020d}.json").write_text('{"vers')
    assert rows(read_current(spark, path)) == [("a", 1)]
    assert overwrite_swap(spark.createDataFrame([("a", 3)], ROW), path) == 3
    assert rows(read_current(spark, path)) == [("a", 3)]


def test_a_key_that_comes_back_is_never_emitted_again(spark, tmp_path):
    schema = "device_url string, ts timestamp, what string"
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[("a", 5, "late"), ("a", 3, "first"), (None, 1, "x")], [("a", 1, "earlier but second batch"), ("b", 400_000, "b")], [("b", 1, "again"), (None, 9, "y"), ("c", 90_000_000, "c")]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "device_url string, s long, what string").select("device_url", F.timestamp_seconds("s").alias("ts"), "what").write.mode("append").parquet(inbox)
        S.start_dedupe(spark.readStream.schema(schema).parquet(inbox), out, state).awaitTermination()
        assert rows(spark.read.parquet(out).filter(F.col("batch_id") == i).select("device_url", "what")) == [[("a", "first"), (None, "x")], [("b", "b")], [("c", "c")]][i]
    assert rows(S.first_rows(spark, out).select("device_url", "what")) == [("a", "first"), ("b", "b"), ("c", "c"), (None, "x")]
    # A batch that runs again with an empty state writes what it wrote.
    S.start_dedupe(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / "state2")).awaitTermination()
    assert {r[0] for r in rows(spark.read.parquet(out).filter("batch_id = 0").select("device_url"))} == {"a", "b", "c", None}


def test_refresh_reads_galleries_keeps_its_report_and_counts_processed_brands(spark, tmp_path):
    root, base = str(tmp_path / "root"), "https://x.test/"
    cat = "pos bigint, brand_name string, device_name string, device_url string, device_image string"
    listing = spark.createDataFrame([(0, "A", "One", base + "one-1.php", ""), (1, "A", "Two", base + "two-2.php", ""), (2, "B", "Three", base + "three-3.php", "")], cat)
    create_keyed(listing.filter("pos = 0"), f"{root}/catalogue")
    create_keyed(spark.createDataFrame([(base + "one-1.php", "old", "[]", "{}")], "device_url string, name string, pictures string, specifications string"), f"{root}/specs")
    create_keyed(spark.createDataFrame([], "device_url string, last_updated timestamp, brand string"), f"{root}/ledger")
    page = lambda i, n: (i, f"{base}{n}-{i}.php", f"<h1>{n}</h1><div class='specs-photo-main'><a href='{n}.jpg'></a></div>")
    pages = spark.createDataFrame([page(1, "one"), page(2, "two")], "page_id bigint, url string, html string")
    galleries = spark.createDataFrame([(9, base + "two-pictures-2.php", "<div id=pictures-list><img src=g.jpg></div>")], "page_id bigint, url string, html string")
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    report = refresh(spark, listing, pages, root, "2025-01-01", galleries, base, asked, batch=0).first()
    assert (report.new_devices, report.updated_devices, report.brands_processed, report.total_brands, report.last_full_update) == (1, 1, 1, 3, None)
    assert rows(read_keyed(spark, f"{root}/specs").select("name", "pictures")) == [("one", f'["{base}one.jpg"]'), ("two", f'["{base}two.jpg","g.jpg"]')]
    assert last_full_update(spark, root).first()[0] is None
    again = refresh(spark, listing, pages, root, "2025-01-02", galleries, base, asked.filter("name = 'A'"), batch=1).first()
    assert (again.new_devices, again.updated_devices, again.brands_processed, again.total_brands) == (0, 0, 1, 1)
    assert str(last_full_update(spark, root).first()[0]).startswith("2025-01-02") and read_keyed(spark, f"{root}/catalogue").count() == 2


def test_tables_of_a_refresh_are_not_sent_round(spark, tmp_path):
    from devicelode.operators.extract import assemble_records
    from devicelode.plans.refreshing import plan_refresh
    from devicelode.sources.keyed import create_keyed, read_keyed, upsert_keyed

    rows = lambda *urls: spark.createDataFrame([(u, 1) for u in urls], "device_url string, n int")
    path = f"{tmp_path}/table"
    create_keyed(rows("a", "b"), path, buckets=2)
    upsert_keyed(rows("b", "c"), path)
    table = read_keyed(spark, path)
    assert sorted(r["device_url"] for r in table.collect()) == ["a", "b", "c"]
    pages = spark.createDataFrame([(1, "u-1.php", "<h1>x</h1>")], "page_id bigint, url string, html string")
    for df in (table, plan_refresh(table, table, table), assemble_records(pages, pages)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
