import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from devicelode.operators import catalog as C
from devicelode.operators import ordered as O
from devicelode.operators import usage as U
from devicelode.streaming import streams as S

T0 = datetime(2024, 1, 1, 10, 0, 0)


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), k, "r", tier) for i, (s, k, tier) in enumerate(rows)],
                                 "event_id bigint, ts timestamp, client string, route string, tier string")


def test_rate_limits_at_and_past_the_limit(spark):
    rows = [(i % 60, "at", "basic") for i in range(60)] + [(i % 60, "past", "basic") for i in range(61)]
    rows += [(i % 60, "premium", "premium") for i in range(61)] + [(59 + i // 40, "edge", "basic") for i in range(80)]
    out = {}
    for r in U.rate_audit(log(spark, rows)).collect():
        out.setdefault(r.client, []).append((r.requests, r.refused))
    assert out["at"] == [(60, 0)] and out["past"] == [(61, 1)] and out["premium"] == [(61, 0)]
    assert sorted(out["edge"]) == [(40, 0), (40, 0)]


def test_running_usage_and_status(spark):
    df = log(spark, [(0, "a", ""), (5, "a", ""), (5, "a", ""), (400, "a", ""), (3, "b", "")]).withColumnRenamed("client", "key")
    rows = {r.event_id: r.usage_count for r in U.usage_running(df).collect()}
    assert rows == {0: 1, 1: 2, 2: 3, 3: 4, 4: 1}
    newest = {r.key: r.event_id for r in U.latest_status(df, ["key"]).collect()}
    assert newest == {"a": 3, "b": 4}
    tie = U.latest_status(df.filter("event_id in (1, 2)"), ["key"]).first()
    assert tie.event_id == 1


def test_fold_crosses_buckets(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(hours=i), "k", f"m{i}" if i in (0, 4) else None, i if i == 2 else None) for i in range(7)],
                               "event_id bigint, ts timestamp, k string, message string, done bigint")
    rows = U.fold_status(df, ["message", "done"], ["k"]).orderBy("event_id").collect()
    assert [(r.message, r.done) for r in rows] == [("m0", None), ("m0", None), ("m0", 2), ("m0", 2), ("m4", 2), ("m4", 2), ("m4", 2)]
    end = U.status_now(df, ["message", "done"], ["k"]).first()
    assert (end.message, end.done) == ("m4", 2)


def test_usage_summary_fills_zero(spark):
    keys = spark.createDataFrame([("basic", 3)], "tier string, usage_count bigint")
    assert tuple(U.usage_summary(keys).first()) == (1, 1, 0, 3)
    assert tuple(U.usage_summary(keys.limit(0)).first()) == (0, 0, 0, 0)


def test_progress_without_expectation(spark):
    work = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "pos bigint, brand_name string")
    brands = spark.createDataFrame([("a", 0), ("b", 0)], "name string, device_count bigint")
    rows = U.progress(work, brands).orderBy("pos").collect()
    assert [(r.current_brand_progress, r.devices_processed, r.progress) for r in rows] == [(50, 1, 100), (100, 2, 100), (100, 3, 100)]


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    df = log(spark, [(i * 7, f"c{i % 5}", "basic") for i in range(200)])
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    S.start_keyed(S.usage_stream(stream, "client"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = S.latest_table(spark, str(tmp_path / "out"), ["client"])
    assert spark.read.parquet(str(tmp_path / "out")).select("batch_id").distinct().count() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, U.usage_totals(df, "client").select(*got.columns).collect()))


def test_dedupe_stream(spark, tmp_path):
    rows = log(spark, [(i, f"u{i % 3}", "") for i in range(30)]).select(F.col("client").alias("device_url"), "ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    (S.dedupe_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.device_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u0", "u1", "u2"]


# ---- ordered rules, whole and in pieces ------------------------------------------------------

def brute_folded(rows):
    """(id, last non-null value, count) of every row, by plain loops over (key, time, id)."""
    out, state, seen = {}, {}, {}
    for key, ts, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        state[key] = v if v is not None else state.get(key)
        seen[key] = seen.get(key, 0) + 1
        out[i] = (state[key], seen[key])
    return out


def busy_rows():
    """One key with most rows, hundreds of them in one instant; a null key, null times."""
    rng = random.Random(3)
    rows = [("hot", 60, i, i if rng.random() < 0.1 else None) for i in rng.sample(range(10_000), 400)]
    rows += [("hot", rng.randint(0, 300), 20_000 + i, i if rng.random() < 0.2 else None) for i in range(300)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, 5, 7, 90]), 30_000 + i, i if rng.random() < 0.3 else None) for i in range(120)]
    return rows


@pytest.mark.parametrize("limit", [20, 100_000])
def test_running_rules_in_even_pieces(spark, monkeypatch, limit):
    monkeypatch.setattr(O, "BUCKET_ROWS", limit)
    rows = busy_rows()
    df = spark.createDataFrame(rows, "user string, s long, event_id long, v long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    want = brute_folded(rows)
    folded = {r.event_id: r.v for r in U.fold_status(df, ["v"], ["user"]).collect()}
    counted = {r.event_id: r.usage_count for r in U.usage_running(df, "user").collect()}
    assert folded == {i: w[0] for i, w in want.items()} and counted == {i: w[1] for i, w in want.items()}
    if limit == 20:
        pieces = O.even_buckets(df, ["user"], "ts", "event_id", 60).filter("user = 'hot' AND s = 60").groupBy("_bucket").count().collect()
        assert len(pieces) > 20 and max(r["count"] for r in pieces) < 60


def exchanges_with(df, column):
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = text.split("== Initial Plan ==")[0]
    return len(re.findall(rf"\) Exchange\s*\nInput \[\d+\]: \[[^\n]*\b{column}#", text))


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(busy_rows(), "user string, s long, event_id long, v long").withColumn("ts", F.timestamp_seconds("s")).withColumn("text", F.concat(F.lit("x"), "event_id"))
    back = O.look_back(df, F.col("text"), ["event_id"], ["user"], 4, "said")
    for ranked in (back, U.usage_running(df, "user"), U.fold_status(df, ["v"], ["user"])):
        assert exchanges_with(ranked, "text") == 1


@pytest.mark.parametrize("chunk", [1, 3, 7, 50, 10_000])
def test_look_back_over_chunks_of_any_size(spark, monkeypatch, chunk):
    rows = [("a", i * i % 97 * 1000 + i, f"t{i}") for i in range(60)] + [("b", i, f"b{i}") for i in range(3)] + [(None, i, f"n{i}") for i in range(9)] + [("c", None, "c0"), ("c", 4, "c1")]
    df = spark.createDataFrame(rows, "conv string, turn long, text string").repartition(4)
    for n in (1, 2, 5):
        said = {}
        for conv, turn, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
            said.setdefault(conv, []).append(text)
        want = {(c, t): said[c][max(0, i - n + 1):i + 1] for c in said for i, t in enumerate(said[c])}
        got = {(r.conv, r.text): r.said for r in O.look_back(df, F.col("text"), ["turn"], ["conv"], n, "said", bucket=F.floor(F.col("turn") / 500), chunk_rows=chunk).collect()}
        assert got == want


def test_one_per_key(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "n"), ("b", 5, "z"), (None, 3, "q"), (None, 4, "r"), ("c", None, "only")]
    df = spark.createDataFrame(rows, "k string, n long, doc string")
    take = lambda last: sorted((tuple(r) for r in O.one_per_key(df, ["k"], "n", ["k", "doc"], last).collect()), key=repr)
    assert take(False) == sorted([("a", "y"), ("b", "n"), (None, "q"), ("c", "only")], key=repr)
    assert take(True) == sorted([("a", "x"), ("b", "z"), (None, "r"), ("c", "only")], key=repr)
    for plan in (O.first_per_key(df, ["k"], "n", ["k", "doc"]), C.concat_distinct(df.withColumnRenamed("n", "pos"), df.withColumnRenamed("n", "pos"))):
        assert "SortAggregate" not in plan._jdf.queryExecution().toString()
