import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelode.llm import search


def brute(rows, k):
    rows = [(i, np.floor(64 * np.array(v, float))) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, dims - len(v)))) for i, v in rows]
    out = set()
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def answer(df, **options):
    return {tuple(r) for r in search.top_k(search.whole_vectors(df), F.col("vec_id") % 20 == 0, **options).collect()}


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 20)
    assert answer(df) == want
    assert answer(df, candidate_block=64, query_block=7) == want


@pytest.mark.parametrize("rows", [
    [], [(0, [1.0, 2.0])], [(0, None), (1, [1.0])], [(20, [1.0, None]), (40, [float("nan"), 0.0]), (0, [float("inf"), 1.0]), (60, [1.0, 1.0]), (3, [1.0, 1.0])],
    [(i, [1.0, -0.5]) for i in range(50)], [(0, [1e7, 2.0]), (1, [3e7, -1.0]), (2, [1e7, 1.0]), (20, [])], [(None, [1.0]), (0, [1.0]), (5, [2.0, 1.0])],
    [(-20, [-0.01, 0.3]), (7, [-0.01, 0.3]), (8, [0.2, 0.2])]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, block int")
    assert answer(df) == brute(rows, 20)


def test_many_dimensions_and_a_floor(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, rng.choice([0.05, 1.0]), 70)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answer(df, k=5) == brute(rows, 5)


def test_batches_and_chunks_against_brute_force(monkeypatch):
    monkeypatch.setattr(search, "BATCH", 7)
    rng = np.random.default_rng(5)
    for dims, big in ((1, 3), (40, 9), (40, 1 << 27)):
        cells = (rng.integers(-big, big + 1, (dims, 1500)) * rng.choice([1, 1, 2], 1500)).astype(np.int64)
        ids = rng.permutation(1500).astype(np.int64)
        for query_id, found, scores in search.bounded_search(cells[:, :40], ids[:40], cells, ids, 6):
            query = cells[:, ids.tolist().index(query_id)]
            every = sorted((-int(x), i) for x, i in zip(query @ cells, ids.tolist()) if i != query_id)[:6]
            assert [(-int(x), i) for x, i in zip(scores, found.tolist())] == every


def test_products_beyond_64_bits_are_an_error():
    cells = np.full((2, 3), 1 << 32, np.int64)
    with pytest.raises(OverflowError):
        list(search.bounded_search(cells[:, :1], np.array([0]), cells, np.arange(3), 2))


def test_query_blocks_are_sent_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i % 200, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    passes, whole = [], search.top_k(search.whole_vectors(df), F.col("vec_id") % 2 == 0, k=4, candidate_block=50, query_block=20).collect()
    monkeypatch.setattr(search, "SENT_BYTES", 700)
    monkeypatch.setattr(search, "saved", lambda d, name, kept=search.saved: passes.append(name) or kept(d, name))
    cut = search.top_k(search.whole_vectors(df), F.col("vec_id") % 2 == 0, k=4, candidate_block=50, query_block=20).collect()
    assert passes.count("best") > 2 and sorted(cut) == sorted(whole) and len(whole) == 400


def test_blocks_sent_round_are_not_multiplied(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    top = search.top_k(search.whole_vectors(df), F.col("vec_id") % 5 == 0, candidate_block=10, query_block=10)
    lines = top._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    sent = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    under = [x for i in sent for j, x in enumerate(lines[i + 1:], i + 1) if all(d > depth[i] for d in depth[i + 1:j + 1])]
    assert sent and under and not any("Generate" in x for x in under)
