import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from devicelode.llm import periodic
from devicelode.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=24, times=3):
    """Every lag, every stretch of matches at it, and its smallest period by trying all smaller ones."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            size = i - start
            if size >= max(least, times * q) and all(words[start + p:i] != words[start:i - p] for p in range(1, q)):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    got = rows(QUERIES["op11_periodic_runs"](spark, sf))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {i for i, t in docs if len(words_of(t)) <= 1500}
    want = sorted((expected(i, t) for i, t in docs if i in short), key=repr)
    assert [r for r in got if r[0] in short] == want
    assert len(got) == len(docs) and len(want) > len(docs) / 2
    assert sum(r[1] > 0 for r in got) >= len(docs) / 20


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_and_nested_repeats(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        unit = part * rng.randint(1, 6) + [rng.randrange(letters + 1) for _ in range(rng.randint(0, 3))]
        noise = lambda: [rng.randrange(letters + 1) for _ in range(rng.randint(0, 30))]
        text = noise() + unit * rng.randint(1, 5) + unit[:rng.randint(0, len(unit))] + noise()
        if rng.random() < 0.5 and text:
            text[rng.randrange(len(text))] = letters + 1
        texts.append(text)
    texts += [[], [0], [0] * 23, [0] * 24, [0, 1] * 12, [0, 1] * 11 + [0], list(range(8)) * 3, list(range(9)) * 3, (list(range(9)) * 3)[:-1]]
    sizes = [len(t) for t in texts]
    got = periodic.runs_of(np.concatenate([np.array(t, np.int64) for t in texts]), np.repeat(np.arange(len(texts)), sizes))
    want, at = [], 0
    for text, size in zip(texts, sizes, strict=True):
        want += [(s + at, n, q) for s, n, q in brute(text)]
        at += size
    assert [tuple(map(int, r)) for r in got] == want
    assert len(want) > 20


def test_one_word_a_hundred_thousand_times_is_one_run():
    assert periodic.runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def test_odd_rows(spark, odd_docs, no_docs):
    assert periodic.periodic_runs(no_docs).count() == 0
    got = sorted((tuple(r) for r in periodic.periodic_runs(odd_docs).select("doc_id", "n_words", "collapsed").collect()), key=repr)
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got == sorted(((i, len(words_of(t)), " ".join(words_of(t))) for i, t in texts), key=repr)
    table = spark.createDataFrame([(1, "x\ty " * 12 + "z"), (1, "x\ty " * 12 + "z"), (None, "é " * 30), (2, None), (3, "a b " * 11 + "a")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic.periodic_runs(table).collect()), key=repr)
    assert found == sorted([(1, "x y z", [(0, 24, 2)])] * 2 + [(None, "é", [(0, 30, 1)]), (2, "", []), (3, " ".join(["a b"] * 11 + ["a"]), [])], key=repr)


def test_strongest_is_exact(spark):
    runs = [(0, 24, 7), (5, 48, 14), (9, 40, 11)]
    df = spark.createDataFrame([(runs,), ([],), ([(3, 30, 10), (4, 24, 8)],)], f"runs {periodic.RUNS}")
    got = [r[0] and tuple(r[0]) for r in df.select(periodic.strongest(df["runs"])).collect()]
    assert got == [(9, 40, 11), None, (3, 30, 10)]


def test_fewer_than_three_periods_are_refused(no_docs):
    with pytest.raises(ValueError):
        periodic.periodic_runs(no_docs, times=2)
