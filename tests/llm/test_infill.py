import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelode.llm import infill
from devicelode.llm.queries import QUERIES

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "character": r"(?s).", "word": r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+", "sentence": r"[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+"}


def expected(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    parts = re.findall(PATTERN[unit], text)
    n = len(parts)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        *head, output = expected(r["doc_id"], r["text"])
        want.append((*head, sha(output), sha(r["text"] or "")))
    assert rows(QUERIES["op13_fill_in_middle"](spark, sf)) == sorted(want, key=repr)
    assert {r[2] for r in want} >= {"psm", "spm"}


@pytest.mark.parametrize("unit", list(infill.UNITS))
def test_units_rates_and_odd_rows(spark, odd_docs, no_docs, unit):
    extra = [(100 + i, t, "en") for i, t in enumerate(["\n", "\n\n\n", "a\nb", "a\n<P>b", "x<S>", "<M>", "end<", "<P\n>", "\U0001f600\n\U0001f600 é.\nß! x?", "\r\n\r\n", "> <S <P\nM>"])]
    table = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")).withColumn("cut", F.lit(1)).withColumn("n", F.lit("x"))
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = infill.fill_in_middle(table, unit, rate=70, suffix_first=30, seed=3)
    back = got.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in back)
    assert rows(got.drop("text")) == sorted((expected(i, t, unit, 70, 30, 3) for i, t in texts), key=repr)
    assert infill.fill_in_middle(no_docs, unit).count() == 0


def test_ranks_and_selects_against_counting():
    rng = random.Random(1)
    kinds = np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(1000)], np.uint8)
    matrix = infill.WaveletMatrix(kinds)
    places = np.arange(1001)
    for kind in range(4):
        assert matrix.rank(kind, places).tolist() == [int((kinds[:p] == kind).sum()) for p in places]
    ends = (1, 3)
    total = int(np.isin(kinds, ends).sum())
    found = matrix.select(ends, np.arange(total + 2), np.zeros(total + 2, np.int64), np.full(total + 2, 1000))
    assert found.tolist() == [0, *(np.flatnonzero(np.isin(kinds, ends)) + 1).tolist(), 1000]
    assert infill.WaveletMatrix(np.zeros(0, np.uint8)).rank(2, np.zeros(3, np.int64)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>"), ("<P>", ">S", "<M>")])
def test_marks_that_overlap_are_refused(no_docs, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(no_docs, marks=marks)
