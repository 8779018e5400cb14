import hashlib
import re

import pytest
from pyspark.sql import functions as F

from devicelode.llm import leaks
from devicelode.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        names = ",".join(sorted(str(x) for x in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def answer(docs, items):
    got = leaks.contamination(docs, items)
    sha = F.sha2(F.concat_ws(",", "items"), 256)
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", sha, "contaminated").collect()), key=repr)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_query_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert sorted((tuple(r) for r in QUERIES["op9_decontamination"](spark, sf).collect()), key=repr) == want
    assert any(r[5] for r in want)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_odd_rows(spark, odd_docs, no_docs, monkeypatch, bound):
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", bound)
    base = odd_docs.filter("doc_id = 10").first()["text"]
    items = [(1, None), (2, ""), (3, "One"), (3, "two, words"), (4, base), (4, base), (5, " ".join(base.split()[40:49])), (None, "É é"), (6, "one two three FOUR"),
             (7, "a b a b a b a b a b a b a b")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    names = [(i, t) for i, t in items if i is not None]
    got = answer(odd_docs, table.filter("item_id is not null"))
    assert got == brute(pairs(odd_docs, "doc_id", "text"), names)
    assert leaks.contamination(odd_docs, table).filter("contaminated").count() > 0
    assert answer(no_docs, table) == []
    assert not any(r[5] for r in answer(odd_docs, table.limit(0)))


def test_decontaminated(spark, odd_docs):
    base = odd_docs.filter("doc_id = 10").first()["text"]
    table = spark.createDataFrame([(4, base)], "item_id long, text string")
    dirty = {r["doc_id"] for r in leaks.contamination(odd_docs, table).filter("contaminated").collect()}
    kept = leaks.decontaminated(odd_docs, table)
    assert kept.columns == odd_docs.columns
    assert not dirty - {None} & {r["doc_id"] for r in kept.collect()}
    cleaned = leaks.decontaminated(odd_docs, table, spans=True)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count()
    assert not leaks.contamination(cleaned, table).filter("contaminated").count()
    assert cleaned.filter("doc_id = 12").first()["text"].split() == ["x"]
