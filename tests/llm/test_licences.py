import random

from pyspark.sql import functions as F

from devicelode.llm import licences
from devicelode.llm.queries import QUERIES

NOTICES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
           "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit"}


def test_query_finds_the_notices_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op10_licence_scan"](spark, sf).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        want = sorted({NOTICES[x] for x in text.split("\n") if x in NOTICES})
        assert got[d]["families"] == ",".join(want), text
        assert got[d]["n_lines"] == len(text.split("\n"))
        reserved = text.split("\n").count("All rights reserved.")  # licence talk of no family
        assert got[d]["n_unknown"] == reserved and got[d]["n_licence"] == reserved + sum(x in NOTICES for x in text.split("\n"))
    assert any(r["families"] for r in got.values())


def test_held_out_accuracy_and_unknown(spark, docs):
    """Notices with words dropped by another rule than in training keep their family; other licence talk is unknown."""
    rng, rows, truth = random.Random(1), [], {}
    for family, lines in licences.TEMPLATES.items():
        for line in lines:
            words = line.split()
            if len(words) > 8:
                del words[rng.randrange(len(words))]
            truth[len(rows)] = family
            rows.append((len(rows), " ".join(words).upper()))
    first = len(rows)
    rows += [(first, "Licensed under a license of our own making, all rights reserved"), (first + 1, "The cat sat on the mat and slept")]
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = {r["doc_id"]: r for r in licences.licences(both).collect()}
    right = sum(truth[i] == got[i]["families"] for i in truth)
    assert right / len(truth) > 0.85
    assert got[first]["families"] == "" and got[first]["n_unknown"] == 1
    assert got[first + 1]["n_licence"] == 0


def test_odd_rows(odd_docs, no_docs):
    got = licences.licences(odd_docs)
    assert got.count() == odd_docs.count() and all(r["n_licence"] == 0 for r in got.collect())
    assert got.filter("doc_id = 0").first()["n_lines"] == 0
    assert licences.licences(no_docs).count() == 0
