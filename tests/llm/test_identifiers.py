import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicelode.llm import identifiers
from devicelode.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), place, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def spans(df, **options):
    return {(r["doc_id"], r["base"], r["found"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in identifiers.personal_data(df, **options).collect()}


HARD = ["a@b.c_d@e.f", "x@y.z@q.r.s", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.002.0255.255 9.9.9.9.9", "4111 1111-1111 1111", "4111  1111 1111 1111",
        "+1 (744) 555-2801.", "+1+2 345 678 9012 ", "++1 234 567 890", "é+49 30 1234567 ü a.b+c@d-e.f-g.h ß", "@a.b", "a@b", "a@b.", "%@-.-", "5 5 5 5", "1" * 5000,
        "a" * 20000 + "@b.c", "1." * 3000, "+1" + " " * 3000 + "2", "\U0001F600 a@b.cd 4485275742308327", "" , None, "a@b.c\na@b.c"]


@pytest.mark.parametrize("name", ["odd_docs", "docs", "no_docs"])
def test_base_spans(request, name):
    df = request.getfixturevalue(name)
    got = identifiers.personal_data(df).collect()
    assert len(got) == df.count()
    assert {(r["doc_id"], r["base"]) for r in got} == {(r["doc_id"], base(r["text"])) for r in df.collect()}


def test_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for doc_id, listed, found, *counts in spans(df):
        assert listed == base(HARD[doc_id]), HARD[doc_id]
        assert counts == [listed.count(k) for k in PLAIN] and set(filter(None, listed.split(","))) <= set(found.split(","))


@given(st.lists(st.text("a@.1+ -_(4é\n", max_size=40), min_size=20, max_size=40))
@settings(max_examples=5, deadline=None)
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(d, b) for d, b, *_ in spans(df)} == {(i, base(t)) for i, t in enumerate(texts)}


def test_contexts_find_unseen_identifiers(spark):
    keys = [f"{i:08x}" * 4 + "a1" for i in range(40)]
    rows = [(i, f'some words token = "{k}" and more') for i, k in enumerate(keys)]
    rows += [(100, 'here token = "Zx81-unseen!"'), (101, "see item 42 of the list"), (102, 'a token = "q@r.st" b'), (103, "item 77 again")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, kind string")
    got = {d: f for d, _, f, *_ in spans(df)}
    text = dict(rows)[100]
    a = text.index("Zx81")
    assert got[100] == f"secret:{a}:{a + len('Zx81-unseen')}"
    assert got[0].startswith("secret:") and got[101] == got[103] == "" and got[102].startswith("email:")


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_contextual_pii"](spark, sf).withColumn("want", F.lit(0)).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        fixed = base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [fixed.count(k) for k in PLAIN] and set(filter(None, fixed.split(","))) <= set(r["spans"].split(","))


def test_parts_of_addresses_with_leading_zeros(spark):
    texts = ["1.0999.2.3", "1.0300.2.3", "0.0000.00.0", "1.0255.2.003", "1.00256.2.3", "1.2.3.0000000000255", "1.99999999999.2.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["base"], r["n_ip"]) for r in identifiers.personal_data(df).collect()}
    assert got == {i: (base(t), base(t).count("ip")) for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(len(texts))] == [0, 0, 1, 1, 0, 1, 0]
