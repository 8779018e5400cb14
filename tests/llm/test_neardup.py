import random
from math import comb

import pytest

import corpus_pipeline
from devicelode.llm import neardup
from devicelode.llm.common import components


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def answer(df):
    got = neardup.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((tuple(r)[:3] for r in got), key=repr)


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_against_brute_force(request, name):
    df = request.getfixturevalue(name)
    assert answer(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_groups_of_copies_chains_and_shared_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], rng.choices(vocabulary, k=150)
    for i in range(60):  # near copies of one text, each with a word of its own
        copy = list(base)
        copy[rng.randrange(150)] = f"own{i}"
        rows.append(copy)
    chain = rng.choices(vocabulary, k=200)
    for i in range(40):  # a chain whose ends share little
        chain = chain[3:] + rng.choices(vocabulary, k=3)
        rows.append(chain)
    passage = rng.choices(vocabulary, k=60)
    for i in range(50):  # one passage in otherwise different texts
        rows.append(rng.choices(vocabulary, k=rng.randint(5, 80)) + passage + rng.choices(vocabulary, k=rng.randint(0, 40)))
    for n in range(1, 45):  # short texts around the sketch's size
        short = rng.choices(vocabulary, k=n)
        rows += [short, short[:-1], short + ["tail"]]
    rng.shuffle(rows)
    rows = [(1000 - i, " ".join(r)) for i, r in enumerate(rows)]
    assert answer(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_chance_of_a_miss_holds_for_every_threshold():
    for percent in range(5, 101):
        size, least, j = neardup.sketch_size(percent), neardup.least_shared(percent), percent / 100
        assert sum(comb(size, i) * j ** i * (1 - j) ** (size - i) for i in range(least)) <= neardup.MISS and 1 <= least <= size
    assert (neardup.sketch_size(85), neardup.least_shared(85), neardup.least_shared(80)) == (32, 17, 14)


def test_the_pipeline_links_from_80_per_cent(spark):
    rng = random.Random(21)
    rows = []
    for i in range(80):  # pairs at 0.80 to 0.85: 116 words, two of them replaced, which breaks ten shingles
        first = [f"w{rng.randrange(50_000)}" for _ in range(116)]
        second = first[:40] + ["one"] + first[41:80] + ["two"] + first[81:]
        a, b = shingles(" ".join(first)), shingles(" ".join(second))
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(second))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {2 * i for i in range(80)}
