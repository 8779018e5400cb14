import zlib
from collections import Counter, defaultdict

import pytest

from devicelode.llm import sharding


@pytest.mark.parametrize("sizes", [[], [5], [8, 7, 6, 5, 4], list(range(1, 200)), [1000] + [1] * 50])
def test_differencing_beats_greedy(sizes):
    shards = 4
    where = sharding.differencing(sizes, shards)
    loads, greedy = [0] * shards, [0] * shards
    for size, s in zip(sizes, where, strict=True):
        loads[s] += size
    for size in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += size
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) <= max(greedy) - min(greedy)


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("items", [1024, 8])
def test_shards(request, name, items):
    docs = request.getfixturevalue(name)
    got = sharding.shard_by_bytes(docs, 4, items).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter(tuple(r)[:3] for r in got) == want
    slots, text_shards, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text_shards[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in text_shards.values())
    if name == "docs" and items == 1024:
        assert max(loads.values()) - min(loads.values()) <= 64
