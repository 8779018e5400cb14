import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from devicelode.llm import packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_fullest_is_as_full_as_any_combination_with_the_longest(available):
    chosen = packing.fullest(available, 40)
    assert all(available[x] >= n for x, n in chosen.items()) and chosen[max(available)] >= 1
    sums = {max(available)}
    for x, n in available.items():
        for _ in range(n - (x == max(available))):
            sums |= {s + x for s in sums if s + x <= 40}
    assert sum(x * n for x, n in chosen.items()) == max(sums)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
@settings(max_examples=30, deadline=None)
def test_bins_hold_every_piece_once(counts):
    used, n = Counter(), 0
    for chosen, copies in packing.bins(counts, 64):
        assert sum(x * k for x, k in chosen.items()) <= 64
        n += copies
        used.update({x: k * copies for x, k in chosen.items()})
    assert used == Counter(counts)
    assert n >= -(-sum(x * k for x, k in counts.items()) // 64)


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_packed_documents_against_the_tokenizer(request, name):
    docs, capacity = request.getfixturevalue(name), 256
    got = packing.packed_documents(docs, capacity).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // capacity) + 2


def test_sequences_are_the_tokens(docs):
    pieces = packing.token_pieces(docs.limit(30), 256)
    packed = packing.pack(pieces, 256)
    rows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
