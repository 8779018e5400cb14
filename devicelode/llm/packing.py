"""Best-fit packing by minimum bin slack over token pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import mixed, ranked, saved, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids binary"
SLOTS = "length long, low long, high long, each long, first long, base long"


def _encoders(vocabulary: str | None):
    """(fast encoder, reference encoder) of the byte-level BPE; both give the same ids."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @cache
    def slow() -> Tokenizer:
        return Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))

    exact = lambda text: slow().encode(text, add_special_tokens=False).ids
    if vocabulary:
        return exact, exact
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": 50256})
    return (lambda text: fast.encode(text, allowed_special="all")), exact


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids``.

    ``ids`` are little-endian unsigned 32-bit numbers, the document's end marked by ``end_id``. A document longer than
    ``capacity`` is cut so that only its first piece is shorter. Null and empty texts give the end mark alone. Repeated
    rows are documents of their own; other columns are ignored. ``vocabulary``: a ``tokenizers`` file for another
    vocabulary, readable on every executor.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        fast, exact = _encoders(vocabulary)
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = "" if text is None else text
                try:
                    ids = fast(text)
                except BaseException as error:  # the fast library panics on some very long runs
                    if isinstance(error, (KeyboardInterrupt, SystemExit)):
                        raise
                    ids = exact(text)
                ids = np.array([*ids, end_id], "<u4")
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc_id, k, a, b - a, ids[a:b].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def fullest(available: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the longest piece: {length: how many}.

    Bit n of the set says that n tokens can be filled; pieces of one length enter in doubling bundles, the longest first,
    until the capacity itself is reached.
    """
    longest = max(available)
    rest, reach, steps = capacity - longest, 1, []
    mask = (1 << rest + 1) - 1
    for length in sorted((x for x in available if x <= rest), reverse=True):
        left, bundle = min(available[length] - (length == longest), rest // length), 1
        while left > 0:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, bundle = left - take, bundle * 2
        if reach >> rest & 1:
            break
    chosen, at = {longest: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack: the fullest combination is taken out as often as its pieces last, until none is left."""
    available, out = dict(counts), []
    while available:
        chosen = fullest(available, capacity)
        copies = min(available[x] // n for x, n in chosen.items())
        out.append((chosen, copies))
        for x, n in chosen.items():
            available[x] -= n * copies
            if not available[x]:
                del available[x]
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    Only the counts per length (at most ``capacity`` numbers) reach the driver, which packs lengths, not rows; at most 63
    lengths share a bin, so the table of places stays bounded. Rows then take the places of their length by rank.
    """
    rows = saved(pieces.withColumn("_mix", mixed()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, first, slots = dict.fromkeys(counts, 0), 0, []
    for chosen, copies in bins(counts, capacity):
        base = 0
        for length, each in sorted(chosen.items(), reverse=True):
            slots.append((length, used[length], used[length] + each * copies, each, first, base))
            used[length] += each * copies
            base += length * each
        first += copies
    places = F.broadcast(rows.sparkSession.createDataFrame(slots, SLOTS).withColumnRenamed("length", "_length"))
    numbered = ranked(rows, "length", [F.col("_mix")], counts, "_rank")
    at = F.col("_rank") - F.col("low")
    return (numbered.join(places, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
            .withColumn("sequence_id", F.col("first") + F.expr("(_rank - low) div each"))
            .withColumn("offset", F.col("base") + at % F.col("each") * F.col("length"))
            .drop("_mix", "_rank", "_length", "low", "high", "each", "first", "base"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids``; a sequence has at most ``capacity`` tokens, so its rows fit a task."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """Where each piece of each document lies, with the checksum of its ids."""
    pieces = token_pieces(docs, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
