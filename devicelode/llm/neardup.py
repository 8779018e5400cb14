"""Near-duplicate documents: bottom-k sketches, inverted lists of retained values, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devicelode.llm.common import components, open_lists, saved, small_batches, star_pairs

K = 32        # values a sketch retains at least
MISS = 4e-6   # chance at most that sketches of documents exactly at the threshold share less than ``least_shared`` values
BROADCAST_IDS = 1_000_000
BLOCK = 64    # documents compared with others at once


def sketch_size(percent: int) -> int:
    """How many values a sketch retains, so that those of documents at the threshold share one but for a chance of ``MISS``."""
    return K if percent >= 100 else max(K, ceil(log(MISS) / log(1 - percent / 100)))


def least_shared(percent: int) -> int:
    """How many of their values the sketches of linked documents share, but for a chance of ``MISS`` at the threshold (a binomial tail)."""
    size, j, chance = sketch_size(percent), percent / 100, 0.0
    for least in range(size):
        chance += comb(size, least) * j ** least * (1 - j) ** (size - least)
        if chance > MISS:
            return max(1, least)
    return size


class _Hashes(dict):
    """64-bit hashes of words; the frequent ones are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < 1 << 16:
            self[word] = value
        return value


def shingle_hashes(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    size = min(width, len(tokens))
    value = np.full(len(tokens) - size + 1, size, np.uint64)
    for j in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(codes) - size + 1 + j]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(((value ^ (value >> np.uint64(33))) >> np.uint64(1)).astype(np.int64))


def signed(docs: DataFrame, width: int = 5, size: int = K) -> DataFrame:
    """``doc_id, n_shingles, signature, sketch`` of every whole text; equal sets have equal signatures, empty ones none."""
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = _Hashes()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = shingle_hashes(text, width, words)
                code = xxhash.xxh128_digest(found.tobytes()) if len(found) else None
                rows.append((doc_id, len(found), code, found[:size].copy()))  # not a view: the whole set can go
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "signature", "sketch"]).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        sketch, "doc_id long, n_shingles long, signature binary, sketch array<long>")


def _prefix(n: Column, percent: int) -> Column:
    """How many of a sketch's rarest values must be listed so that linked documents meet in one list.

    Sets of up to 85 % of a sketch's values (at 85 per cent) meet only sets that their sketches hold whole, so the bound is exact there.
    """
    whole = n - F.ceil(n * percent / 100) + 1
    return F.when(n * 100 <= sketch_size(percent) * percent, whole).otherwise(F.least(n, F.lit(sketch_size(percent))) - least_shared(percent) + 1)


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """Inverted lists ``value, node, n, weight`` of the rarest retained values, those held by one class only left out.

    ``weight`` adds up in how many sketches a class's values occur: the text that a group's copies derive from has the most.
    """
    values = classes.select("signature", "n", F.explode("sketch").alias("value"))
    shared = saved(values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held")
    by_rarity = Window.partitionBy("signature").orderBy("held", "value")
    met = (values.join(shared, "value").withColumn("_at", F.row_number().over(by_rarity))
           .withColumn("_met", F.count(F.lit(1)).over(Window.partitionBy("signature")))
           .withColumn("weight", F.sum("held").over(Window.partitionBy("signature"))))
    alone = F.least(F.col("n"), F.lit(sketch_size(percent))) - F.col("_met")
    return saved(met.filter(F.col("_at") <= _prefix(F.col("n"), percent) - alone).select(
        "value", F.col("signature").alias("node"), "n", "weight"), "lists")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch leaves the threshold possible."""
    side = lambda x: classes.select(F.col("signature").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.array_union("s_a", "s_b")
    lowest = F.slice(F.array_sort(union), 1, sketch_size(percent))
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), lowest))
    whole = (F.col("n_a") <= sketch_size(percent)) & (F.col("n_b") <= sketch_size(percent))
    exact = F.size(F.array_intersect("s_a", "s_b")) * 100 >= F.size(union) * percent
    return both.filter(F.when(whole, exact).otherwise(shared >= least_shared(percent))).select("a", "b")


def _texts(docs: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """``text`` of one document of each class asked for (and of others that share its id)."""
    ids = saved(signatures.join(classes.select("signature", F.col("first_id").alias("_id")), "signature").select("_id"), "asked")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = _Hashes()
        for frame in frames:
            yield pd.DataFrame({"signature": [xxhash.xxh128_digest(shingle_hashes(t, width, words).tobytes()) for t in frame["text"]],
                                "text": frame["text"]})

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last = _Hashes(), (None, None)
        for frame in frames:
            kept = []
            for a, left, right in zip(frame["a"], frame["text_a"], frame["text_b"], strict=True):
                if last[0] != a:
                    last = (a, shingle_hashes(left, width, words))
                other = shingle_hashes(right, width, words)
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                kept.append(100 * shared >= percent * (len(last[1]) + len(other) - shared))
            yield frame.loc[np.array(kept, bool), ["a", "b"]]

    asked = pairs.select(F.explode(F.array("a", "b")).alias("signature")).distinct()
    texts = saved(_texts(docs, classes, asked).mapInPandas(sign, "signature binary, text string"), "texts")
    side = lambda x: texts.select(F.col("signature").alias(x), F.col("text").alias(f"text_{x}"))
    return saved(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(
        check, "a binary, b binary").distinct(), "links")


def _links_between(left: tuple, right: tuple, percent: int) -> list[tuple[bytes, bytes]]:
    """Enough links between two blocks (nodes, roots, sets) to join whatever any of their pairs joins."""
    (nodes, roots, sets), (others, other_roots, other_sets) = left, right
    flat, other_flat = np.concatenate(sets), np.concatenate(other_sets)
    values = np.intersect1d(flat, other_flat)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    columns = np.repeat(np.arange(len(other_sets)), [len(s) for s in other_sets])
    shared = np.zeros((len(sets), len(other_sets)), np.float32)
    for a in range(0, len(values), 4096):
        part = values[a:a + 4096]
        ones = []
        for source, at, n in ((flat, rows, len(sets)), (other_flat, columns, len(other_sets))):
            spot = np.minimum(np.searchsorted(part, source), len(part) - 1)
            hit = part[spot] == source
            ones.append(np.zeros((n, len(part)), np.float32))
            ones[-1][at[hit], spot[hit]] = 1
        shared += ones[0] @ ones[1].T
    sizes, other_sizes = np.array([len(s) for s in sets]), np.array([len(s) for s in other_sets])
    linked = np.argwhere(100 * shared.astype(np.int64) >= percent * (sizes[:, None] + other_sizes - shared.astype(np.int64)))
    top: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for i, j in linked:
        x, y = find(roots[i]), find(other_roots[j])
        if x != y:
            top[x] = y
            out.append((nodes[i], others[j]))
    return out


def _block_links(rows: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components among the members of open lists (``open_lists``), by whole sets, block against block.

    A class belongs to a block of about ``BLOCK`` classes of its largest list; two blocks meet if they share a list in which one of them has a member outside the
    largest component. Only links come out, at most one per component and block, and texts are read once.
    """
    home = rows.groupBy("node", "root").agg(F.max(F.struct("size", "value")).alias("home"), F.first("n").alias("n"))
    home = saved(home.select("node", "root", "n", F.col("home.value").alias("home")), "homes")
    room = saved(home.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / (BLOCK * 2048))).alias("blocks")), "rooms")
    slot = F.pmod(F.xxhash64("node"), F.col("blocks"))
    nodes = saved(home.join(room, "home").select("node", "root", F.xxhash64("home", slot).alias("block")), "nodes")
    met = saved(rows.select("value", "node", "outside").join(nodes.select("node", "block"), "node").groupBy("value", "block").agg(
        F.max("outside").alias("outside")), "met")
    left, right = (met.select("value", F.col("block").alias(f"block_{x}"), F.col("outside").alias(f"out_{x}")) for x in "ab")
    pairs = saved(left.join(right, "value").filter("block_a <= block_b and (out_a or out_b)").select("block_a", "block_b").distinct(), "block_pairs")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = _Hashes()
        for frame in frames:
            found = [shingle_hashes(t, width, words).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh128_digest(s) for s in found], "set": found}).drop_duplicates("node")

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        return pd.DataFrame([(frame["block"].iloc[0], list(frame["node"]), list(frame["root"]), list(frame["set"]))], columns=["block", "nodes", "roots", "sets"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                a, b = ((row[f"nodes_{x}"], row[f"roots_{x}"], [np.frombuffer(s, np.int64) for s in row[f"sets_{x}"]]) for x in "ab")
                yield pd.DataFrame(_links_between(a, b, percent), columns=["a", "b"])

    texts = _texts(docs, classes, nodes.select(F.col("node").alias("signature")))
    whole = texts.mapInPandas(sets, "node binary, set binary").join(nodes, "node")
    blocks = saved(whole.groupBy("block").applyInPandas(gather, "block long, nodes array<binary>, roots array<binary>, sets array<binary>"), "blocks")
    side = lambda x: blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns])
    return saved(pairs.join(side("a"), "block_a").join(side("b"), "block_b").mapInPandas(compare, "a binary, b binary").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked at a Jaccard similarity of ``percent`` or more between whole shingle sets; how many values sketches
    must share follows from it (``least_shared``). Equal sets form one
    class, of which one text is compared. Every list's head is compared with its members first; lists that this does not
    make one component are then compared whole, block against block, so no link between two components is missed. Null and empty texts and texts without words have no shingles and stay alone;
    repeated rows are copies of each other and all keep or lose together. A null doc_id is smaller than none.
    """
    rows = saved(signed(docs, width, sketch_size(percent)), "signed")
    some = rows.filter(F.col("signature").isNotNull())
    classes = saved(some.groupBy("signature").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"),
                                                  F.first("sketch").alias("sketch")), "classes")
    lists = _lists(classes, percent)
    near = lambda n, m: (n * 100 >= m * percent) & (m * 100 >= n * percent)
    links = _verified(saved(_close(star_pairs(lists, near), classes, percent), "close"), docs, classes, width, percent)
    rest = open_lists(lists, components(links))
    roots = components(links.unionByName(_block_links(rest, docs, classes, width, percent)))
    named = classes.select("signature", "first_id")
    named = named.join(roots.withColumnRenamed("node", "signature"), "signature", "left").withColumn("root", F.coalesce("root", "signature"))
    smallest = saved(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = named.join(smallest, "root").select("signature", "component_id")
    named = saved(named, "named")
    out = rows.select("doc_id", "n_shingles", "signature").join(named, "signature", "left")
    component = F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
