"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import mixed, ranked, saved


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: the two partial partitions of largest spread are joined, oppositely ordered, until one is left."""
    if not sizes:
        return []
    heap, parts = [], []
    for i, size in enumerate(sizes):
        parts.append(([0] * (shards - 1) + [size], list(range(shards)), None))
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        loads = [x + y for x, y in zip(parts[a][0], reversed(parts[b][0]), strict=True)]
        order = sorted(range(shards), key=loads.__getitem__)
        low = loads[order[0]]
        # Only differences matter: the common load is taken off so that the numbers stay small.
        parts.append(([loads[i] - low for i in order], order, (a, b)))
        heapq.heappush(heap, (low - loads[order[-1]], len(parts) - 1))
        parts[a], parts[b] = (None, *parts[a][1:]), (None, *parts[b][1:])
    out, todo = [0] * len(sizes), [(heap[0][1], list(range(shards)))]
    while todo:
        node, shard_of = todo.pop()  # shard_of[k]: shard of the node's k-th smallest load
        _, order, children = parts[node]
        if children is None:
            out[node] = shard_of[shards - 1]
            continue
        place = [0] * shards
        for k, i in enumerate(order):
            place[i] = shard_of[k]
        todo += [(children[0], place), (children[1], place[::-1])]
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, items_per_shard: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document; equal texts stay together.

    A group of equal texts of at least 1/``items_per_shard`` of a shard is an item of its own, of which there can be at
    most ``shards * items_per_shard``; smaller groups are bundled by hash into as many items. So differencing works on a
    bounded list, whatever the input, and both lists sent to the executors are bounded too. One group that is larger
    than a shard's share fills its shard alone. Null texts have no bytes and form a group with the empty ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = saved(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                             F.unhex(F.sha2(text, 256)).alias("_group"), mixed().alias("_mix")), "sizes")
    spark, most = docs.sparkSession, shards * items_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("_group"), F.lit(most)).cast("int").alias("bundle")
    groups = saved(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    own = groups.filter(F.col("bytes") * most >= total)
    large = own.select("_group", "bytes").collect()
    small = groups.filter(F.col("bytes") * most < total).groupBy(bundle).agg(F.sum("bytes").alias("bytes")).collect()
    where = differencing([r["bytes"] for r in (*large, *small)], shards)
    mine = spark.createDataFrame([(r["_group"], s) for r, s in zip(large, where, strict=False)], "_group binary, _own int")
    theirs = spark.createDataFrame([(r["bundle"], s) for r, s in zip(small, where[len(large):], strict=True)], "bundle int, _their int")
    dealt = (rows.join(F.broadcast(mine), "_group", "left").withColumn("bundle", bundle).join(F.broadcast(theirs), "bundle", "left")
             .withColumn("shard", F.coalesce("_own", "_their")).drop("bundle", "_own", "_their", "_group"))
    counts = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    return ranked(dealt, "shard", [F.col("doc_id"), F.col("_mix")], counts, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
