"""Exact top-k inner product search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devicelode.llm.common import mixed, saved, shuffle_parts, small_batches

BLOCK = "block int, ids binary, rows int, dims int, kind string, cells binary"
DIMS = 16  # dimensions accumulated between two compactions
BATCH = 256  # queries that share one pass over the candidates
SENT_BYTES = 32 << 20  # of query blocks sent to every executor at a time, counted before


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, vector`` of floor(scale * x) as integers; rows null or holding null or non-finite parts, or without id, are left out."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    cells = F.col("embedding").cast("array<double>")
    return vectors.filter(F.col("vec_id").isNotNull() & cells.isNotNull() & ~F.exists(cells, odd)).select(
        F.col("vec_id").cast("long"), F.transform(cells, lambda x: F.floor(scale * x)).alias("vector"))


def _blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """One row per block of about ``size`` vectors, held dimension by dimension in the smallest integer type that fits."""
    def column_major(frame: pd.DataFrame) -> pd.DataFrame:
        dims = max(map(len, frame["vector"]))
        cells = np.zeros((dims, len(frame)), np.int64)
        for j, v in enumerate(frame["vector"]):
            cells[:len(v), j] = v
        kind = np.promote_types(np.min_scalar_type(cells.min(initial=0)), np.min_scalar_type(cells.max(initial=0)))
        kind = np.dtype(np.int64) if kind.kind != "i" and kind.kind != "u" else kind
        return pd.DataFrame([(frame["block"].iloc[0], frame["vec_id"].to_numpy("<i8").tobytes(), len(frame), dims, kind.str,
                              cells.astype(kind).tobytes())], columns=["block", "ids", "rows", "dims", "kind", "cells"])

    blocks = max(1, -(-count // size))
    return rows.withColumn("block", F.pmod("_mix", F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(column_major, BLOCK)


def _matrix(row, side: str, dims: int) -> np.ndarray:
    cells = np.frombuffer(row[f"{side}_cells"], row[f"{side}_kind"]).reshape(row[f"{side}_dims"], row[f"{side}_rows"])
    return np.pad(cells, ((0, dims - len(cells)), (0, 0))).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _masses(cells: np.ndarray) -> np.ndarray:
    """Norm of what is left of each column from each dimension on; zero behind the last."""
    return np.sqrt(np.vstack([np.cumsum((cells[::-1].astype(float)) ** 2, axis=0)[::-1], np.zeros(cells.shape[1])]))


def bounded_search(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int):
    """(query id, vec ids, scores) of each query's ``k`` best of one block; columns are vectors, rows dimensions.

    Candidates stand by falling norm, and queries go through them in batches. A chunk's scores grow by ``DIMS`` dimensions at a time, by one
    matrix product for all queries of the batch; after each step those candidates whose score plus the largest product that their
    remaining mass allows (Cauchy-Schwarz) can reach no query's k-th best so far are compacted away. Scores
    beyond 64 bits are an error, found by the largest norms.
    """
    dims = len(cells)
    mass, query_mass = _masses(cells), _masses(queries)
    if mass[0].max(initial=0) * query_mass[0].max(initial=0) >= 2.0**63:
        raise OverflowError("inner products of these vectors may exceed 64 bits")
    exact = int(np.abs(queries).max(initial=0)) * int(np.abs(cells).max(initial=0)) * max(1, dims) < 2**53
    kind = np.float64 if exact else np.int64
    order = np.argsort(-mass[0], kind="stable")
    cells, ids, mass = np.ascontiguousarray(cells[:, order].astype(kind)), ids[order], mass[:, order] * (1 + 1e-9)
    edges = [(a, min(a + DIMS, dims)) for a in range(0, dims, DIMS)]
    chunks = [(0, min(512, len(ids)))] + [(a, min(a + 4096, len(ids))) for a in range(512, len(ids), 4096)]
    for first in range(0, len(query_ids), BATCH):
        own = query_ids[first:first + BATCH]
        q, qm = np.ascontiguousarray(queries[:, first:first + BATCH].T.astype(kind)), query_mass[:, first:first + BATCH]
        best = [(ids[:0], np.zeros(0, np.int64))] * len(own)
        floors = np.full(len(own), -np.inf)
        for a, b in chunks:
            if np.all(mass[0, a] * qm[0] < floors - 0.5):
                break  # every later candidate is shorter still
            alive, score = np.arange(a, b), np.zeros((len(own), b - a), kind)
            for low, high in edges:
                whole = len(alive) == b - a
                score += q[:, low:high] @ (cells[low:high, a:b] if whole else cells[low:high, alive])
                if high < dims and np.isfinite(floors).all():
                    keep = (score + qm[high][:, None] * mass[high, alive] >= floors[:, None] - 0.5).any(axis=0)
                    if keep.sum() < 0.9 * len(alive):
                        alive, score = alive[keep], score[:, keep]
            found = ids[alive]
            for j in np.flatnonzero((score >= floors[:, None]).any(axis=1)):
                hits = np.flatnonzero((score[j] >= floors[j]) & (found != own[j]))
                if len(hits) > k:
                    cut = np.partition(score[j, hits], len(hits) - k)[len(hits) - k]
                    hits = hits[score[j, hits] >= cut]
                best[j] = _best(np.concatenate([best[j][0], found[hits]]), np.concatenate([best[j][1], score[j, hits].astype(np.int64)]), k)
                if len(best[j][1]) == k:
                    floors[j] = best[j][1][-1]
        yield from ((query_id, *b) for query_id, b in zip(own, best, strict=True))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, candidate_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query``, the ``k`` others of largest inner product.

    ``rows``: vec_id long, vector array of integers; shorter vectors count as padded with zeros. Ties go to the smaller vec_id; rows that share
    the query's id are the query's own. Products that may exceed 64 bits are an error. Each pair of a query block and a candidate block is one unit of work of bounded
    size. Query blocks are sent to every executor as they are, at most ``SENT_BYTES`` of them at a time, and candidate blocks are dealt to tasks: once
    each where they are enough for all tasks, else once for each of a few parts of the queries. A query's best rows per block are then merged.
    """
    rows = saved(small_batches(rows).select("vec_id", "vector", mixed().alias("_mix")), "vectors")
    asked = rows.filter(is_query)
    n, m = rows.count(), asked.count()
    left = saved(_blocks(rows, candidate_block, n), "candidates")
    right = saved(_blocks(asked, query_block, m), "queries")
    c_blocks, q_blocks, tasks = max(1, -(-n // candidate_block)), max(1, -(-m // query_block)), shuffle_parts(rows.sparkSession)
    parts = min(q_blocks, -(-tasks // c_blocks))
    rename = lambda df, side: df.select(F.col("block").alias(f"{side}_block"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns[1:]])
    left = rename(left, "c").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(min(c_blocks * parts, 4 * tasks))
    right = rename(right, "q").withColumn("part", F.col("q_block") % parts)
    largest = right.agg(F.max(F.length("q_ids") + F.length("q_cells"))).first()[0] or 1
    sent = max(1, SENT_BYTES // largest)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                dims = max(row["c_dims"], row["q_dims"])
                found = bounded_search(_matrix(row, "q", dims), np.frombuffer(row["q_ids"], "<i8"), _matrix(row, "c", dims),
                                       np.frombuffer(row["c_ids"], "<i8"), k)
                query_ids, ids, scores = zip(*found, strict=True)
                yield pd.DataFrame({"query_id": np.repeat(query_ids, [len(x) for x in ids]), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(best: DataFrame) -> DataFrame:
        return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def met(first: int) -> DataFrame:
        some = F.broadcast(right.filter((F.col("q_block") >= first) & (F.col("q_block") < first + sent)))
        return ranked(left.join(some, "part").mapInPandas(search, "query_id long, vec_id long, score long"))

    if q_blocks <= sent:
        return met(0)
    # Written one after the other, so that the driver holds one at a time; an id's rows may be in more than one.
    return ranked(reduce(DataFrame.unionByName, [saved(met(first), "best") for first in range(0, q_blocks, sent)]))
