"""Ranked pools of devices and the slices recommendations are taken from.

A pool is the catalogue seen with one brand in mind ("" for none): popular
brands first, file order inside. Pools are ranked once, never per question.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.functions import device_key
from devicelode.operators.ordered import BUCKET_ROWS, dense_position

SLICE = 30
SHOWN = 5
_LATER = 1 << 40  # bucket offset of the brands that come behind the popular ones


def _pool_rows(cat: DataFrame, focuses: Sequence[str] | None, popular: Sequence[str]) -> DataFrame:
    """Catalogue rows, repeats dropped, once per pool they are in, with ``later`` and their bucket."""
    same = [c for c in cat.columns if c != "pos"]
    rows = cat.groupBy(*same).agg(F.min("pos").alias("pos"))
    if focuses is None:
        pools = F.array(F.lit(""))
    else:
        names = F.array(*[F.lit(n) for n in focuses])
        held = F.filter(names, lambda n: F.contains(F.lower("brand_name"), n))
        pools = F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))
    pooled = rows.withColumn("brand_focus", F.explode_outer(pools))
    # A pool whose brand is itself popular puts only that brand first.
    first = F.col("brand_name").isin(list(popular))
    for b in popular:
        first = F.when(F.col("brand_focus") == b.lower(), F.col("brand_name") == b).otherwise(first)
    return pooled.withColumn("later", F.when(first, 0).otherwise(1)).withColumn(
        "_in_pool", F.col("later") * _LATER + F.floor(F.col("pos") / BUCKET_ROWS))


def popular_first(cat: DataFrame, focuses: Sequence[str] | None = None,
                  popular: Sequence[str] = tuple(D.POPULAR_BRANDS)) -> DataFrame:
    """Every pool in order: ``(brand_focus, rank, pool_size, …catalogue)``.

    Without ``focuses`` there is the one pool of the whole catalogue.
    """
    rows = _pool_rows(cat, focuses, popular)
    ranked = dense_position(rows, ["later", "pos"], ["brand_focus"], "rank", "pool_size", F.col("_in_pool"))
    return ranked.select("brand_focus", "rank", "pool_size", *cat.columns)


def tier_of_rank(tier: str, rank: Column, size: Column, n: int = SLICE) -> Column:
    """Whether a rank is in the tier: the first ``n``, ``n`` from a third on, or the last ``n``."""
    third = F.floor(size / 3)
    return {
        "high_end": rank <= n,
        "mid_range": (rank > third) & (rank <= third + n),
        "budget": rank > size - n,
    }[tier]


def tier_slice(ranked: DataFrame, tier: str, n: int = SLICE) -> DataFrame:
    """The rows of one tier of ranked pools."""
    return ranked.filter(tier_of_rank(tier, F.col("rank"), F.col("pool_size"), n))


def tier_slices(cat: DataFrame, focuses: Sequence[str] | None = tuple(D.BRAND_NAMES),
                popular: Sequence[str] = tuple(D.POPULAR_BRANDS), n: int = SLICE) -> DataFrame:
    """The three tiers of every pool: ``(brand_focus, tier, rank, pool_size, …catalogue)``.

    Bucket counts tell where the slices lie, so only rows of those few buckets
    are ranked at all.
    """
    rows = _pool_rows(cat, focuses, popular)
    counts = rows.groupBy("brand_focus", "_in_pool").agg(F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy("brand_focus")
    earlier = whole.orderBy("_in_pool").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select(
        "brand_focus", "_in_pool", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("pool_size"))
    first, last, size = F.col("_before") + 1, F.col("_before") + F.col("_rows"), F.col("pool_size")
    third = F.floor(size / 3)
    touched = (first <= n) | ((last > third) & (first <= third + n)) | (last > size - n)
    inside = W.partitionBy("brand_focus", "_in_pool").orderBy("later", "pos")
    ranked = rows.join(placed.filter(touched), ["brand_focus", "_in_pool"]).withColumn(
        "rank", F.col("_before") + F.row_number().over(inside))
    tiers = F.array_compact(F.array(*[
        F.when(tier_of_rank(t, F.col("rank"), size, n), F.lit(t)) for t in D.TIERS]))
    return ranked.withColumn("tier", F.explode_outer(tiers)).filter("tier IS NOT NULL").select(
        "brand_focus", "tier", F.col("rank").cast("bigint").alias("rank"), "pool_size", *cat.columns)


def first_unique(slices: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` devices of each slice, each brand and name once; adds ``place``."""
    group = ["brand_focus", "tier"]
    named = slices.withColumn("_key", device_key("brand_name", "device_name"))
    once = named.withColumn("_n", F.row_number().over(W.partitionBy(*group, "_key").orderBy("rank"))).filter("_n = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("rank"))).filter(
        F.col("place") <= n).drop("_n", "_key")
