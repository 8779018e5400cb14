"""Access keys, request logs and progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.functions import percent, tier_limit
from devicelode.functions.text import TIER_LIMITS
from devicelode.operators.ordered import dense_position, even_buckets, running_last

# Limits for clients without a tier: name -> (requests, window). Fixed values.
DEFAULT_LIMITS = {"day": (200, "1 day"), "hour": (50, "1 hour")}


def usage_summary(keys: DataFrame) -> DataFrame:
    """One row: keys, keys of each known tier (0 when there are none), requests."""
    return keys.agg(
        F.count(F.lit(1)).alias("total_keys"),
        *[F.count_if(F.col("tier") == t).alias(f"{t}_keys") for t in TIER_LIMITS],
        F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("total_requests"),
    )


def usage_totals(log: DataFrame, key: str = "key") -> DataFrame:
    """Requests and last use per key; the same query runs on a stream."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("usage_count"), F.max("ts").alias("last_used"))


def usage_running(log: DataFrame, key: str = "key", event_id: str = "event_id", bucket_seconds: int = 60) -> DataFrame:
    """Use count and last use of the key as they stood after each request."""
    counted = dense_position(even_buckets(log, [key], "ts", event_id, bucket_seconds), ["ts", event_id], [key], out="usage_count")
    return counted.withColumn("last_used", F.col("ts"))


def rate_audit(log: DataFrame, window: str = "1 minute", limit: int | None = None) -> DataFrame:
    """Requests and refused requests per client, route and fixed window.

    ``log`` has ``(ts, client, route, tier)``. The limit is that of the tier
    unless one is given. In a fixed window every request past the limit is
    refused, so counting is enough and rows are combined before the shuffle.
    Works on a batch and, after ``withWatermark``, on a stream.
    """
    allowed = F.lit(limit) if limit is not None else tier_limit("tier")
    counted = log.withColumn("allowed", allowed).groupBy(
        "client", "route", F.window("ts", window).alias("w")
    ).agg(F.count(F.lit(1)).alias("requests"), F.max("allowed").cast("bigint").alias("allowed"))
    return counted.select(
        "client", "route", F.col("w.start").alias("window_start"), "requests", "allowed",
        F.greatest(F.col("requests") - F.col("allowed"), F.lit(0)).cast("bigint").alias("refused"))


def latest_status(events: DataFrame, keys: list[str], ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Newest event of each key; of equal times the first that came."""
    rest = F.struct(*[c for c in events.columns if c not in keys])
    order = F.struct(F.col(ts), -F.col(event_id))
    newest = events.groupBy(*keys).agg(F.max_by(rest, order).alias("s"))
    return newest.select(*keys, "s.*")


def fold_status(events: DataFrame, fields: list[str], keys: list[str], ts: str = "ts",
                event_id: str = "event_id", bucket_seconds: int = 3600) -> DataFrame:
    """The status as it stood after each event: an event overwrites the fields it carries."""
    return running_last(even_buckets(events, keys, ts, event_id, bucket_seconds), fields, [ts, event_id], keys)


def status_now(events: DataFrame, fields: list[str], keys: list[str], ts: str = "ts",
               event_id: str = "event_id") -> DataFrame:
    """The folded status at the end; also runs on a stream."""
    order = F.struct(ts, event_id)
    return events.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields])


def progress(log: DataFrame, brands: DataFrame, order: str = "pos") -> DataFrame:
    """Progress after each item: within its brand, and over all brands.

    ``log`` has ``(pos, brand_name)`` in the order of work, ``brands`` has
    ``(name, device_count)``; the running total is held against the sum of the
    expected counts.
    """
    expected = brands.agg(F.coalesce(F.sum("device_count"), F.lit(0)).cast("bigint")).scalar()
    inside = dense_position(log, [order], ["brand_name"], out="brand_item", total="brand_items")
    overall = dense_position(inside, [order], out="devices_processed")
    return overall.withColumns({
        "current_brand_progress": percent("brand_item", "brand_items"),
        "progress": percent(F.col("devices_processed"), expected),
    })
