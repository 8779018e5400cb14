"""Ordered rules without one big sort: ranks and look-backs by bucket.

A plain window puts a whole group into one task. Here the order column is cut
into buckets, rows are numbered inside a bucket only, and each bucket adds the
row count of those before it. The results are the same as those of the plain
window; the largest piece of work is one bucket, however large the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from devicelode.session import checkpointed, unsent

BUCKET_ROWS = 100_000
# Pieces that a bucket of too many rows is cut into.
PIECES = 256
# Bucket tables of up to this many rows are sent to every executor.
BROADCAST_BUCKETS = 200_000


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_key``, all keys in one value that is never NULL: joins on it and windows over it share one shuffle."""
    return df.withColumn("_key", F.struct(*keys) if keys else F.lit(0))


def _with_null(bucket: Column) -> Column:
    """Rows without an order value are the first bucket, as they come first in a window."""
    return F.coalesce(bucket.cast("bigint"), F.lit(-(2**63)))


def bucket_of(order: str, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of an integer order column: at most ``rows`` rows when its values are unique."""
    return F.floor(F.col(order) / rows)


def time_bucket(ts: str, seconds: int = 60) -> Column:
    """Bucket of a timestamp; choose a span whose rows for one key fit one task."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _few(df: DataFrame) -> DataFrame:
    """A kept table, with a hint to broadcast it where its counted rows are few."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_BUCKETS else kept


def even_buckets(df: DataFrame, keys: Sequence[str], ts: str, event_id: str, seconds: int) -> DataFrame:
    """Add ``_bucket``, spans of time that are cut further where one key has more than ``BUCKET_ROWS`` rows in one.

    A row of such a span has a place, the microseconds since the span's first row and, as a fraction, its id among the ids there: one number
    that grows with (time, id), so even the rows of one instant can be told apart. Quantiles of the places of each such
    span cut it into ``PIECES`` pieces of about the same number of rows. Only the spans' quantiles are kept and sent round.
    """
    spans = _keyed(df, keys).withColumn("_span", _with_null(time_bucket(ts, seconds)))
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0))
    number = F.col(event_id).cast("double")
    crowded = _few(spans.groupBy("_key", "_span").agg(
        F.count(F.lit(1)).alias("_n"), F.min(micros).alias("_t0"), F.min(number).alias("_i0"), F.max(number).alias("_i1"))
        .filter(F.col("_n") > BUCKET_ROWS).drop("_n"))
    if crowded.isEmpty():
        return spans.withColumn("_bucket", F.struct(F.col("_span"), F.lit(0).alias("_piece"))).drop("_span")
    place = (micros - F.col("_t0")) + F.coalesce((number - F.col("_i0")) / (F.col("_i1") - F.col("_i0") + 1), F.lit(0.0))
    cuts = F.percentile_approx(place, [k / PIECES for k in range(1, PIECES)], 10_000)
    # Kept, since quantiles may come out otherwise when they are worked out again.
    bounds = _few(spans.join(crowded, ["_key", "_span"]).groupBy("_key", "_span", "_t0", "_i0", "_i1").agg(cuts.alias("_cuts")))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    told = spans.join(bounds, ["_key", "_span"], "left").withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece))
    return told.withColumn("_bucket", F.struct("_span", "_piece")).drop("_span", "_piece", "_cuts", "_t0", "_i0", "_i1")


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """The frame with its buckets, unless ``even_buckets`` has put them there."""
    return df if "_bucket" in df.columns else _keyed(df, keys).withColumn("_bucket", _with_null(bucket))


def dense_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    out: str = "rank",
    total: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Number rows 1, 2, 3 … by ``order`` inside ``keys``; optionally add the group's size.

    ``bucket`` must not decrease along the order; a frame of ``even_buckets`` brings its own. Ties in ``order`` must have
    been broken by its last column. Rows are shuffled once, by key and bucket; only counts are shuffled beside them.
    """
    bucketed = _bucketed(df, keys, bucket if bucket is not None else bucket_of(order[0]))
    sizes = bucketed.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cols = ["_key", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")]
    if total:
        cols.append(F.sum("_rows").over(W.partitionBy("_key")).alias(total))
    inside = W.partitionBy("_key", "_bucket").orderBy(*order)
    numbered = bucketed.join(sizes.select(*cols), ["_key", "_bucket"]).withColumn(
        out, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    return numbered.drop("_key", "_bucket", "_before")


def running_last(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str],
    bucket: Column | None = None,
) -> DataFrame:
    """Replace each of ``columns`` by its last non-null value up to the row. Rows are shuffled once, by key and bucket."""
    bucketed = _bucketed(df, keys, bucket if bucket is not None else bucket_of(order[0]))
    place = F.struct(*order)
    closing = bucketed.groupBy("_key", "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_c_{c}") for c in columns])
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = closing.select(
        "_key", "_bucket",
        *[F.last(f"_c_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns])
    inside = W.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    folded = bucketed.join(carried, ["_key", "_bucket"]).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in columns})
    return folded.select(*[c for c in df.columns if c not in ("_key", "_bucket")])


def look_back(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    keys: Sequence[str],
    n: int,
    out: str,
    bucket: Column | None = None,
    chunk_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """List of ``value`` over the row and up to ``n - 1`` rows before it.

    Groups of more than ``chunk_rows`` rows are cut into chunks of whole buckets. The buckets that hold one of the last
    ``n - 1`` rows in front of a chunk are also handed to that chunk, which shows them to its first rows and then lets them go. Which
    bucket goes where follows from the buckets' counts, so that rows are shuffled once, by group and chunk.
    """
    placed = _keyed(df, keys).withColumn("_bucket", _with_null(bucket if bucket is not None else bucket_of(order[0])))
    sizes = placed.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = sizes.withColumn("_all", F.sum("_rows").over(W.partitionBy("_key"))).filter(F.col("_all") > chunk_rows)
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cut = whole.withColumn("_from", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn("_chunk", F.floor(F.col("_from") / chunk_rows))
    starts = cut.groupBy("_key", "_chunk").agg(F.min("_from").alias("_start"))
    later = W.partitionBy("_key").orderBy("_chunk").rowsBetween(1, max(1, n - 1))
    follow = starts.select("_key", "_chunk", F.collect_list(F.struct(F.col("_chunk").alias("chunk"), F.col("_start").alias("start"))).over(later).alias("_next"))
    shown = F.filter("_next", lambda c: c["start"] - (F.col("_from") + F.col("_rows")) < n - 1)
    dealt = _few(cut.join(follow, ["_key", "_chunk"]).select("_key", "_bucket", "_chunk", F.transform(shown, lambda c: c["chunk"]).alias("_also")))
    own = F.coalesce("_chunk", F.lit(0).cast("bigint"))
    places = F.concat(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("copy"))),
                      F.transform(F.coalesce("_also", F.array().cast("array<bigint>")), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("copy"))))
    copies = placed.join(dealt, ["_key", "_bucket"], "left").withColumn("_place", F.explode(places)).withColumn("_piece", F.col("_place.chunk"))
    frame = W.partitionBy("_key", "_piece").orderBy(*order).rowsBetween(-(n - 1), 0)
    return (
        copies.withColumn(out, F.collect_list(value).over(frame))
        .filter(~F.col("_place.copy"))
        .drop("_key", "_bucket", "_chunk", "_also", "_place", "_piece")
    )


def one_per_key(df: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str], last: bool = False) -> DataFrame:
    """The first row of each key by ``order``, or the last; NULL comes first. Of rows equal in key and order one, of rows equal in all one.

    A hash aggregate over numbers alone, combined before the shuffle, finds for each key the hash of the row to take. Whole rows
    then meet the hashes by key and hash, so that a key that holds most rows is many small pieces of work; they
    are shuffled once and never sorted for an aggregate.
    """
    rows = _keyed(df.select(*keep, *([] if order in keep else [F.col(order)])), keys).withColumn("_tie", F.xxhash64(*keep))
    unplaced = F.min(F.when(F.col(order).isNull(), F.col("_tie")))
    taken = F.coalesce(F.max_by("_tie", order), unplaced) if last else F.coalesce(unplaced, F.min_by("_tie", order))
    wanted = rows.groupBy("_key").agg(taken.alias("_tie"))
    only = F.row_number().over(W.partitionBy("_key", "_tie").orderBy("_tie"))
    return rows.join(unsent(wanted), ["_key", "_tie"], "left_semi").withColumn("_n", only).filter("_n = 1").select(*keep)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; see ``one_per_key``."""
    return one_per_key(df, keys, order, keep)


def within_rows(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows."""
    return df.count() <= limit
