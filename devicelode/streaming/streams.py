"""Structured Streaming forms of the log and refresh operators.

The queries are those of the batch operators; what is added here is event time,
and a sink whose batches can be written twice without harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from devicelode.operators import usage
from devicelode.operators.ordered import first_per_key
from devicelode.plans.refreshing import refresh
from devicelode.sources.keyed import batch_folders


def event_time(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less times as timestamps (of a UTC session), which watermarks need."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def usage_stream(log: DataFrame, key: str = "key") -> DataFrame:
    """Live use count and last use per key."""
    return usage.usage_totals(event_time(log), key)


def rate_audit_stream(log: DataFrame, window: str = "1 minute", limit: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Refused requests per client, route and fixed window; closed windows leave the state."""
    return usage.rate_audit(event_time(log).withWatermark("ts", delay), window, limit)


def latest_status_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    return usage.latest_status(event_time(events), keys)


def dedupe_stream(df: DataFrame, key: str = "device_url", delay: str = "1 hour") -> DataFrame:
    """The first row of each key, without a table to hold it against: keys are forgotten after the delay. See ``start_dedupe``."""
    return event_time(df).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def fold_status_stream(events: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """The status of each key, every event overwriting the fields it carries.

    Only the newest value of each field is kept as state, by a built-in
    aggregate.
    """
    return usage.status_now(event_time(events), fields, keys)


def start_keyed(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the changed rows of every batch to its own folder.

    A batch that runs again after a failure overwrites its folder. Read with
    ``latest_table``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table written by ``start_keyed``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_s"))
    return newest.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def start_dedupe(stream: DataFrame, path: str, checkpoint: str, key: str = "device_url", order: str = "ts", once: bool = True) -> StreamingQuery:
    """Append the first row of each key that the table under ``path`` doesn't hold yet, however long ago it came.

    Of one batch the row of the smallest ``order`` counts, and a later batch never replaces it. Each batch is held against the
    keys of all batches before it, of which only those of the batch are looked for, and writes its own folder, so that a batch run again
    writes the same. Read with ``first_rows``.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        firsts = first_per_key(batch, [key], order, batch.columns)
        known = [b for b in batch_folders(spark, path) if b < batch_id]
        if known:
            earlier = spark.read.schema(batch.schema).parquet(*[f"{path}/batch_id={b}" for b in known]).select(key)
            firsts = firsts.join(earlier, firsts[key].eqNullSafe(earlier[key]), "left_anti")
        firsts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table written by ``start_dedupe``: one row for each key."""
    return spark.read.parquet(path).drop("batch_id")


def ingest_stream(listing: DataFrame, pages: DataFrame, root: str, checkpoint: str, now: str, once: bool = True, **options) -> StreamingQuery:
    """Refresh the tables under ``root`` with each batch of listed devices; ``options`` are those of ``refresh``.

    ``pages`` is the table of stored specification pages. A batch that is run
    again finds its devices known and tracked, and changes nothing.
    """
    spark = listing.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        # The batch is read several times by the refresh.
        kept = batch.persist()
        try:
            refresh(spark, kept, pages, root, now, batch=batch_id, **options)
        finally:
            kept.unpersist()

    writer = listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()
