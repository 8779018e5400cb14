"""Access keys, request logs, status events; batch and streaming."""

from pyspark.sql import functions as F

from devicelode.functions import tier_limit, valid_tier
from devicelode.operators import usage as U
from devicelode.session import scratch_path
from devicelode.operators.ordered import first_per_key
from devicelode.sources.keyed import create_keyed, read_keyed
from devicelode.streaming import streams as S
from wiring import page_queries
from wiring import tables as T
from wiring.registry import ctes, query


def _keys(spark, d):
    return T.table(spark, d, "customer").select(
        F.col("c_name").alias("access_key"), valid_tier(F.lower("c_mktsegment")).alias("tier0"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("premium")).when(F.col("c_mktsegment") != "MACHINERY", F.lit("basic")).otherwise(
            F.lit("trial")).alias("tier"), F.abs("c_acctbal").cast("bigint").alias("usage_count"))


@query("G3_usage_summary", """
SELECT count(*) AS total_keys, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS basic_keys,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS premium_keys, CAST(sum(CAST(trunc(abs(c_acctbal)) AS BIGINT)) AS BIGINT) AS total_requests FROM customer""")
def usage_summary(spark, d):
    return U.usage_summary(_keys(spark, d))


@query("W10_usage_running", ctes(T.LOG) + """
SELECT event_id, key, count(*) OVER (PARTITION BY key ORDER BY ts, event_id) AS usage_count, max(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS last_used FROM log""")
def usage_running(spark, d):
    return U.usage_running(T.access_log(spark, d)).select("event_id", "key", "usage_count", "last_used")


@query("M1_usage_totals", ctes(T.LOG) + "SELECT key, count(*) AS usage_count, max(ts) AS last_used FROM log GROUP BY key")
def usage_totals(spark, d):
    return U.usage_totals(T.access_log(spark, d))


AUDIT = """SELECT client, route, time_bucket({w}, ts) AS window_start, count(*) AS requests, {allowed} AS allowed,
  greatest(count(*) - {allowed}, 0) AS refused FROM log GROUP BY 1, 2, 3"""


@query("M2_rate_audit_minute", ctes(T.LOG) + AUDIT.format(
    w="INTERVAL 1 MINUTE", allowed="CAST(CASE WHEN any_value(tier) = 'premium' THEN 300 ELSE 60 END AS BIGINT)"))
def rate_audit_minute(spark, d):
    return U.rate_audit(T.access_log(spark, d))


@query("M2_rate_audit_day", ctes(T.LOG) + AUDIT.format(w="INTERVAL 1 DAY", allowed="CAST(1 AS BIGINT)"))
def rate_audit_day(spark, d):
    """A limit low enough to be passed often."""
    return U.rate_audit(T.access_log(spark, d), "1 day", limit=1)


@query("M3_latest_status", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def latest_status(spark, d):
    e = T.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return U.latest_status(e, ["user_id"])


FOLD = """SELECT event_id, user_id, coalesce(last_value(message IGNORE NULLS) OVER w, '-') AS message,
  coalesce(last_value(progress IGNORE NULLS) OVER w, -1.0) AS progress, coalesce(last_value(devices_processed IGNORE NULLS) OVER w, -1) AS devices_processed
FROM status WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FIELDS = ["message", "progress", "devices_processed"]


def _filled(df, *cols):
    return df.select(*cols, F.coalesce("message", F.lit("-")).alias("message"), F.coalesce("progress", F.lit(-1.0)).alias("progress"),
                     F.coalesce("devices_processed", F.lit(-1)).cast("bigint").alias("devices_processed"))


@query("M6_fold_status", ctes(T.STATUS) + FOLD)
def fold_status(spark, d):
    return _filled(U.fold_status(T.status_events(spark, d), FIELDS, ["user_id"]), "event_id", "user_id")


# ---- streams ------------------------------------------------------------------------

def _event_stream(spark, d):
    """The events as a stream, be the table one file or a folder of them."""
    return spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _run(spark, stream, keys):
    out, ckpt = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    S.start_keyed(stream, out, ckpt).awaitTermination()
    return S.latest_table(spark, out, keys)


@query("M1_usage_stream", ctes(T.LOG) + "SELECT key, count(*) AS usage_count, max(ts) AS last_used FROM log GROUP BY key")
def usage_stream(spark, d):
    log = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("key"), "ts")
    return _run(spark, S.usage_stream(log), ["key"])


@query("M2_rate_audit_stream", ctes(T.LOG) + AUDIT.format(w="INTERVAL 1 DAY", allowed="CAST(1 AS BIGINT)"))
def rate_audit_stream(spark, d):
    log = _event_stream(spark, d).select("ts", F.col("user_id").alias("client"), F.col("event_type").alias("route"), F.lit("basic").alias("tier"))
    return _run(spark, S.rate_audit_stream(log, "1 day", limit=1), ["client", "route", "window_start"])


@query("M3_latest_status_stream", """
SELECT event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY event_type""")
def latest_status_stream(spark, d):
    return _run(spark, S.latest_status_stream(_event_stream(spark, d).select("event_type", "event_id", "ts"), ["event_type"]), ["event_type"])


FIRST_EVENTS = "SELECT user_id AS device_url, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id"


@query("M5_dedupe_batch", FIRST_EVENTS)
def dedupe_batch(spark, d):
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("device_url"), "event_id", "ts", F.struct("ts", "event_id").alias("place"))
    return first_per_key(rows, ["device_url"], "place", ["device_url", "event_id", "ts"])


@query("M5_dedupe_stream", FIRST_EVENTS)
def dedupe_stream(spark, d):
    """Events in four batches by time, written one after the other; most users come back in later batches."""
    rows = T.table(spark, d, "events").select(F.col("user_id").alias("device_url"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.struct("ts", "event_id").alias("place"))
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "stream", "stream-state"))
    at = F.unix_micros("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    quarter = F.least(F.floor((at - low) * 4 / max(1, high - low)), F.lit(3))
    for k in range(4):
        rows.filter(quarter == k).coalesce(1).write.mode("append").parquet(inbox)
        S.start_dedupe(spark.readStream.schema(rows.schema).parquet(inbox), out, state, order="place").awaitTermination()
    firsts = S.first_rows(spark, out)
    return firsts.select("device_url", "event_id", F.col("ts").cast(T.table(spark, d, "events").schema["ts"].dataType).alias("ts"))


@query("M6_fold_status_stream", ctes(T.STATUS) + """
SELECT user_id, coalesce(max_by(message, ts) FILTER (WHERE message IS NOT NULL), '-') AS message,
       coalesce(max_by(progress, ts) FILTER (WHERE progress IS NOT NULL), -1.0) AS progress,
       coalesce(max_by(devices_processed, ts) FILTER (WHERE devices_processed IS NOT NULL), -1) AS devices_processed FROM status GROUP BY user_id""")
def fold_status_stream(spark, d):
    e = _event_stream(spark, d).select(
        "event_id", "ts", "user_id", F.when(F.col("event_type") == "view", F.concat(F.lit("seen "), "event_id")).alias("message"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("progress"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("devices_processed"))
    return _filled(_run(spark, S.fold_status_stream(e, FIELDS, ["user_id"]), ["user_id"]), "user_id")


@query("M4_ingest_stream", f"""
SELECT 'specs' AS kind, '{T.BASE}' || replace(p_name, ' ', '_') || '-' || p_partkey || '.php' AS device_url,
       CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN 'old' ELSE p_name || ' & ' || p_partkey END AS name,
       CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN '[]' ELSE '["' || array_to_string({page_queries.PICTURES}, '","') || '"]' END AS value FROM part
UNION ALL SELECT 'ledger', '{T.BASE}' || replace(p_name, ' ', '_') || '-' || p_partkey || '.php',
       CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN '2024-01-01' ELSE '2025-05-01' END, brand_name FROM part JOIN named ON pos = p_partkey
UNION ALL SELECT 'catalogue', device_url, device_name, brand_name FROM named
UNION ALL SELECT 'report', '', CAST(count(*) FILTER (WHERE p_partkey % 4 = 0) AS VARCHAR), CAST(count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0) AS VARCHAR) FROM part""".replace(
    "\nSELECT 'specs'", ctes(T.CAT, T.NAMED) + "SELECT 'specs'", 1))
def ingest_stream(spark, d):
    """Listings arrive as a stream; a quarter of the devices is new, a third is tracked already. All three tables and the reports are compared."""
    cat = T.named_catalogue(spark, d)
    root, inbox = scratch_path(spark, "tables"), scratch_path(spark, "inbox")
    old = cat.filter("pos % 4 <> 0")
    specs = old.select("device_url", F.lit("old").alias("name"), F.lit("[]").alias("pictures"), F.lit("{}").alias("specifications"))
    ledger = old.filter("pos % 3 = 0").select("device_url", F.lit("2024-01-01").cast("timestamp").alias("last_updated"), F.col("brand_name").alias("brand"))
    for name, df in (("catalogue", old), ("specs", specs), ("ledger", ledger)):
        create_keyed(df, f"{root}/{name}", buckets=8)
    cat.repartition(2, "pos").write.parquet(inbox)
    listing = spark.readStream.schema(cat.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    S.ingest_stream(listing, page_queries.spec_pages(spark, d), root, scratch_path(spark, "stream-state"), "2025-05-01",
                    galleries=page_queries.gallery_pages(spark, d), base_url=T.BASE).awaitTermination()
    kind = lambda k: F.lit(k).alias("kind")
    counts = spark.read.parquet(f"{root}/reports").agg(F.sum("new_devices").cast("string").alias("name"), F.sum("updated_devices").cast("string").alias("value"))
    return (read_keyed(spark, f"{root}/specs").select(kind("specs"), "device_url", "name", F.col("pictures").alias("value"))
            .unionByName(read_keyed(spark, f"{root}/ledger").select(kind("ledger"), "device_url", F.date_format("last_updated", "yyyy-MM-dd").alias("name"), F.col("brand").alias("value")))
            .unionByName(read_keyed(spark, f"{root}/catalogue").select(kind("catalogue"), "device_url", F.col("device_name").alias("name"), F.col("brand_name").alias("value")))
            .unionByName(counts.select(kind("report"), F.lit("").alias("device_url"), "name", "value")))


@query("S15_tiers", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'premium' ELSE 'basic' END AS tier, CAST(CASE WHEN c_custkey % 3 = 0 THEN 300 ELSE 60 END AS BIGINT) AS per_minute FROM customer""")
def tiers(spark, d):
    k = F.col("c_custkey")
    given = F.when(k % 3 == 0, F.lit("premium")).when(k % 3 == 1, F.lit("gold"))
    c = T.table(spark, d, "customer").select("c_custkey", valid_tier(given).alias("tier"))
    return c.withColumn("per_minute", tier_limit("tier").cast("bigint"))
