"""Keeping tables up to date."""

from pyspark.sql import functions as F

from devicelode.operators import catalog as C
from devicelode.operators import refresh as R
from devicelode.operators import usage as U
from wiring import tables as T
from wiring.registry import ctes, query


def _line_specs(spark, d):
    """Several specification rows per device: one per line item."""
    return T.table(spark, d, "lineitem").select(
        F.concat(F.lit("u"), "l_partkey").alias("device_url"), F.col("l_orderkey").alias("spec_id"),
        F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_returnflag").alias("flag"))


def _urls(cat):
    return cat.withColumn("device_url", F.concat(F.lit("u"), "pos"))


@query("J1_unify", """
SELECT p_partkey AS pos, 'u' || p_partkey AS device_url, CAST(l_orderkey AS VARCHAR) AS spec_id, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_partkey % 3 <> 0) ON l_partkey = p_partkey""")
def unify(spark, d):
    """A third of the devices have no specification."""
    specs = _line_specs(spark, d).join(
        T.table(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("u"), "p_partkey").alias("device_url")),
        "device_url", "left_semi").withColumns({c: F.col(c).cast("string") for c in ("spec_id", "line")})
    return R.unify(_urls(T.catalogue(spark, d)).select("pos", "device_url"), specs)


@query("J1_unify_dedupe", """
SELECT p_partkey AS pos, 'u' || p_partkey AS device_url, min(l_orderkey * 10 + l_linenumber) AS place
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""")
def unify_dedupe(spark, d):
    specs = _line_specs(spark, d).select("device_url", (F.col("spec_id") * 10 + F.col("line")).alias("place"))
    return R.unify(_urls(T.catalogue(spark, d)).select("pos", "device_url"), specs, dedupe=True, order="place")


def _three(spark, d):
    """Catalogue without every fourth device, ledger with every third."""
    listing = _urls(T.catalogue(spark, d)).select("pos", "device_url")
    return listing, listing.filter("pos % 4 <> 0"), listing.filter("pos % 3 = 0")


@query("J2_new_devices", "SELECT p_partkey AS pos, 'u' || p_partkey AS device_url FROM part WHERE p_partkey % 4 = 0")
def new_devices(spark, d):
    listing, cat, _ = _three(spark, d)
    return R.new_devices(listing, cat)


@query("J3_untracked_devices", """
SELECT p_partkey AS pos, 'u' || p_partkey AS device_url FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0""")
def untracked_devices(spark, d):
    return R.untracked_devices(*_three(spark, d))


@query("J4_upsert", """
SELECT 'u' || p_partkey AS device_url, coalesce(v, 'old') AS state, coalesce(m, p_size) AS amount
FROM (SELECT * FROM part WHERE p_partkey % 4 <> 0 OR p_partkey IN (SELECT l_partkey FROM lineitem)) LEFT JOIN (
  SELECT l_partkey, 'new' AS v, max(l_orderkey * 10 + l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def upsert(spark, d):
    """Every line item is an update of its device, the last one counts."""
    target = T.table(spark, d, "part").filter("p_partkey % 4 <> 0").select(
        F.concat(F.lit("u"), "p_partkey").alias("device_url"), F.lit("old").alias("state"), F.col("p_size").cast("bigint").alias("amount"))
    updates = _line_specs(spark, d).select(
        "device_url", F.lit("new").alias("state"), (F.col("spec_id") * 10 + F.col("line")).alias("amount"))
    return R.upsert(target, updates, order="amount")


@query("J5_append_new_only", """
SELECT 'u' || l_partkey AS device_url, min(l_orderkey * 10 + l_linenumber) AS place
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 = 0 GROUP BY 1""")
def append_new_only(spark, d):
    rows = _line_specs(spark, d).select("device_url", (F.col("spec_id") * 10 + F.col("line")).alias("place"))
    return R.append_new_only(_three(spark, d)[1], rows, "place")


@query("J8_brand_checks", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT name, EXISTS (SELECT 1 FROM named n WHERE n.brand_name = b.name) AS exists,
       (SELECT count(DISTINCT l_partkey) FROM lineitem) AS total_specs,
       (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN named n ON n.pos = l_partkey WHERE n.brand_name = b.name) AS brand_specs
FROM (SELECT name FROM brands UNION ALL SELECT name || ' Old' FROM brands) b""")
def brand_checks(spark, d):
    """Each brand, and one of a similar name that has no data."""
    cat = _urls(T.named_catalogue(spark, d))
    brands = T.brand_rows(spark, d)
    asked = brands.select("name").unionByName(brands.select(F.concat("name", F.lit(" Old")).alias("name")))
    return C.brand_checks(asked, cat, _line_specs(spark, d))


@query("G7_refresh_report", """
SELECT count(*) FILTER (WHERE p_partkey % 4 = 0) AS new_devices,
       count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0) AS updated_devices,
       count(DISTINCT p_brand) AS brands_processed, count(DISTINCT p_brand) AS total_brands,
       TIMESTAMP '2025-05-01 12:00:00' AS last_full_update FROM part""")
def refresh_report(spark, d):
    listing, cat, ledger = _three(spark, d)
    brands = T.table(spark, d, "part").select(F.col("p_brand").alias("name"))
    return R.refresh_report(R.new_devices(listing, cat), R.untracked_devices(listing, cat, ledger), brands, brands, "2025-05-01T12:00:00")


@query("G7_refresh_report_partial", """
SELECT count(*) FILTER (WHERE p_partkey % 4 = 0) AS new_devices, count(*) FILTER (WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0) AS updated_devices,
       count(DISTINCT p_brand) FILTER (WHERE p_size % 50 > 0) - count(DISTINCT p_brand) FILTER (WHERE p_brand = 'Brand#11') AS brands_processed, count(DISTINCT p_brand) AS total_brands,
       CASE WHEN count(DISTINCT p_brand) = 0 THEN TIMESTAMP '2025-05-01 12:00:00' END AS last_full_update FROM part""")
def refresh_report_partial(spark, d):
    """One brand was asked for and not processed."""
    listing, cat, ledger = _three(spark, d)
    p = T.table(spark, d, "part")
    done = p.filter("p_size % 50 > 0 AND p_brand <> 'Brand#11'")
    return R.refresh_report(R.new_devices(listing, cat), R.untracked_devices(listing, cat, ledger), p.select(F.col("p_brand").alias("name")),
                            done.select(F.col("p_brand").alias("name")), "2025-05-01T12:00:00")


@query("G9_snapshot_status", """
SELECT count(*) AS brand_count, max(ts) AS last_updated,
       CAST(date_diff('second', max(ts), TIMESTAMP '2024-02-05 06:00:00') // 86400 AS VARCHAR) || ' days ago' AS time_since_update,
       max(ts) + INTERVAL 24 HOUR < TIMESTAMP '2024-02-05 06:00:00' AS is_expired FROM events""")
def snapshot_status(spark, d):
    snap = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("snapshot_ts"))
    return C.snapshot_status(snap, "2024-02-05 06:00:00")


@query("W9_progress", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT pos, brand_name, row_number() OVER b AS brand_item, count(*) OVER (PARTITION BY brand_name) AS brand_items,
       row_number() OVER (ORDER BY pos) AS devices_processed,
       round(row_number() OVER b * 100.0 / count(*) OVER (PARTITION BY brand_name), 6) AS current_brand_progress,
       round(CASE WHEN t > 0 THEN row_number() OVER (ORDER BY pos) * 100.0 / t ELSE 100 END, 6) AS progress
FROM named, (SELECT CAST(sum(device_count) AS DOUBLE) AS t FROM brands)
WINDOW b AS (PARTITION BY brand_name ORDER BY pos)""")
def progress(spark, d):
    out = U.progress(T.named_catalogue(spark, d).select("pos", "brand_name"), T.brand_rows(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("current_brand_progress", "progress")})
