"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from devicelode import functions as S
from wiring import tables as T
from wiring.registry import ctes, query


@query("S1_normalise", "SELECT conv_id, turn, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations")
def normalise(spark, d):
    return T.table(spark, d, "conversations").select("conv_id", "turn", S.normalise(F.concat(F.lit(" \n\t"), "text", F.lit("\r\n "))).alias("text"))


@query("S2_snake_key", "SELECT p_partkey, replace(replace(lower(p_name || '-' || p_type), ' ', '_'), '-', '_') AS key FROM part")
def snake_key(spark, d):
    return T.table(spark, d, "part").select("p_partkey", S.snake_key(F.concat("p_name", F.lit("-"), "p_type")).alias("key"))


@query("S3_readable_key", """
SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]
  || ' ' || p_size || 'G ' || upper(p_type[1]) || lower(p_type[2:]) AS key FROM part""")
def readable_key(spark, d):
    return T.table(spark, d, "part").select("p_partkey", S.readable_key(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_size", F.lit("g_"), "p_type")).alias("key"))


@query("S4_digits_int", "SELECT c_custkey, CAST(c_custkey AS BIGINT) AS n, CAST(0 AS BIGINT) AS none FROM customer")
def digits_int(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", S.digits_int("c_name").alias("n"), S.digits_int("c_mktsegment").alias("none"))


@query("S5_url_parts", """
SELECT page_id, split_part(list_extract(string_split(url, '-'), -1), '.', 1) AS id,
  CASE WHEN contains(stem, '-') THEN array_to_string(list_slice(string_split(stem, '-'), 1, -2), '-') ELSE stem END AS base
FROM (SELECT page_id, url, split_part(list_extract(string_split(url, '/'), -1), '.', 1) AS stem FROM (
  SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, url || '/my-fine_phone-' || page_id || '.php' FROM pages))""")
def url_parts(spark, d):
    p = T.table(spark, d, "pages").select("page_id", "url")
    urls = p.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), F.concat("url", F.lit("/my-fine_phone-"), "page_id", F.lit(".php")).alias("url")))
    return urls.select("page_id", S.url_id("url").alias("id"), S.url_base("url").alias("base"))


@query("S6_gallery_url", ctes(T.CAT) + f"""
SELECT pos, '{T.BASE}' || replace(p_name, ' ', '_') || '-pictures-' || pos || '.php' AS gallery FROM cat JOIN part ON p_partkey = pos""")
def gallery_url(spark, d):
    return T.catalogue(spark, d).select("pos", S.gallery_url(S.url_base("device_url"), S.url_id("device_url")).alias("gallery"))


@query("S7_resolve_url", "SELECT page_id, 'https://site.test/' || page_id || '.php' AS url FROM pages")
def resolve_url(spark, d):
    return T.table(spark, d, "pages").select("page_id", S.resolve_url(F.concat("page_id", F.lit(".php")), "https://site.test/").alias("url"))


@query("S8_mask_key", "SELECT c_custkey, substr(c_name, 1, 8) || '...' || substr(c_name, length(c_name) - 3) AS masked FROM customer")
def mask_key(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", S.mask_key("c_name").alias("masked"))


@query("S9_age_text", """
SELECT event_id, CASE WHEN s < 60 THEN CAST(trunc(s) AS BIGINT) || ' seconds ago' WHEN s < 3600 THEN CAST(trunc(s / 60) AS BIGINT) || ' minutes ago'
  WHEN s < 86400 THEN CAST(trunc(s / 3600) AS BIGINT) || ' hours ago' ELSE CAST(trunc(s / 86400) AS BIGINT) || ' days ago' END AS age, s > 86400 AS expired
FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1e6 - epoch_us(ts) / 1e6 AS s FROM events)""")
def age_text(spark, d):
    now = F.lit("2024-01-31 00:00:00")
    return T.table(spark, d, "events").select("event_id", S.age_text("ts", now).alias("age"), S.is_expired("ts", now).alias("expired"))


@query("S10_iso_timestamps", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso_whole, ts AS back FROM events""")
def iso_timestamps(spark, d):
    e = T.table(spark, d, "events").select("event_id", S.ts_iso("ts").alias("iso"), S.ts_iso(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("iso_whole"))
    return e.withColumn("back", S.iso_ts("iso"))


@query("S11_names", ctes(T.CAT) + "SELECT pos, brand_name || ' ' || device_name AS full_name, brand_name || '_' || device_name AS device_key FROM cat")
def names(spark, d):
    return T.catalogue(spark, d).select("pos", S.full_name("brand_name", "device_name").alias("full_name"), S.device_key("brand_name", "device_name").alias("device_key"))


@query("S13_join_list", "SELECT p_partkey, p_name || ', ' || p_type || ', ' || p_brand AS joined FROM part")
def join_list(spark, d):
    return T.table(spark, d, "part").select("p_partkey", S.join_list(F.array("p_name", "p_type", "p_brand")).alias("joined"))


@query("S14_percent", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber > 3 THEN l_quantity * 100 / (l_linenumber - 3) ELSE 100 END, 6) AS pct FROM lineitem""")
def percent(spark, d):
    left = F.greatest(F.col("l_linenumber") - 3, F.lit(0))
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.percent("l_quantity", left), 6).alias("pct"))


@query("S16_fill", "SELECT p_partkey, 'I found 1 of {x} ' || p_brand || ' ' || p_name || ' {n}.' AS message FROM part")
def fill(spark, d):
    """A value that looks like a place to fill stays as it is."""
    tricky = F.concat("p_name", F.lit(" {n}"))
    return T.table(spark, d, "part").select("p_partkey", S.fill("I found {n} of {x} {brand} {device}.", n=F.lit(1), x=F.lit("{x}"), brand="p_brand", device=tricky).alias("message"))
