"""Readers, filters, paging, sets and groups over the catalogue."""

from pyspark.sql import functions as F

from devicelode.functions import fill
from devicelode.operators import catalog as C
from devicelode.operators import recommend as R
from devicelode.session import scratch_path
from devicelode.sources import readers, sinks
from wiring import tables as T
from wiring.registry import ctes, query


def _csv(df, path):
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


# ---- files -------------------------------------------------------------------

@query("A1_read_catalogue", ctes(T.CAT) + "SELECT * REPLACE (row_number() OVER (ORDER BY pos) - 1 AS pos) FROM cat")
def read_catalogue(spark, d):
    path = scratch_path(spark, "catalogue")
    _csv(T.catalogue(spark, d).orderBy("pos").drop("pos"), path)
    return readers.read_catalogue(spark, path)


@query("A2_read_specs", ctes(T.CAT, T.SPEC_ROWS) + """
SELECT c.device_url, c.device_name AS name, 'GSM / LTE ' || p_size AS technology, 'About ' || p_size AS price_text,
       CAST((SELECT count(*) FROM spec_rows s WHERE s.pos = c.pos AND s.co < 9) AS BIGINT) AS spec_fields
FROM cat c JOIN part ON p_partkey = c.pos""")
def read_specs(spark, d):
    """Both layouts: even parts in the narrow one, whole record as JSON; odd parts in the wide one."""
    docs = T.spec_documents(spark, d).join(T.table(spark, d, "part").select(
        T.part_url().alias("device_url"), "p_partkey", "p_size"), "device_url")
    tech, price = F.concat(F.lit("GSM / LTE "), "p_size"), F.concat(F.lit("About "), "p_size")
    record = F.concat(F.lit('{"name":"x","specifications":'), "specifications", F.lit(',"technology":"'), tech,
                      F.lit('","price_info":"{\\"text\\":\\"'), price, F.lit('\\"}"}'))
    narrow, wide = scratch_path(spark, "specs4"), scratch_path(spark, "specs14")
    even = docs.filter(F.col("p_partkey") % 2 == 0)
    odd = docs.filter(F.col("p_partkey") % 2 == 1)
    _csv(even.select("device_url", "name", "pictures", record.alias("specifications")), narrow)
    twice = F.concat(F.lit('"{\\"text\\": \\"'), price, F.lit('\\"}"'))
    _csv(odd.select("device_url", "name", "pictures", F.concat("specifications", F.lit("\n")).alias("specifications"),
                    tech.alias("technology"), *[F.lit("").alias(c) for c in (
                        "display_type", "dimensions", "os", "colors", "battery_type", "main_camera", "selfie_camera",
                        "sensors")], twice.alias("price_info")), wide)
    both = readers.read_specs(spark, narrow).unionByName(readers.read_specs(spark, wide))
    top = F.from_json("specifications", "map<string,string>")
    fields = F.aggregate(
        F.filter(F.map_entries(top), lambda e: ~e["key"].isin("Sound design", "software")), F.lit(0).cast("bigint"),
        lambda n, e: n + F.coalesce(F.size(F.from_json(e["value"], "map<string,string>")), F.lit(1)).cast("bigint"))
    return both.select("device_url", "name", "technology", F.get_json_object("price_info", "$.text").alias("price_text"),
                       fields.alias("spec_fields"))


SNAPSHOT = ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT TIMESTAMP '2025-04-24 07:54:13' AS snapshot_ts, (SELECT count(*) FROM brands) AS brand_count,
       name, url, device_count FROM brands"""


@query("A3_read_brand_snapshot", SNAPSHOT)
def read_brand_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    brands = T.brand_rows(spark, d)
    doc = brands.groupBy(F.floor(F.col("pos") / 10_000).alias("chunk")).agg(
        F.collect_list(F.struct("name", "url", "device_count")).alias("brands")).select(F.to_json(F.struct(
            F.lit("2025-04-24T07:54:13").alias("timestamp"), "brands",
            brands.agg(F.count(F.lit(1))).scalar().alias("brand_count"))))
    doc.write.text(path)
    return readers.read_brand_snapshot(spark, path, lines=True)


@query("A4_read_ledger", ctes(T.CAT, T.NAMED) + """
SELECT device_url, TIMESTAMP '2024-01-01 10:00:00' AS last_updated, brand_name AS brand, CAST(NULL AS VARCHAR) AS model FROM named
UNION ALL SELECT NULL, TIMESTAMP '2023-11-15', brand_name, device_name FROM named""")
def read_ledger(spark, d):
    """The map form and the list form, in documents of some hundred devices."""
    path = scratch_path(spark, "ledger")
    chunk = T.named_catalogue(spark, d).groupBy(F.floor(F.col("pos") / 500).alias("chunk"))
    as_map = chunk.agg(F.map_from_entries(F.collect_list(F.struct("device_url", F.struct(
        F.lit("2024-01-01T10:00:00").alias("last_updated"), F.col("brand_name").alias("brand"))))).alias("devices"))
    as_list = chunk.agg(F.collect_list(F.struct(F.col("brand_name").alias("brand"), F.col("device_name").alias("model"),
                                                F.struct(F.lit(9.5).alias("price")).alias("specs"))).alias("devices"))
    as_map.select(F.to_json(F.struct(F.lit("2024-01-02").alias("last_full_update"), "devices"))).write.text(path)
    as_list.select(F.to_json(F.struct(F.lit("2023-11-15").alias("last_update"), "devices"))).write.mode("append").text(path)
    return readers.read_ledger(spark, path, lines=True)


@query("A5_read_access_keys", """
SELECT c_name AS access_key, 'n' || c_custkey AS name, 'u' || c_custkey || '@example.com' AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'premium' ELSE 'basic' END AS tier,
       TIMESTAMP '2024-03-01 08:00:00' AS created_at, CAST(NULL AS TIMESTAMP) AS last_used,
       CAST(abs(trunc(c_acctbal)) AS BIGINT) AS usage_count FROM customer""")
def read_access_keys(spark, d):
    path = scratch_path(spark, "keys")
    c = T.table(spark, d, "customer")
    entry = F.struct("c_name", F.struct(
        F.concat(F.lit("n"), "c_custkey").alias("name"), F.concat(F.lit("u"), "c_custkey", F.lit("@example.com")).alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("premium")).otherwise(F.lit("basic")).alias("tier"),
        F.lit("2024-03-01T08:00:00").alias("created_at"), F.abs(F.col("c_acctbal").cast("bigint")).alias("usage_count")))
    docs = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("chunk")).agg(F.map_from_entries(F.collect_list(entry)).alias("keys"))
    docs.select(F.to_json(F.struct("keys"))).write.text(path)
    return readers.read_access_keys(spark, path, lines=True)


@query("A6_read_pages", "SELECT page_id, url, html FROM pages")
def read_pages(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet")


@query("A7_append_rows", ctes(T.CAT) + "SELECT brand_name, device_name, device_url FROM cat")
def append_rows(spark, d):
    """Two appends, read back together."""
    path = scratch_path(spark, "appended")
    cat = T.catalogue(spark, d).drop("pos")
    sinks.append_rows(cat.filter(F.col("brand_name") < "Brand#2"), path)
    sinks.append_rows(cat.filter(F.col("brand_name") >= "Brand#2"), path)
    return readers.read_catalogue(spark, path).select("brand_name", "device_name", "device_url")


@query("A8_write_brand_snapshot", SNAPSHOT)
def write_brand_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    sinks.write_brand_snapshot(T.brand_rows(spark, d), path, "2025-04-24T07:54:13")
    return readers.read_brand_snapshot(spark, path, parts=True)


@query("A9_overwrite_swap", ctes(T.CAT) + f"""
SELECT pos, brand_name, upper(device_name) AS device_name, device_url, device_image FROM cat""")
def overwrite_swap(spark, d):
    """A table rewritten from its own current version."""
    path = scratch_path(spark, "swapped")
    sinks.overwrite_swap(T.catalogue(spark, d), path)
    sinks.overwrite_swap(sinks.read_current(spark, path).withColumn("device_name", F.upper("device_name")), path)
    return sinks.read_current(spark, path)


@query("A10_preview", ctes(T.CAT) + "SELECT * FROM cat ORDER BY pos LIMIT 50")
def preview(spark, d):
    return sinks.preview(T.catalogue(spark, d))


@query("A11_serialise_specs", """
SELECT p_partkey AS pos, '["a' || p_partkey || '.jpg","b.jpg"]' AS pictures,
       '{"Body":{"Weight":"' || p_size || ' g"}}' AS specifications,
       '{"text":"About ' || p_size || ' EUR"}' AS price_info FROM part""")
def serialise_specs(spark, d):
    p = T.table(spark, d, "part")
    return sinks.serialise_specs(p.select(
        F.col("p_partkey").alias("pos"), F.array(F.concat(F.lit("a"), "p_partkey", F.lit(".jpg")), F.lit("b.jpg")).alias("pictures"),
        F.create_map(F.lit("Body"), F.create_map(F.lit("Weight"), F.concat("p_size", F.lit(" g")))).alias("specifications"),
        F.struct(fill("About {n} EUR", n="p_size").alias("text")).alias("price_info")))


# ---- filters -------------------------------------------------------------------

@query("F1_by_brand", ctes(T.CAT) + "SELECT * FROM cat WHERE brand_name ILIKE 'brand#12'")
def by_brand(spark, d):
    return C.by_brand(T.catalogue(spark, d), "bRAND#12")


@query("F2_search", ctes(T.CAT) + """
SELECT * FROM cat WHERE strpos(lower(brand_name), 'widget') > 0 OR strpos(lower(device_name), 'widget') > 0""")
def search(spark, d):
    return C.search(T.catalogue(spark, d), "WidGet")


@query("F3_paginate", ctes(T.CAT) + """
SELECT *, count(*) OVER () AS total FROM cat WHERE device_name LIKE '%widget%' ORDER BY pos LIMIT 100 OFFSET 20""")
def paginate(spark, d):
    return C.paginate(C.search(T.catalogue(spark, d), "widget"), 100, 20)


@query("F3_paginate_deep", "SELECT l_orderkey, l_linenumber, k, (SELECT count(*) FROM lineitem) AS total FROM "
       "(SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS k, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n "
       "FROM lineitem) WHERE n > 12000 AND n <= 12100")
def paginate_deep(spark, d):
    """A page behind more rows than a top-k should hold."""
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return C.paginate(li, 100, 12_000, order="k")


@query("F3_paginate_ties", "SELECT coalesce(k, -1) AS k, (SELECT count(*) FROM lineitem) AS total FROM (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST) AS n "
       "FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_linenumber END AS k FROM lineitem)) WHERE n > 24000 AND n <= 34000")
def paginate_ties(spark, d):
    """A deep page by a column that is mostly NULL and otherwise has a handful of values."""
    li = T.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("k"))
    return C.paginate(li, 10_000, 24_000, order="k").select(F.coalesce("k", F.lit(-1)).alias("k"), "total")


@query("F4_by_url", ctes(T.CAT) + "SELECT c.* FROM cat c WHERE device_url IN (SELECT device_url FROM cat WHERE pos % 3 = 0)")
def match_urls(spark, d):
    """A table of wanted URLs, some of them without the site prefix."""
    cat = T.catalogue(spark, d)
    urls = cat.filter("pos % 3 = 0").select(F.when(F.col("pos") % 2 == 0, F.col("device_url")).otherwise(
        F.replace("device_url", F.lit(T.BASE), F.lit(""))).alias("device_url"))
    return C.match_urls(cat, urls)


@query("F4_one_url", ctes(T.CAT) + "SELECT c.* FROM cat c WHERE regexp_full_match(device_url, '.*/red_widget-1.php')")
def by_url(spark, d):
    return C.by_url(T.catalogue(spark, d), "red_widget-1.php")


@query("F5_match_exact", ctes(T.PLAIN) + """
SELECT * FROM plain WHERE (lower(brand_name), lower(device_name)) IN
  (SELECT lower(p_brand), lower(p_name) FROM part WHERE p_size = 7)""")
def match_exact(spark, d):
    names = T.table(spark, d, "part").filter("p_size = 7").select(F.upper("p_brand").alias("brand"), F.upper("p_name").alias("device"))
    return C.match_exact(T.plain_catalogue(spark, d), names)


@query("F7_search_full_name", ctes(T.CAT) + """
SELECT * FROM cat WHERE strpos(lower(brand_name || ' ' || device_name), '#1 red') > 0 ORDER BY pos LIMIT 10""")
def search_full_name(spark, d):
    return C.search_full_name(T.catalogue(spark, d), "#1 Red")


@query("F8_select_brands", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT * FROM brands WHERE name IN ('Nokia', 'LG', 'Poco')""")
def select_brands(spark, d):
    return C.select_brands(T.brand_rows(spark, d), [f"{T.BASE}{b}-phones.php" for b in ("nokia", "lg", "poco")])


@query("F9_delete_brands", ctes(T.CAT) + """
SELECT 'catalogue' AS side, device_url, count(*) AS n FROM cat WHERE brand_name NOT IN ('Brand#3', 'Brand#7') GROUP BY 2
UNION ALL
SELECT 'specs', device_url, count(*) FROM lineitem JOIN cat ON pos = l_partkey
WHERE brand_name NOT IN ('Brand#3', 'Brand#7') GROUP BY 2""")
def delete_brands(spark, d):
    cat = T.catalogue(spark, d)
    spec = T.table(spark, d, "lineitem").join(cat, F.col("l_partkey") == F.col("pos")).select("device_url", "l_orderkey")
    kept, specs = C.delete_brands(cat, spec, ["Brand#3", "Brand#7"])
    rows = kept.select(F.lit("catalogue").alias("side"), "device_url").unionByName(
        specs.select(F.lit("specs").alias("side"), "device_url"))
    return rows.groupBy("side", "device_url").agg(F.count(F.lit(1)).alias("n"))


@query("F10_valid_rows", ctes(T.CAT) + "SELECT pos FROM cat WHERE pos % 5 NOT IN (1, 2) AND pos % 7 <> 3")
def valid_rows(spark, d):
    """Names made blank or NULL, and URLs blank, on some rows."""
    broken = T.catalogue(spark, d).withColumns({
        "device_name": F.when(F.col("pos") % 5 == 1, F.lit(" \n")).when(F.col("pos") % 5 != 2, F.col("device_name")),
        "device_url": F.when(F.col("pos") % 7 == 3, F.lit("")).otherwise(F.col("device_url"))})
    return C.valid_rows(broken).select("pos")


@query("F11_format_device", ctes(T.CAT) + """
SELECT *, concat_ws(' ', brand_name, device_name) AS name, device_url AS url, device_image AS image_url FROM cat""")
def format_device(spark, d):
    return C.format_device(T.catalogue(spark, d))


# ---- groups -----------------------------------------------------------------------

@query("G1_brands_with_devices", ctes(T.CAT) + """
SELECT brand_name, row_number() OVER (PARTITION BY brand_name ORDER BY pos) - 1 AS place,
       device_name AS name, device_url AS url, device_image AS image FROM cat""")
def brands_with_devices(spark, d):
    return C.brands_with_devices(T.catalogue(spark, d)).drop("pos")


@query("G2_brand_counts", "SELECT p_brand AS name, count(*) AS devices, CAST(0 AS BIGINT) AS expected FROM part GROUP BY 1")
def brand_counts(spark, d):
    return C.brand_counts(T.catalogue(spark, d))


@query("G4_data_presence", ctes(T.CAT) + """
SELECT (SELECT count(DISTINCT brand_name) FROM cat) AS brands, EXISTS (SELECT 1 FROM cat WHERE brand_name = 'Brand#9') AS exists,
       (SELECT count(DISTINCT l_partkey) FROM lineitem) AS device_urls""")
def data_presence(spark, d):
    specs = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("device_url"))
    return C.data_presence(T.catalogue(spark, d), specs, "Brand#9")


@query("G5_expected_total", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT CAST(sum(device_count) AS BIGINT) AS total_devices FROM brands WHERE name < 'N'""")
def expected_total(spark, d):
    return C.expected_total(T.brand_rows(spark, d).filter("name < 'N'"))


@query("G6_completion", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + """
SELECT name, (SELECT count(*) FROM lineitem JOIN named ON pos = l_partkey WHERE brand_name = b.name) AS devices,
       device_count AS expected FROM brands b""")
def completion(spark, d):
    got = T.table(spark, d, "lineitem").join(T.named_catalogue(spark, d), F.col("l_partkey") == F.col("pos"))
    return C.completion(got, T.brand_rows(spark, d))


# ---- order, sets -----------------------------------------------------------------

@query("W3_popular_first", ctes(T.CAT, T.NAMED) + """
SELECT row_number() OVER (ORDER BY CASE WHEN brand_name IN ('Samsung', 'Apple', 'Google', 'Xiaomi', 'OnePlus', 'Huawei')
         THEN 0 ELSE 1 END, pos) AS rank, count(*) OVER () AS pool_size, pos, brand_name FROM named""")
def popular_first(spark, d):
    return R.popular_first(T.named_catalogue(spark, d)).select("rank", "pool_size", "pos", "brand_name")


FOCUSES = """focuses AS (SELECT unnest(['', 'samsung', 'apple', 'iphone', 'google', 'pixel', 'xiaomi', 'huawei', 'oneplus',
    'oppo', 'vivo', 'realme', 'sony', 'motorola', 'nokia', 'lg', 'htc', 'honor', 'asus', 'lenovo', 'poco', 'redmi', 'nothing',
    'blackberry']) AS brand_focus),
pools AS (
  SELECT f.brand_focus, n.*, count(*) OVER (PARTITION BY f.brand_focus) AS pool_size,
         row_number() OVER (PARTITION BY f.brand_focus ORDER BY
           CASE WHEN f.brand_focus IN ('samsung', 'apple', 'google', 'xiaomi', 'oneplus', 'huawei')
                THEN (CASE WHEN lower(brand_name) = f.brand_focus THEN 0 ELSE 1 END)
                WHEN brand_name IN ('Samsung', 'Apple', 'Google', 'Xiaomi', 'OnePlus', 'Huawei') THEN 0 ELSE 1 END, pos) AS rank
  FROM named n JOIN focuses f ON contains(lower(brand_name), f.brand_focus)),
tiers AS (
  SELECT 'high_end' AS tier, * FROM pools WHERE rank <= 30
  UNION ALL SELECT 'mid_range', * FROM pools WHERE rank > pool_size // 3 AND rank <= pool_size // 3 + 30
  UNION ALL SELECT 'budget', * FROM pools WHERE rank > pool_size - 30)"""


@query("W4_tier_slices", ctes(T.CAT, T.NAMED, FOCUSES) + "SELECT brand_focus, tier, rank, pool_size, pos FROM tiers")
def tier_slices(spark, d):
    return R.tier_slices(T.named_catalogue(spark, d)).select("brand_focus", "tier", "rank", "pool_size", "pos")


@query("W4_tier_slice", ctes(T.CAT, T.NAMED, FOCUSES) + "SELECT rank, pos FROM tiers WHERE brand_focus = '' AND tier = 'mid_range'")
def tier_slice(spark, d):
    return R.tier_slice(R.popular_first(T.named_catalogue(spark, d)), "mid_range").select("rank", "pos")


PLAIN_NAMED = T.NAMED.replace("FROM cat)", "FROM plain)")


@query("W5_first_unique", ctes(T.PLAIN, PLAIN_NAMED, FOCUSES) + """
SELECT brand_focus, tier, pos, place FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_focus, tier ORDER BY rank) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY brand_focus, tier, brand_name, device_name ORDER BY rank) AS again FROM tiers)
  WHERE again = 1) WHERE place <= 5""")
def first_unique(spark, d):
    code = F.substring("brand_name", 7, 9).cast("int")
    plain = T.plain_catalogue(spark, d).withColumn("brand_name", T.pick(T.BRANDS, code - 1))
    return R.first_unique(R.tier_slices(plain)).select("brand_focus", "tier", "pos", F.col("place").cast("bigint").alias("place"))


@query("W6_top_per_brand", ctes(T.CAT, T.NAMED) + """
SELECT brand_name, pos, place, 'Top ' || brand_name || ' device' AS highlight FROM (
  SELECT brand_name, min(pos) AS pos, CAST(list_position(['Samsung', 'Apple', 'Google', 'Xiaomi', 'OnePlus', 'Huawei'], brand_name) AS BIGINT) AS place
  FROM named WHERE brand_name IN ('Samsung', 'Apple', 'Google', 'Xiaomi', 'OnePlus', 'Huawei') GROUP BY brand_name)
ORDER BY place LIMIT 5""")
def top_per_brand(spark, d):
    return C.top_per_brand(T.named_catalogue(spark, d)).select("brand_name", "pos", F.col("place").cast("bigint").alias("place"), "highlight")


@query("T1_sort_brands", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + "SELECT name, device_count FROM brands ORDER BY name")
def sort_brands(spark, d):
    return C.sort_brands(T.brand_rows(spark, d)).select("name", "device_count")


@query("T2_head", ctes(T.CAT) + "SELECT * FROM cat ORDER BY pos LIMIT 30")
def head(spark, d):
    return C.head(T.catalogue(spark, d), 30)


@query("T3_tail_rows", ctes(T.CAT) + "SELECT * FROM cat WHERE pos > (SELECT max(pos) - 30 FROM cat)")
def tail_rows(spark, d):
    return C.tail_rows(T.catalogue(spark, d), 30)


@query("U1_concat_distinct", ctes(T.PLAIN, PLAIN_NAMED) + """
SELECT brand_name, device_name, min(pos) AS pos,
       min(CASE WHEN brand_name IN ('Samsung', 'Apple', 'Google', 'Xiaomi', 'OnePlus', 'Huawei') THEN 0 ELSE 1 END) AS part
FROM named GROUP BY brand_name, device_name""")
def concat_distinct(spark, d):
    code = F.substring("brand_name", 7, 9).cast("int")
    rows = T.plain_catalogue(spark, d).select("pos", T.pick(T.BRANDS, code - 1).alias("brand_name"), "device_name")
    return C.popular_split(rows)


@query("U2_except_brands", ctes(T.CAT) + """
SELECT * FROM cat EXCEPT SELECT * FROM cat WHERE brand_name IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def except_brands(spark, d):
    return C.except_brands(T.catalogue(spark, d), ["Brand#1", "Brand#2", "Brand#3"])


@query("U3_array_union_ordered", r"""
SELECT page_id, item, CAST(min(n) AS BIGINT) AS first_at FROM (
  SELECT page_id, unnest(list_concat(h, t)) AS item, generate_subscripts(list_concat(h, t), 1) AS n FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '(<[a-z0-9]+)', 1) AS t FROM pages))
GROUP BY page_id, item""")
def array_union_ordered(spark, d):
    """Link targets, then tag names, of each page, each once; the place tells the order."""
    p = T.table(spark, d, "pages")
    h = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    t = F.regexp_extract_all("html", F.lit("(<[a-z0-9]+)"), F.lit(1))
    both = p.select("page_id", F.concat(h, t).alias("whole"), C.array_union_ordered(h, t).alias("u"))
    return both.select("page_id", "whole", F.explode("u").alias("item")).select(
        "page_id", "item", F.array_position("whole", F.col("item")).cast("bigint").alias("first_at"))


@query("U4_distinct_keys", "SELECT DISTINCT p_name AS device_name FROM part")
def distinct_keys(spark, d):
    return C.distinct_keys(T.plain_catalogue(spark, d), "device_name")
