"""Specification documents: parsing, look-ups, highlights, texts."""

from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.operators import specs as S
from devicelode.operators import tagging as N
from wiring import tables as T
from wiring.registry import ctes, query


def _docs(spark, d):
    """Catalogue rows with their documents, every eleventh of them malformed."""
    docs = T.spec_documents(spark, d)
    return T.catalogue(spark, d).join(docs.drop("name"), "device_url")


def _parsed(spark, d):
    return S.with_entries(S.with_nested(S.parse_specs(_docs(spark, d))))


@query("K1_parse_specs", ctes(T.SPEC_ROWS) + """
SELECT p_partkey AS pos, CASE WHEN p_partkey % 11 = 5 THEN 0 ELSE
  (SELECT count(DISTINCT cat) FROM spec_rows s WHERE s.pos = p_partkey) END AS categories FROM part""")
def parse_specs(spark, d):
    """Some documents cut short, some missing."""
    broken = _docs(spark, d).withColumn("specifications", F.when(F.col("pos") % 22 == 5, F.lit('{"Network": {')).when(
        F.col("pos") % 22 != 16, F.col("specifications")))
    return S.parse_specs(broken).select("pos", F.size("specs").cast("bigint").alias("categories"))


@query("K2_spec_rows", ctes(T.SPEC_ROWS, T.CAT) + """
SELECT device_url, dense_rank() OVER (PARTITION BY s.pos ORDER BY co) - 1 AS cat_pos, cat, coalesce(key, '-') AS key,
       CAST(coalesce(ko, -1) AS BIGINT) AS pos, value
FROM spec_rows s JOIN cat c ON c.pos = s.pos""".replace("SELECT device_url", "SELECT c.device_url", 1).replace(
    " cat, coalesce", " s.cat, coalesce"))
def spec_rows(spark, d):
    rows = S.spec_rows(_parsed(spark, d))
    return rows.select("device_url", F.col("cat_pos").cast("bigint").alias("cat_pos"), "cat",
                       F.coalesce("key", F.lit("-")).alias("key"),
                       F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), "value")


@query("K3_parse_pictures", """
SELECT p_partkey AS pos, place, CASE place WHEN 0 THEN 'p' ELSE 'q' END || p_partkey || '.jpg' AS picture
FROM part, (SELECT unnest([0, 1]) AS place) WHERE p_partkey % 4 <> 1 AND p_partkey % 4 <> 2""".replace(
    "p_partkey AS pos, place", "p_partkey AS pos, CAST(place AS BIGINT) AS place"))
def parse_pictures(spark, d):
    """Lists with single quotes, empty lists and broken ones."""
    pics = _docs(spark, d).withColumn("pictures", F.when(F.col("pos") % 4 == 1, F.lit("[]")).when(
        F.col("pos") % 4 == 2, F.lit("[not a list")).otherwise(F.col("pictures")))
    return S.parse_pictures(pics).select("pos", F.posexplode("pictures").alias("place", "picture")).select(
        "pos", F.col("place").cast("bigint").alias("place"), "picture")


def _requests(df):
    """Three kinds per device, chosen by its number."""
    kinds = list(D.SPEC_PATHS)
    return df.withColumn("specifications", F.array(*[
        T.pick(kinds, (F.col("pos") * m + a) % 8) for m, a in ((1, 0), (1, 3), (1, 6))]))


PATHS = "paths(kind, path_pos, path) AS (VALUES " + ", ".join(
    f"('{k}', {i}, '{p}')" for k, ps in D.SPEC_PATHS.items() for i, p in enumerate(ps)) + ")"
KINDS = f"list_extract({T.sql_list(list(D.SPEC_PATHS))}, CAST((p_partkey + a) % 8 AS INTEGER) + 1)"
REQUESTED = f"""wanted AS (
  SELECT p_partkey AS pos, r AS request_pos, {KINDS} AS kind FROM part, (VALUES (0, 0), (1, 3), (2, 6)) v(r, a)),
hits AS (
  SELECT w.pos, w.kind, w.request_pos, path_pos, 0 AS depth, co, coalesce(ko, 0) AS ko, coalesce(key, path) AS key, value
  FROM wanted w JOIN paths p ON p.kind = w.kind JOIN spec_rows s ON s.pos = w.pos AND s.cat = p.path
  UNION ALL
  SELECT w.pos, w.kind, w.request_pos, path_pos, 1, co, 0, path, value
  FROM wanted w JOIN paths p ON p.kind = w.kind JOIN spec_rows s ON s.pos = w.pos AND s.key = p.path),
once AS (
  SELECT *, row_number() OVER (PARTITION BY pos, lower(key) ORDER BY request_pos, path_pos, depth, co, ko) AS n FROM hits)"""


@query("K4_requested_specs", ctes(T.SPEC_ROWS, PATHS, REQUESTED) + """
SELECT pos, kind AS spec_type, key, value, row_number() OVER (PARTITION BY pos ORDER BY request_pos, path_pos, depth, co, ko) - 1 AS place
FROM once WHERE n = 1""")
def requested_specs(spark, d):
    found = S.requested_specs(_requests(_parsed(spark, d)))
    return found.select("pos", F.posexplode("requested").alias("place", "r")).select(
        "pos", F.col("place").cast("bigint").alias("place"), "r.spec_type", "r.key", "r.value")


@query("K5_feature_to_specs", ctes(T.ASKED, T.dict_cte("dict", D.FEATURES), T.found_cte("found", "asked", "qid", "dict")) + """
SELECT qid, label AS feature, spec_type, CAST(n - 1 AS BIGINT) AS place FROM found JOIN (VALUES
  ('camera', 'camera', 1), ('camera', 'main_camera', 2), ('camera', 'selfie_camera', 3),
  ('battery', 'battery', 1), ('battery', 'battery_life', 2), ('battery', 'charging', 3),
  ('performance', 'processor', 1), ('performance', 'cpu', 2), ('performance', 'chipset', 3), ('performance', 'platform', 4),
  ('display', 'display', 1), ('display', 'screen', 2)) m(f, spec_type, n) ON f = label""")
def feature_to_specs(spark, d):
    tagged = N.feature_tags(T.asked(spark, d))
    return N.feature_to_specs(tagged).select("qid", "feature", "spec_type", F.col("place").cast("bigint").alias("place"))


# The facts of a device, straight from the part.
FACTS = """facts AS (
  SELECT p_partkey AS pos, p_partkey AS k, p_size || '' AS s, p_type AS t,
         CASE p_partkey % 3 WHEN 0 THEN p_size || ' MP' WHEN 1 THEN p_size || ' MP wide' END AS camera,
         CASE p_partkey % 3 WHEN 0 THEN 'Li ' || p_size WHEN 1 THEN 'Li-Po ' || p_size END AS battery,
         p_type || ' chip' AS performance, p_size || ' inches' AS display, p_size || 'GB' AS storage
  FROM part)"""


def _focus(df):
    """Focus areas and tier by number: none, the main ones, others, some that no category is named after."""
    m = F.col("pos") % 6
    areas = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.withColumns({
        "focus_areas": F.when(m == 0, areas()).when(m == 1, areas("camera", "battery")).when(m == 2, areas("battery"))
        .when(m == 3, areas("display", "design")).when(m == 4, areas("software", "audio")).otherwise(areas("audio")),
        "tier": T.pick(["high_end", "mid_range", "budget"], F.col("pos") % 3)})


LINES = """lines AS (
  SELECT pos, list_filter(CASE k % 6
    WHEN 0 THEN ['Main camera: ' || camera, 'Battery: ' || battery, 'Processor: ' || performance, 'Display: ' || display, 'Storage: ' || storage]
    WHEN 1 THEN ['Main camera: ' || camera, 'Battery: ' || battery]
    WHEN 2 THEN ['Battery: ' || battery]
    WHEN 3 THEN ['Display: ' || display, CASE WHEN k % 5 = 0 THEN 'Design - Loudspeaker: Yes' END]
    WHEN 4 THEN [CASE WHEN k % 7 = 0 THEN 'Software: stock' END]
    ELSE CAST([] AS VARCHAR[]) END, lambda x: x IS NOT NULL) AS found,
    CASE k % 6 WHEN 1 THEN 'camera, battery' WHEN 2 THEN 'battery' WHEN 3 THEN 'display, design' WHEN 4 THEN 'software, audio' ELSE 'audio' END AS areas
  FROM facts)"""


@query("K8_highlights", ctes(FACTS, LINES) + """
SELECT pos, CASE WHEN len(found) > 0 THEN array_to_string(found, ' | ') ELSE 'A great choice for ' || areas END AS highlights FROM lines""")
def highlights(spark, d):
    rows = S.highlights(_focus(S.with_facts(_parsed(spark, d))))
    return rows.select("pos", F.array_join("highlights", " | ").alias("highlights"))


@query("K9_focus_highlights", ctes(T.SPEC_ROWS) + """
SELECT pos, string_agg(upper(area[1]) || area[2:] || CASE WHEN key IS NULL THEN ': ' ELSE ' - ' || key || ': ' END || value, ' | '
                       ORDER BY ord, co) AS highlights
FROM spec_rows, (VALUES (0, 'design'), (1, 'software'), (2, 'dimension'), (3, 'tech'), (4, 'memory')) f(ord, area)
WHERE contains(lower(cat), area) AND coalesce(ko, 0) = 0 GROUP BY pos""")
def focus_highlights(spark, d):
    areas = F.array(*[F.lit(a) for a in ("design", "software", "dimension", "tech", "memory")])
    rows = _parsed(spark, d).select("pos", F.array_join(
        S.other_highlights(areas, F.col("specs"), F.col("nested")), " | ").alias("highlights"))
    return rows.filter("highlights <> ''")


@query("K9_last_resort", """
SELECT p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN 'Premium flagship device' WHEN 1 THEN 'Great value mid-range device'
  ELSE 'Affordable device with good features' END AS highlights FROM part""")
def last_resort(spark, d):
    """Devices without a document and questions without focus."""
    bare = S.with_facts(S.with_nested(S.parse_specs(T.catalogue(spark, d).withColumn("specifications", F.lit(None).cast("string")))))
    rows = _focus(bare).withColumn("focus_areas", F.array().cast("array<string>"))
    return S.highlights(rows).select("pos", F.array_join("highlights", " | ").alias("highlights"))


@query("K10_device_summary", ctes(T.CAT, FACTS) + """
SELECT pos, 'I found information about ' || brand_name || ' ' || device_name
  || '. Would you like to know about its specifications, price, or something else?'
  || ' It has a ' || display || ' display. It''s powered by a ' || performance
  || coalesce('. The main camera is ' || camera, '') || coalesce('. It has a ' || battery, '') || '.'
  || ' Would you like to know more specific information about this device?' AS summary
FROM cat JOIN facts USING (pos)""")
def device_summary(spark, d):
    return S.device_summary(S.with_facts(_parsed(spark, d))).select("pos", "summary")


@query("K11_spec_report", ctes(T.CAT, T.SPEC_ROWS, PATHS, REQUESTED) + """,
readable AS (SELECT *, list_aggregate(list_transform(range(1, len(key) + 1), lambda i: CASE WHEN key[i] = '_' THEN ' '
    WHEN regexp_matches(key[i - 1], '[A-Za-z]') THEN lower(key[i]) ELSE upper(key[i]) END), 'string_agg', '') AS shown FROM once WHERE n = 1),
blocks AS (
  SELECT w.pos, w.request_pos, '• ' || upper(w.kind[1]) || w.kind[2:] || chr(58) || chr(10) || coalesce(string_agg(
    '  - ' || shown || ': ' || value || chr(10), '' ORDER BY path_pos, depth, co, ko), '') || chr(10) AS block, any_value(w.kind) AS kind
  FROM wanted w LEFT JOIN readable r ON r.pos = w.pos AND r.request_pos = w.request_pos GROUP BY w.pos, w.request_pos, w.kind)
SELECT b.pos, 'Here are the ' || string_agg(kind, ', ' ORDER BY request_pos) || ' specifications for the ' || any_value(brand_name)
  || ' ' || any_value(device_name) || chr(58) || chr(10) || chr(10) || rtrim(string_agg(block, '' ORDER BY request_pos), ' ' || chr(10)) AS report
FROM blocks b JOIN cat c ON c.pos = b.pos GROUP BY b.pos""".replace("\nreadable", "readable"))
def spec_report(spark, d):
    return S.spec_report(S.requested_specs(_requests(_parsed(spark, d)))).select("pos", "report")


@query("S12_lookup", """
SELECT p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN p_size || ' MP' END AS camera_text,
       '{"OS":"os ' || p_size || '","chipset":"' || p_type || ' chip"}' AS platform FROM part""".replace(
    "CASE p_partkey % 3 WHEN 0 THEN p_size || ' MP' END", "coalesce(CASE p_partkey % 3 WHEN 1 THEN p_size || ' MP wide' WHEN 0 THEN '{\"modules\":\"' || p_size || ' MP\"}' END, '-')"))
def lookup(spark, d):
    rows = S.spec_lookup(S.spec_lookup(_parsed(spark, d), "camera_text", "main_camera", "Main Camera"), "platform", "platform", "Platform")
    return rows.select("pos", F.coalesce("camera_text", F.lit("-")).alias("camera_text"), "platform")
