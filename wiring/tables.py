"""The test tables seen as catalogue, specification, question and log tables.

Each view exists twice: as a Spark DataFrame and as a SQL common table
expression, written apart from one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelode.session import spread, unsent

BASE = "https://www.example.com/"

# Names given to the 25 brand codes.
BRANDS = ["Samsung", "Apple", "Google", "Xiaomi", "OnePlus", "Huawei", "Oppo", "Vivo", "Realme", "Sony", "Motorola",
          "Nokia", "LG", "HTC", "Honor", "Asus", "Lenovo", "Poco", "Redmi", "Nothing", "BlackBerry", "Acer", "Alcatel",
          "Panasonic", "Sharp"]

# Openings of rendered questions.
OPENINGS = ["compare the battery of", "best camera phone like", "what is the price of", "recommend a cheap one like",
            "hello", "show specs and display size of", "which is better", "thanks for", "is a samsung as good as",
            "budget gaming with", "how much memory and storage has", "", "premium design and software, maybe",
            "medium sized pixel, android 5g", "an iphone with great sound quality", "bye"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table ahead of costly work per row: its small file is spread over the cores."""
    return spread(table(spark, sf_dir, name))


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def pick(items: list[str], index: Column) -> Column:
    """Element of a fixed list, the index counted from 0."""
    return F.get(F.array(*[F.lit(i) for i in items]), index.cast("int"))


# ---- catalogue -----------------------------------------------------------------

def part_url() -> Column:
    return F.concat(F.lit(BASE), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_partkey"), F.lit(".php"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand_name"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey")).alias("device_name"),
        part_url().alias("device_url"), F.lit("").alias("device_image"))


def wide_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(catalogue(spark, sf_dir))


CAT = f"""cat AS (
  SELECT p_partkey AS pos, p_brand AS brand_name, p_name || ' ' || p_partkey AS device_name,
         '{BASE}' || replace(p_name, ' ', '_') || '-' || p_partkey || '.php' AS device_url, '' AS device_image
  FROM part)"""


def named_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with brand names instead of codes."""
    code = F.substring("brand_name", 7, 9).cast("int")
    return catalogue(spark, sf_dir).withColumn("brand_name", pick(BRANDS, code - 1))


NAMED = f"""named AS (
  SELECT pos, list_extract({sql_list(BRANDS)}, CAST(substr(brand_name, 7) AS INTEGER)) AS brand_name,
         device_name, device_url, device_image
  FROM cat)"""


def plain_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device names without their number: many rows of a brand share a name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand_name"), F.col("p_name").alias("device_name"),
        part_url().alias("device_url"), F.lit("").alias("device_image"))


PLAIN = f"""plain AS (
  SELECT p_partkey AS pos, p_brand AS brand_name, p_name AS device_name,
         '{BASE}' || replace(p_name, ' ', '_') || '-' || p_partkey || '.php' AS device_url, '' AS device_image
  FROM part)"""


def brand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands ``(pos, name, url, device_count)``; the expected count is twice the real one less 100."""
    counted = named_catalogue(spark, sf_dir).groupBy("brand_name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return counted.select(
        "pos", F.col("brand_name").alias("name"),
        F.concat(F.lit(BASE), F.lower("brand_name"), F.lit("-phones.php")).alias("url"),
        F.greatest(F.col("n") * 2 - 100, F.lit(0)).cast("bigint").alias("device_count"))


BRAND_ROWS = f"""brands AS (
  SELECT min(pos) AS pos, brand_name AS name, '{BASE}' || lower(brand_name) || '-phones.php' AS url,
         CAST(greatest(count(*) * 2 - 100, 0) AS BIGINT) AS device_count
  FROM named GROUP BY brand_name)"""


# ---- specifications --------------------------------------------------------------

def _json_object(*fields: tuple[str, Column]) -> Column:
    parts = [x for i, (k, v) in enumerate(fields) for x in (F.lit(("," if i else "") + f'"{k}":"'), v, F.lit('"'))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _field(name: Column | str, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit('"'), name, F.lit('":'), value)


def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(device_url, name, pictures, specifications)``: a document per part, of varying form."""
    k, s, t = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_type")
    txt = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    either = lambda n, a, b: F.when(k % n == 0, F.lit(a)).otherwise(F.lit(b))
    fields = F.array_compact(F.array(
        _field("Network", _json_object(("Technology", txt("GSM / LTE ", s)), ("Speed", txt(s, " Mbps")))),
        _field("technology", quoted(txt("GSM / LTE ", s))),
        _field(either(2, "Body", "body"), _json_object(("Dimensions", txt(s, " x 2 mm")), ("weight", txt(s, " g")))),
        _field(either(2, "display", "Display"), _json_object(
            ("Type", t), ("size", txt(s, " inches")), ("resolution", txt(s, "0 x 20")))),
        _field(either(3, "platform", "Platform"), _json_object(("OS", txt("os ", s)), ("chipset", txt(t, " chip")))),
        _field("Memory", _json_object(("internal", txt(s, "GB")))),
        F.when(k % 3 == 0, _field("Main Camera", _json_object(("modules", txt(s, " MP")))))
        .when(k % 3 == 1, _field("main_camera", quoted(txt(s, " MP wide")))),
        F.when(k % 3 == 0, _field("battery_type", quoted(txt("Li ", s))))
        .when(k % 3 == 1, _field("battery", _json_object(("type", txt("Li-Po ", s)))))
        .otherwise(_field("Battery", _json_object(("Type", txt("Li-Ion ", s))))),
        _field("Misc", _json_object(("Colors", F.lower(t)), ("Price", txt("About ", s, " EUR")))),
        F.when(k % 5 == 0, _field("Sound design", _json_object(("Loudspeaker", F.lit("Yes")), ("type", F.lit("stereo"))))),
        F.when(k % 7 == 0, _field("software", quoted(F.lit("stock")))),
    ))
    return wide_table(spark, sf_dir, "part").select(
        part_url().alias("device_url"), F.concat("p_name", F.lit(" "), k).alias("name"),
        F.concat(F.lit("['p"), k, F.lit(".jpg', 'q"), k, F.lit(".jpg']")).alias("pictures"),
        F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("specifications"))


# The same documents as rows: co orders the categories, a NULL key marks a scalar at the top.
SPEC_ROWS = """spec_rows AS (
  SELECT p_partkey AS pos, u.*
  FROM part, LATERAL (VALUES
    (0, 'Network', 0, 'Technology', 'GSM / LTE ' || p_size, true),
    (0, 'Network', 1, 'Speed', p_size || ' Mbps', true),
    (1, 'technology', NULL, NULL, 'GSM / LTE ' || p_size, true),
    (2, CASE WHEN p_partkey % 2 = 0 THEN 'Body' ELSE 'body' END, 0, 'Dimensions', p_size || ' x 2 mm', true),
    (2, CASE WHEN p_partkey % 2 = 0 THEN 'Body' ELSE 'body' END, 1, 'weight', p_size || ' g', true),
    (3, CASE WHEN p_partkey % 2 = 0 THEN 'display' ELSE 'Display' END, 0, 'Type', p_type, true),
    (3, CASE WHEN p_partkey % 2 = 0 THEN 'display' ELSE 'Display' END, 1, 'size', p_size || ' inches', true),
    (3, CASE WHEN p_partkey % 2 = 0 THEN 'display' ELSE 'Display' END, 2, 'resolution', p_size || '0 x 20', true),
    (4, CASE WHEN p_partkey % 3 = 0 THEN 'platform' ELSE 'Platform' END, 0, 'OS', 'os ' || p_size, true),
    (4, CASE WHEN p_partkey % 3 = 0 THEN 'platform' ELSE 'Platform' END, 1, 'chipset', p_type || ' chip', true),
    (5, 'Memory', 0, 'internal', p_size || 'GB', true),
    (6, 'Main Camera', 0, 'modules', p_size || ' MP', p_partkey % 3 = 0),
    (6, 'main_camera', NULL, NULL, p_size || ' MP wide', p_partkey % 3 = 1),
    (7, 'battery_type', NULL, NULL, 'Li ' || p_size, p_partkey % 3 = 0),
    (7, 'battery', 0, 'type', 'Li-Po ' || p_size, p_partkey % 3 = 1),
    (7, 'Battery', 0, 'Type', 'Li-Ion ' || p_size, p_partkey % 3 = 2),
    (8, 'Misc', 0, 'Colors', lower(p_type), true),
    (8, 'Misc', 1, 'Price', 'About ' || p_size || ' EUR', true),
    (9, 'Sound design', 0, 'Loudspeaker', 'Yes', p_partkey % 5 = 0),
    (9, 'Sound design', 1, 'type', 'stereo', p_partkey % 5 = 0),
    (10, 'software', NULL, NULL, 'stock', p_partkey % 7 = 0)
  ) u(co, cat, ko, key, value, present)
  WHERE u.present)"""


# ---- questions --------------------------------------------------------------------

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order, about the devices numbered by customer and by order key; any device can be the second one."""
    cat = catalogue(spark, sf_dir)
    a = cat.select(F.col("pos").alias("ka"), F.col("brand_name").alias("ba"), F.col("device_name").alias("da"))
    b = cat.select(F.col("pos").alias("kb"), F.col("brand_name").alias("bb"), F.col("device_name").alias("db"))
    devices = cat.agg(F.count(F.lit(1))).scalar()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 7 % devices).alias("kb"))
    m = F.col("o_orderkey") % 5
    sp = F.lit(" ")
    body = (
        F.when(m == 0, F.concat("ba", sp, "da"))
        .when(m == 1, F.col("da"))
        .when(m == 2, F.concat("ba", sp, "da", F.lit(" vs "), "db"))
        .when(m == 3, F.concat("da", F.lit(" or "), "bb", sp, "db"))
        .otherwise(F.lit("something new")))
    return o.join(unsent(a), o["o_custkey"] == a["ka"]).join(unsent(b), "kb").select(
        F.col("o_orderkey").alias("qid"),
        F.concat(pick(OPENINGS, F.col("o_orderkey") % len(OPENINGS)), sp, body).alias("text"))


QUESTIONS = f"""questions AS (
  SELECT o_orderkey AS qid,
         list_extract({sql_list(OPENINGS)}, CAST(o_orderkey % {len(OPENINGS)} AS INTEGER) + 1) || ' ' ||
         CASE o_orderkey % 5 WHEN 0 THEN a.brand_name || ' ' || a.device_name
              WHEN 1 THEN a.device_name
              WHEN 2 THEN a.brand_name || ' ' || a.device_name || ' vs ' || b.device_name
              WHEN 3 THEN a.device_name || ' or ' || b.brand_name || ' ' || b.device_name
              ELSE 'something new' END AS text
  FROM orders JOIN cat a ON a.pos = o_custkey JOIN cat b ON b.pos = o_orderkey * 7 % (SELECT count(*) FROM cat))"""

# All mentions: the nested loop that the operator avoids.
MATCHES = """names AS (
  SELECT lower(brand_name) AS brand, lower(device_name) AS device, min(pos) AS pos FROM cat GROUP BY 1, 2),
matches AS (
  SELECT qid, brand, device, pos, contains(lower(text), brand || ' ' || device) AS is_full,
         contains(lower(text), brand) AS with_brand
  FROM questions JOIN names ON contains(lower(text), device)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY
           length(device) + CASE WHEN is_full THEN length(brand) + 1 ELSE 0 END DESC, pos,
           CASE WHEN is_full THEN 0 ELSE 1 END) AS rank
  FROM matches)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations behind a rendered opening."""
    c = wide_table(spark, sf_dir, "conversations")
    at = (F.col("conv_id") + F.col("turn") * 3) % len(OPENINGS)
    return c.select("conv_id", "turn", F.concat(pick(OPENINGS, at), F.lit(" "), "text").alias("text"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "role")


ASKED = f"""asked AS (
  SELECT conv_id, turn, list_extract({sql_list(OPENINGS)}, CAST((conv_id + turn * 3) % {len(OPENINGS)} AS INTEGER) + 1)
         || ' ' || text AS text, conv_id * 1000 + turn AS qid, role
  FROM conversations)"""


def dict_cte(name: str, dictionary: dict[str, list[str]] | list[str]) -> str:
    """A dictionary as a table ``(label, label_pos, phrase)``."""
    if isinstance(dictionary, list):
        dictionary = {"x": dictionary}
    rows = [f"('{label}', {i}, '{p.replace(chr(39), chr(39) * 2)}')"
            for i, (label, ps) in enumerate(dictionary.items()) for p in ps]
    return f"{name}(label, label_pos, phrase) AS (VALUES {', '.join(rows)})"


def found_cte(name: str, source: str, key: str, dictionary: str, text: str = "trim(lower(text))") -> str:
    """Labels found in each text: ``(key, label, label_pos)``."""
    return f"""{name} AS (SELECT DISTINCT {key}, label, label_pos
  FROM (SELECT {key}, {text} AS lowered FROM {source}) JOIN {dictionary} ON contains(lowered, phrase))"""


# ---- logs -----------------------------------------------------------------------------

def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: client and key from the user, route from the kind of event, tier by user."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("key"), F.col("user_id").alias("client"),
        F.col("event_type").alias("route"),
        F.when(F.col("user_id") % 10 == 0, F.lit("premium")).otherwise(F.lit("basic")).alias("tier"))


LOG = """log AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS key, user_id AS client, event_type AS route,
         CASE WHEN user_id % 10 = 0 THEN 'premium' ELSE 'basic' END AS tier
  FROM events)"""


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates that each carry some of the fields."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_type") == "view", F.concat(F.lit("seen "), F.col("event_id"))).alias("message"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("progress"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("devices_processed"))


STATUS = """status AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type = 'view' THEN 'seen ' || event_id END AS message,
         CASE WHEN event_type = 'click' THEN value END AS progress,
         CASE WHEN event_type = 'purchase' THEN event_id END AS devices_processed
  FROM events)"""
