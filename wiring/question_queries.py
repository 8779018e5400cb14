"""Tags, intents, mentions, comparisons and recommendations for questions."""

from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.operators import mentions as M
from devicelode.operators import specs as S
from devicelode.operators import tagging as N
from devicelode.plans import questions as P
from devicelode.session import unsent
from wiring import tables as T
from wiring.catalogue_queries import FOCUSES
from wiring.spec_queries import FACTS
from wiring.registry import ctes, query

FEATURES = (T.dict_cte("dict", D.FEATURES), T.found_cte("found", "asked", "qid", "dict"))


def _joined(c):
    return F.array_join(c, ",")


@query("J10_tag", ctes(T.dict_cte("dict", D.SENTIMENT), T.found_cte("found", "documents", "doc_id", "dict")) + """
SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY label_pos), '') AS tags FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""")
def tag(spark, d):
    return N.tag(T.wide_table(spark, d, "documents"), "text", D.SENTIMENT).select("doc_id", _joined("tags").alias("tags"))


@query("J10_tag_whole_words", """
SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_à-ÿœß])(the|of)($|[^a-z0-9_à-ÿœß])') AS english,
       regexp_matches(lower(text), '(^|[^a-z0-9_à-ÿœß])(und|der)($|[^a-z0-9_à-ÿœß])') AS german FROM documents""")
def tag_whole_words(spark, d):
    dictionary = {"english": ["the", "of"], "german": ["und", "der"]}
    rows = N.tag(T.wide_table(spark, d, "documents"), "text", dictionary, word_boundary=True)
    return rows.select("doc_id", *[F.array_contains("tags", c).alias(c) for c in dictionary])


@query("N1_feature_tags", ctes(T.ASKED, *FEATURES) + """
SELECT qid, coalesce(string_agg(label, ',' ORDER BY label_pos), '') AS features FROM asked LEFT JOIN found USING (qid) GROUP BY qid""")
def feature_tags(spark, d):
    return N.feature_tags(T.asked(spark, d)).select("qid", _joined("features").alias("features"))


@query("N1_feature_tags_documents", ctes(T.dict_cte("dict", D.FEATURES), T.found_cte("found", "documents", "doc_id", "dict")) + """
SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY label_pos), '') AS features FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""")
def feature_tags_documents(spark, d):
    return N.feature_tags(T.wide_table(spark, d, "documents")).select("doc_id", _joined("features").alias("features"))


@query("N2_spec_tags", ctes(T.ASKED, T.dict_cte("dict", D.SPEC_REQUESTS), T.found_cte("found", "asked", "qid", "dict")) + """
SELECT qid, coalesce(string_agg(label, ',' ORDER BY label_pos), '') AS specifications FROM asked LEFT JOIN found USING (qid) GROUP BY qid""")
def spec_tags(spark, d):
    return N.spec_tags(T.asked(spark, d)).select("qid", _joined("specifications").alias("specifications"))


FLAGS = ("flag_words(label, phrase) AS (SELECT 'recommendation', unnest({}) UNION ALL SELECT 'comparison', unnest({}) "
         "UNION ALL SELECT 'specification', unnest({}))").format(
    T.sql_list(D.RECOMMENDATION), T.sql_list(D.COMPARISON), T.sql_list(D.SPECIFICATION))


@query("N3_phrase_flags", ctes(T.ASKED, FLAGS) + """
SELECT qid, bool_or(label = 'recommendation' AND hit) AS recommendation, bool_or(label = 'comparison' AND hit) AS comparison,
       bool_or(label = 'specification' AND hit) AS specification
FROM (SELECT qid, label, contains(lower(text), phrase) AS hit FROM asked, flag_words) GROUP BY qid""")
def phrase_flags(spark, d):
    return N.phrase_flags(T.asked(spark, d)).select("qid", "recommendation", "comparison", "specification")


def _intent_sql(source: str, n_devices: str) -> str:
    """Scores of every intent as rows ``(qid, ord, intent, score)``."""
    simple = "".join(
        f" UNION ALL SELECT qid, {8 + i}, '{name}', 0.5 FROM lowered WHERE " + " OR ".join(f"contains(t, '{p}')" for p in ps)
        for i, (name, ps) in enumerate(D.SIMPLE_INTENTS.items()))
    return f"""lowered AS (SELECT qid, trim(lower(text)) AS t, {n_devices} AS n FROM {source}),
flagged AS (SELECT DISTINCT qid, label FROM lowered JOIN flag_words ON contains(t, phrase)),
sdict_hits AS (SELECT DISTINCT qid FROM lowered JOIN sdict ON contains(t, phrase)),
fhits AS (SELECT DISTINCT qid, label FROM lowered JOIN dict ON contains(t, phrase)),
scores AS (
  SELECT qid, 0 AS ord, 'device_search' AS intent, 0.7 AS score FROM lowered WHERE n > 0
  UNION ALL SELECT qid, 1, 'recommendation', 0.7 FROM flagged WHERE label = 'recommendation'
  UNION ALL SELECT qid, 2, 'specification', 0.7 FROM sdict_hits
  UNION ALL SELECT qid, 3, 'comparison', 0.7 FROM flagged WHERE label = 'comparison'
  UNION ALL SELECT qid, CASE label WHEN 'camera' THEN 4 WHEN 'battery' THEN 5 WHEN 'performance' THEN 6 ELSE 7 END, label, 0.7
    FROM fhits WHERE label IN ('camera', 'battery', 'performance', 'display'){simple}),
scored AS (
  SELECT * FROM scores UNION ALL SELECT qid, 99, 'general', 0.3 FROM lowered WHERE qid NOT IN (SELECT qid FROM scores)),
intent_rank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS place FROM scored),
primary_two AS (
  SELECT qid, max(intent) FILTER (WHERE place = 1) AS primary_intent, max(CAST(score AS DOUBLE)) FILTER (WHERE place = 1) AS confidence,
         coalesce(max(intent) FILTER (WHERE place = 2), '-') AS secondary_intent FROM intent_rank GROUP BY qid)"""


DICTS = (FLAGS, T.dict_cte("sdict", D.SPEC_REQUESTS), T.dict_cte("dict", D.FEATURES))


@query("N4_intent_scores", ctes(T.ASKED, *DICTS, _intent_sql("asked", "0")) + """
SELECT qid, intent, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS place FROM scored""")
def intent_scores(spark, d):
    rows = N.intent_scores(T.asked(spark, d)).select("qid", F.posexplode_outer("intents").alias("place", "i"))
    return rows.select("qid", "i.intent", "i.score", F.col("place").cast("bigint").alias("place"))


@query("W2_rank_intents", ctes(T.ASKED, *DICTS, _intent_sql("asked", "0")) + "SELECT * FROM primary_two")
def rank_intents(spark, d):
    ranked = N.rank_intents(N.intent_scores(T.asked(spark, d)))
    return ranked.select("qid", "primary_intent", F.coalesce("secondary_intent", F.lit("-")).alias("secondary_intent"), "confidence")


RESPONSE = """CASE WHEN bool_or(intent = 'comparison') AND max(n_devices) >= 2 THEN 'comparison'
       WHEN max(n_devices) > 0 AND bool_or(intent = 'specification') THEN 'device_specs'
       WHEN max(n_devices) > 0 THEN 'device_details'
       WHEN bool_or(intent = 'recommendation') THEN 'recommendations' ELSE 'conversation' END"""


@query("N5_response_type", ctes(T.ASKED, *DICTS, _intent_sql("asked", "qid % 3")) + f"""
SELECT qid, {RESPONSE.replace('max(n_devices)', 'max(qid % 3)')} AS response_type FROM scored GROUP BY qid""")
def response_type(spark, d):
    """With zero, one or two devices taken as found."""
    q = N.intent_scores(T.asked(spark, d).withColumn("n_devices", F.col("qid") % 3))
    return q.select("qid", N.response_type(F.col("intents"), F.col("n_devices")).alias("response_type"))


@query("N6_analyze", ctes(T.CAT, T.QUESTIONS, T.MATCHES, *DICTS,
                         "counts AS (SELECT q.qid, q.text, count(m.device) AS n_devices FROM questions q LEFT JOIN matches m USING (qid) GROUP BY 1, 2)",
                         _intent_sql("counts", "n_devices"),
                         f"kinds AS (SELECT qid, {RESPONSE} AS response_type FROM scored JOIN counts USING (qid) GROUP BY qid)",
                         "lists AS (SELECT qid, string_agg(brand || ' ' || device, '|' ORDER BY rank) AS devices FROM ranked GROUP BY qid)",
                         "firsts AS (SELECT qid, brand, min(rank) AS rank FROM ranked GROUP BY 1, 2)",
                         "brand_lists AS (SELECT qid, string_agg(brand, '|' ORDER BY rank) AS brands FROM firsts GROUP BY qid)",
                         "feature_lists AS (SELECT qid, string_agg(label, '|' ORDER BY label_pos) AS features FROM (SELECT DISTINCT qid, label, label_pos FROM lowered JOIN dict ON contains(t, phrase)) GROUP BY qid)",
                         "spec_lists AS (SELECT qid, string_agg(label, '|' ORDER BY label_pos) AS specifications FROM (SELECT DISTINCT qid, label, label_pos FROM lowered JOIN sdict ON contains(t, phrase)) GROUP BY qid)",
                         "intent_lists AS (SELECT qid, string_agg(intent, '|' ORDER BY ord) AS intents FROM scored GROUP BY qid)") + """
SELECT c.qid, c.n_devices, coalesce(r.brand, '-') AS first_brand, coalesce(r.device, '-') AS first_device, primary_intent,
       secondary_intent, confidence, response_type, coalesce(devices, '') AS devices, coalesce(brands, '') AS brands,
       coalesce(features, '') AS features, coalesce(specifications, '') AS specifications, intents
FROM counts c LEFT JOIN ranked r ON r.qid = c.qid AND r.rank = 1 JOIN primary_two p ON p.qid = c.qid JOIN kinds k ON k.qid = c.qid
LEFT JOIN lists l ON l.qid = c.qid LEFT JOIN brand_lists b ON b.qid = c.qid LEFT JOIN feature_lists f ON f.qid = c.qid LEFT JOIN spec_lists s ON s.qid = c.qid JOIN intent_lists i ON i.qid = c.qid""")
def analyze(spark, d):
    a = P.analyze(T.questions(spark, d), T.wide_catalogue(spark, d))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    names = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "|")
    return a.select("qid", "n_devices", dash("first_brand"), dash("first_device"), "primary_intent", dash("secondary_intent"),
                    "confidence", "response_type", names("devices", "full_name").alias("devices"), F.array_join("brands", "|").alias("brands"),
                    F.array_join("features", "|").alias("features"), F.array_join("specifications", "|").alias("specifications"),
                    names("intents", "intent").alias("intents"))


@query("N7_brand_focus", ctes(T.ASKED, "names AS (SELECT unnest({0}) AS name, generate_subscripts({0}, 1) AS place)".format(T.sql_list(D.BRAND_NAMES))) + """
SELECT qid, coalesce(min_by(name, place), '-') AS brand_focus FROM asked LEFT JOIN names ON contains(lower(text), name) GROUP BY qid""")
def brand_focus(spark, d):
    return N.brand_focus(T.asked(spark, d)).select("qid", F.coalesce("brand_focus", F.lit("-")).alias("brand_focus"))


TIER_SQL = """CASE WHEN bool_or(label = 'budget') THEN 'budget' WHEN bool_or(label = 'mid_range') THEN 'mid_range' ELSE 'high_end' END"""


@query("N8_tier_and_focus", ctes(T.ASKED, *FEATURES) + f"""
SELECT qid, {TIER_SQL} AS tier, coalesce(string_agg(label, ',' ORDER BY label_pos) FILTER (WHERE label_pos > 2), '') AS focus_areas
FROM asked LEFT JOIN found USING (qid) GROUP BY qid""")
def tier_and_focus(spark, d):
    return N.tier_and_focus(T.asked(spark, d)).select("qid", "tier", _joined("focus_areas").alias("focus_areas"))


@query("N9_conv_category", ctes(T.dict_cte("dict", D.CONVERSATION)) + """
SELECT conv_id, turn, coalesce(min_by(label, label_pos), 'default') AS category
FROM conversations LEFT JOIN dict ON contains(lower(text), phrase) AND trim(text) <> '' GROUP BY 1, 2""")
def conv_category(spark, d):
    return N.conv_category(T.table(spark, d, "conversations")).select("conv_id", "turn", "category")


def _any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


@query("N10_cascade_category", ctes(T.CAT, T.QUESTIONS, T.MATCHES) + f"""
SELECT qid, CASE
  WHEN {_any('t', D.DEVICE_TYPES)} THEN CASE WHEN {_any('t', D.RECOMMENDATION)} THEN 'recommendation' ELSE 'device_search' END
  WHEN {_any('t', D.BRAND_NAMES)} AND {_any('t', D.RECOMMENDATION)} THEN 'recommendation'
  WHEN {_any('t', D.COMPARISON)} THEN 'comparison'
  WHEN {_any('t', D.SPECIFICATION)} THEN 'specification'
  WHEN {_any('t', D.FEATURES['camera'])} THEN 'camera'
  WHEN {_any('t', D.FEATURES['battery'])} THEN 'battery'
  WHEN {_any('t', D.FEATURES['performance'])} THEN 'performance'
  WHEN {_any('t', D.FEATURES['display'])} THEN 'display'
  WHEN {_any('t', D.RECOMMENDATION)} THEN 'recommendation'
  WHEN {_any('t', D.SIMPLE_CATEGORIES['greeting'])} THEN 'greeting'
  WHEN {_any('t', D.SIMPLE_CATEGORIES['farewell'])} THEN 'farewell'
  WHEN {_any('t', D.SIMPLE_CATEGORIES['thanks'])} THEN 'thanks'
  WHEN {_any('t', D.SIMPLE_CATEGORIES['identity'])} THEN 'identity'
  WHEN {_any('t', D.SIMPLE_CATEGORIES['help'])} THEN 'help'
  WHEN qid IN (SELECT qid FROM matches WHERE with_brand) THEN 'device_search' ELSE 'general' END AS category
FROM (SELECT qid, lower(text) AS t FROM questions)""")
def cascade_category(spark, d):
    return P.categories(T.questions(spark, d), T.wide_catalogue(spark, d)).select("qid", "category")


SHIPPED = {"query_type": D.QUERY_TYPES, "sentiment": D.SENTIMENT, "usage": D.USAGE_PATTERNS, "topic": D.TECHNICAL_TOPICS,
           "trouble": D.TROUBLESHOOTING}
SHIPPED_SQL = [T.dict_cte(f"d_{n}", dic) for n, dic in SHIPPED.items()] + [
    T.found_cte(f"f_{n}", "documents", "doc_id", f"d_{n}") for n in SHIPPED]


@query("N12_shipped_dictionaries", ctes(*SHIPPED_SQL) + "SELECT doc_id, " + ", ".join(
    f"coalesce((SELECT string_agg(label, ',' ORDER BY label_pos) FROM f_{n} f WHERE f.doc_id = d.doc_id), '') AS {n}" for n in SHIPPED)
    + " FROM documents d")
def shipped_dictionaries(spark, d):
    rows = N.lowered(T.wide_table(spark, d, "documents"))
    return rows.select("doc_id", *[_joined(N.labels_found("_text", dic)).alias(n) for n, dic in SHIPPED.items()])


# ---- mentions -------------------------------------------------------------------

MENTION_SQL = ctes(T.CAT, T.QUESTIONS, T.MATCHES) + "SELECT qid, rank, brand, device, pos FROM ranked"


def _mentions(df):
    return df.select("qid", F.col("rank").cast("bigint").alias("rank"), "brand", "device", "pos")


@query("J6_device_mentions", MENTION_SQL)
def device_mentions(spark, d):
    return _mentions(M.device_mentions(T.questions(spark, d), T.wide_catalogue(spark, d)))


@query("J6_device_mentions_shuffled", MENTION_SQL)
def device_mentions_shuffled(spark, d):
    """The same by the way for catalogues too large to broadcast."""
    return _mentions(M.device_mentions(T.questions(spark, d), T.wide_catalogue(spark, d), broadcast_names=0))


@query("W1_first_mentions", ctes(T.CAT, T.QUESTIONS, T.MATCHES) + "SELECT qid, rank, brand, device, pos FROM ranked WHERE rank <= 2")
def first_mentions(spark, d):
    return _mentions(M.device_mentions(T.questions(spark, d), T.wide_catalogue(spark, d), top=2))


@query("J7_first_pair_mention", ctes(T.CAT, T.QUESTIONS, T.MATCHES) + """
SELECT qid, min(pos) AS pos, min_by(device, pos) AS device FROM matches WHERE with_brand GROUP BY qid""")
def first_pair_mention(spark, d):
    return M.first_pair_mention(T.questions(spark, d), T.wide_catalogue(spark, d)).select("qid", "pos", "device")


@query("F6_match_partial", ctes(T.CAT) + """,
asked AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN brand_name ELSE 'brand#1' END AS b,
                 CASE WHEN o_orderkey % 4 = 0 THEN device_name ELSE split_part(device_name, ' ', 2) END AS d
          FROM orders JOIN cat ON pos = o_custkey),
exact AS (SELECT qid, pos FROM asked JOIN cat ON lower(brand_name) = lower(b) AND lower(device_name) = lower(d)),
part_of AS (SELECT DISTINCT b, d, pos FROM (SELECT DISTINCT lower(b) AS b, lower(d) AS d FROM asked)
            JOIN cat ON contains(lower(brand_name), b) AND contains(lower(device_name), d)),
partial AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM asked JOIN part_of p ON p.b = lower(asked.b) AND p.d = lower(asked.d)
            WHERE qid NOT IN (SELECT qid FROM exact))
SELECT qid, pos, 'exact' AS how FROM exact UNION ALL SELECT qid, pos, 'partial' FROM partial WHERE n <= 10""".replace("\nasked", "asked", 1))
def match_partial(spark, d):
    """Whole names for some questions, a brand and one word of a name for others."""
    cat = T.wide_catalogue(spark, d)
    k = F.col("o_orderkey")
    asked = T.table(spark, d, "orders").join(cat, F.col("o_custkey") == F.col("pos")).select(
        k.alias("qid"), F.when(k % 2 == 0, F.col("brand_name")).otherwise(F.lit("brand#1")).alias("brand"),
        F.when(k % 4 == 0, F.col("device_name")).otherwise(F.get(F.split("device_name", " "), F.lit(1))).alias("device"))
    return M.match_partial(T.questions(spark, d), asked, cat).select("qid", "pos", "how")


# ---- comparison and recommendation -------------------------------------------------

PATHS = "paths(kind, path_pos, path) AS (VALUES " + ", ".join(
    f"('{k}', {i}, '{p}')" for k, ps in D.SPEC_PATHS.items() for i, p in enumerate(ps)) + ")"
COMPARED = f"""hits AS (
  SELECT s.pos, kind, path_pos, 0 AS depth, co, coalesce(ko, 0) AS ko, coalesce(key, path) AS key, value FROM spec_rows s JOIN paths ON cat = path
  UNION ALL SELECT s.pos, kind, path_pos, 1, co, 0, path, value FROM spec_rows s JOIN paths ON key = path),
kept AS (SELECT *, row_number() OVER (PARTITION BY pos, kind, lower(key) ORDER BY path_pos, depth, co, ko) AS n FROM hits),
compared AS (SELECT pos, kind, string_agg(key || ': ' || value, ', ' ORDER BY path_pos, depth, co, ko) AS value FROM kept WHERE n = 1 GROUP BY 1, 2),
spec_found AS (SELECT DISTINCT qid, label, label_pos FROM questions JOIN sdict ON contains(lower(text), phrase)),
spec_asked AS (
  SELECT qid, label AS spec, row_number() OVER (PARTITION BY qid ORDER BY label_pos) - 1 AS place FROM spec_found
  UNION ALL SELECT qid, v.spec, v.place FROM questions, (VALUES ('processor', 0), ('camera', 1), ('display', 2), ('battery', 3), ('memory', 4)) v(spec, place)
  WHERE qid NOT IN (SELECT qid FROM spec_found)),
pairs AS (SELECT a.qid, a.pos AS pos_1, b.pos AS pos_2 FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.rank = 1 AND b.rank = 2)"""


COMPARE_SQL = ctes(T.CAT, T.QUESTIONS, T.MATCHES, T.SPEC_ROWS, PATHS, T.dict_cte("sdict", D.SPEC_REQUESTS), COMPARED) + """
SELECT p.qid, CAST(place AS BIGINT) AS place, s.spec, c1.brand_name || ' ' || c1.device_name AS device_1, coalesce(v1.value, 'Not specified') AS value_1,
       c2.brand_name || ' ' || c2.device_name AS device_2, coalesce(v2.value, 'Not specified') AS value_2
FROM pairs p JOIN spec_asked s ON s.qid = p.qid JOIN cat c1 ON c1.pos = pos_1 JOIN cat c2 ON c2.pos = pos_2
LEFT JOIN compared v1 ON v1.pos = pos_1 AND v1.kind = s.spec LEFT JOIN compared v2 ON v2.pos = pos_2 AND v2.kind = s.spec"""


@query("J9_compare", COMPARE_SQL)
def compare(spark, d):
    out = P.compare(T.questions(spark, d), T.wide_catalogue(spark, d), T.spec_documents(spark, d))
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("K6_compare_values", ctes(T.CAT, T.QUESTIONS, T.SPEC_ROWS, PATHS, T.dict_cte("sdict", D.SPEC_REQUESTS),
                                 "ranked AS (SELECT qid, 0 AS rank, 0 AS pos FROM questions)", COMPARED) + """
SELECT p_partkey AS pos, kind, coalesce(value, 'Not specified') AS value FROM part CROSS JOIN (SELECT DISTINCT kind FROM paths) k
LEFT JOIN compared c ON c.pos = p_partkey AND c.kind = k.kind""".replace("p_partkey AS pos, kind", "p_partkey AS pos, k.kind"))
def compare_values(spark, d):
    """Every kind of every device as the text shown in comparisons."""
    docs = S.with_entries(S.with_nested(S.parse_specs(
        T.wide_catalogue(spark, d).join(unsent(T.spec_documents(spark, d).drop("name")), "device_url"))))
    return docs.select("pos", F.explode_outer(S.comparison_texts(F.col("entries"))).alias("kind", "value"))


@query("K7_compare_status", ctes(T.CAT, T.QUESTIONS, T.MATCHES) + """,
sided AS (SELECT q.qid, count(rank) AS n, count(rank) FILTER (WHERE rank <= 2 AND pos % 3 = 1) AS unknown FROM questions q LEFT JOIN ranked USING (qid) GROUP BY q.qid)
SELECT qid, CASE WHEN n < 2 THEN 'too_few' WHEN unknown > 0 THEN 'not_found' ELSE 'ok' END AS status,
       CASE WHEN n < 2 THEN 'I need at least two devices to compare. Please specify the devices you want to compare.'
            WHEN unknown > 0 THEN 'I couldn''t find enough information to compare these devices.' END AS message FROM sided""")
def compare_status(spark, d):
    """Every third device of the catalogue isn't among those that can be compared."""
    cat = T.wide_catalogue(spark, d)
    return P.compare_status(T.questions(spark, d), cat, within=cat.filter("pos % 3 <> 1"))


RECOMMEND = f"""asked_about AS (
  SELECT qid, {TIER_SQL} AS tier FROM asked LEFT JOIN found USING (qid) GROUP BY qid),
brand_names AS (SELECT unnest({T.sql_list(D.BRAND_NAMES)}) AS name, generate_subscripts({T.sql_list(D.BRAND_NAMES)}, 1) AS place),
about_brand AS (SELECT qid, coalesce(min_by(name, place), '') AS brand_focus FROM asked LEFT JOIN brand_names ON contains(lower(text), name) GROUP BY qid),
shown AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_focus, tier ORDER BY rank) AS place FROM tiers) WHERE place <= 5),
offers AS (SELECT a.qid, s.* FROM asked_about a JOIN about_brand b USING (qid) JOIN shown s ON s.tier = a.tier AND s.brand_focus = b.brand_focus),
focus AS (SELECT qid, label, label_pos FROM found WHERE label_pos > 2),
fact_lines AS (
  SELECT pos, 'camera' AS area, 0 AS n, 'Main camera: ' || camera AS line FROM facts WHERE camera IS NOT NULL
  UNION ALL SELECT pos, 'battery', 1, 'Battery: ' || battery FROM facts WHERE battery IS NOT NULL
  UNION ALL SELECT pos, 'performance', 2, 'Processor: ' || performance FROM facts
  UNION ALL SELECT pos, 'display', 3, 'Display: ' || display FROM facts
  UNION ALL SELECT pos, 'storage', 4, 'Storage: ' || storage FROM facts),
lines AS (
  SELECT o.qid, o.pos, n, line FROM offers o JOIN fact_lines l ON l.pos = o.pos
  WHERE o.qid NOT IN (SELECT qid FROM focus) OR EXISTS (SELECT 1 FROM focus f WHERE f.qid = o.qid AND f.label = l.area)
  UNION ALL
  SELECT o.qid, o.pos, 100 * f.label_pos + s.co, upper(f.label[1]) || f.label[2:] || CASE WHEN s.key IS NULL THEN ': ' ELSE ' - ' || s.key || ': ' END || s.value
  FROM offers o JOIN focus f ON f.qid = o.qid AND f.label NOT IN ('camera', 'battery', 'performance', 'display', 'storage')
  JOIN spec_rows s ON s.pos = o.pos AND contains(lower(s.cat), f.label) AND coalesce(s.ko, 0) = 0),
told AS (SELECT qid, pos, string_agg(line, ' | ' ORDER BY n) AS text FROM lines GROUP BY qid, pos),
areas AS (SELECT qid, string_agg(label, ', ' ORDER BY label_pos) AS list FROM focus GROUP BY qid)"""


@query("R1_recommend", ctes(T.CAT, T.NAMED, FOCUSES, T.ASKED, *FEATURES, FACTS, T.SPEC_ROWS, RECOMMEND) + """
SELECT o.qid, o.place, o.tier, o.brand_focus, o.device_url, coalesce(t.text, 'A great choice for ' || a.list, CASE o.tier WHEN 'high_end' THEN
  'Premium flagship device' WHEN 'mid_range' THEN 'Great value mid-range device' ELSE 'Affordable device with good features' END) AS highlights
FROM offers o LEFT JOIN told t ON t.qid = o.qid AND t.pos = o.pos LEFT JOIN areas a ON a.qid = o.qid""")
def recommend(spark, d):
    out = P.recommend(T.asked(spark, d).select("qid", "text"), T.named_catalogue(spark, d), T.spec_documents(spark, d))
    return out.select("qid", F.col("place").cast("bigint").alias("place"), "tier", "brand_focus", "device_url",
                      F.array_join("highlights", " | ").alias("highlights"))
