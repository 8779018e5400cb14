"""Conversations, stored responses and the fallback category."""

from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.operators import dialogue as C
from wiring import tables as T
from wiring.registry import ctes, query


@query("W7_context", """
SELECT a.conv_id, a.turn, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.n) - 1 AS place, b.role, b.text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a
JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) b
  ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 4 AND a.n""")
def context(spark, d):
    rows = C.context(T.table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.posexplode_outer("context").alias("place", "m")).select(
        "conv_id", "turn", F.col("place").cast("bigint").alias("place"), "m.role", "m.text")


CATEGORY = (T.dict_cte("dict", D.CONVERSATION), """cats AS (
  SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text, coalesce(min_by(label, label_pos), 'default') AS category
  FROM conversations LEFT JOIN dict ON contains(lower(text), phrase) AND trim(text) <> '' GROUP BY 1, 2)""")


@query("W8_prompt_text", ctes(*CATEGORY) + """
SELECT conv_id, turn, 'I am Assistant, a helpful AI assistant for mobile devices. '
  || CASE category WHEN 'greeting' THEN 'I greet users warmly. ' WHEN 'farewell' THEN 'I say goodbye politely. '
     WHEN 'thanks' THEN 'I respond to gratitude graciously. ' WHEN 'identity' THEN 'I explain who I am and what I can do. '
     WHEN 'confusion' THEN 'I help clarify misunderstandings. ' ELSE '' END
  || coalesce(lag(said, 2) OVER w, '') || coalesce(lag(said, 1) OVER w, '') || said || 'Assistant: ' AS prompt
FROM (SELECT *, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text || ' ' AS said FROM cats)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prompt_text(spark, d):
    return C.prompt_text(T.table(spark, d, "conversations")).select("conv_id", "turn", "prompt")


SPACE = "' ' || chr(9) || chr(10) || chr(13)"


@query("N13_clean_reply", f"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE
  trim(regexp_replace(replace(trim(text, {SPACE}), chr(10), ' '), '\\s+', ' ', 'g')) END AS reply FROM conversations""")
def clean_reply(spark, d):
    """Replies with a second speaker behind them, every third with one in front."""
    text = F.concat(F.when(F.col("turn") % 3 == 0, F.lit(" User: ")).otherwise(F.lit("")), "text", F.lit(" \n Assistant: more\nUser: even more"))
    return T.table(spark, d, "conversations").select("conv_id", "turn", C.clean_reply(text).alias("reply"))


@query("G8_response_store", ctes(*CATEGORY) + """
SELECT category, response, row_number() OVER (PARTITION BY category ORDER BY pos) - 1 AS place FROM (
  SELECT category, text AS response, min(conv_id * 1000 + turn) AS pos FROM cats GROUP BY 1, 2)""")
def response_store(spark, d):
    from devicelode.operators.tagging import conv_category

    rows = conv_category(T.table(spark, d, "conversations")).select(
        "category", F.col("text").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return C.response_store(rows).select("category", "response", "place")


@query("G8_responses_for", ctes(*CATEGORY) + "SELECT DISTINCT category, text AS response FROM cats WHERE category = 'negation'")
def responses_for(spark, d):
    from devicelode.operators.tagging import conv_category

    rows = conv_category(T.table(spark, d, "conversations")).select(
        "category", F.col("text").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return C.responses_for(C.response_store(rows), "negation").select("category", "response")


PATTERN_ROWS = []
_place = 0
for _c, _ps in D.CONVERSATION.items():
    for _p, _own in [(p, False) for p in _ps] + [(_c, True)]:
        PATTERN_ROWS.append(f"({_place}, '{_p.replace(chr(39), chr(39) * 2)}', '{_c}', {3 if _own else 1}, {str(_own).lower()})")
        _place += 1
NGRAMS = """SELECT {key}, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))],
    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS term
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source})"""


def _words(n: str) -> str:
    """A question of words that no category phrase is part of, but near to some."""
    return (f"list_extract(['perfect jobs', 'your purposes name', 'created a name', 'questions', 'feelings', 'terribles', 'me tell', "
            f"'understand', 'until next', 'identity', 'is mean', 'you appreciate it', 'ggg', 'my praise', 'thank you very'], CAST({n} % 15 AS INTEGER) + 1)")


@query("N11_tfidf_category", ctes(
    f"pattern_list(place, pattern, category, weight, own) AS (VALUES {', '.join(PATTERN_ROWS)})",
    T.dict_cte("dict", D.CONVERSATION),
    "store AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'praise' WHEN 1 THEN 'identity' ELSE 'other' END AS category, c_mktsegment AS response FROM customer)",
    "stored AS (SELECT category AS owner, count(DISTINCT response) AS more FROM store GROUP BY 1)",
    """patterns AS (
  SELECT min(place) AS place, pattern, max_by(category, place) AS category, sum(weight + CASE WHEN own THEN coalesce(more, 0) ELSE 0 END) AS weight
  FROM pattern_list LEFT JOIN stored ON own AND owner = category GROUP BY pattern)""",
    "sizes AS (SELECT sum(weight) + 1 AS n FROM patterns)",
    f"""texts AS (SELECT doc_id AS qid, {_words('doc_id')} || ' ' || text AS text FROM documents
  UNION ALL SELECT -1 - doc_id, {_words('doc_id')} FROM documents)""",
    "direct AS (SELECT qid, min_by(label, label_pos) AS category FROM texts JOIN dict ON contains(lower(text), phrase) GROUP BY qid)",
    "undecided AS (SELECT * FROM texts WHERE qid NOT IN (SELECT qid FROM direct))",
    f"pterms AS (SELECT place, weight, term, count(*) AS tf FROM ({NGRAMS.format(key='place, weight', text='pattern', source='patterns')}) GROUP BY 1, 2, 3)",
    "pdf AS (SELECT term, sum(weight) AS df FROM pterms GROUP BY term)",
    f"qterms AS (SELECT qid, term, count(*) AS tf FROM ({NGRAMS.format(key='qid', text='text', source='undecided')}) GROUP BY 1, 2)",
    """qw AS (SELECT qid, q.term, tf, CASE WHEN coalesce(df, 0) + 1 <= 0.9 * n THEN tf * (ln((1 + n) / (coalesce(df, 0) + 2)) + 1) ELSE 0 END AS w
  FROM qterms q LEFT JOIN pdf p ON p.term = q.term, sizes)""",
    "qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid)",
    """near AS (SELECT DISTINCT qid, place FROM qw JOIN pterms USING (term))""",
    # The whole pattern vector is rebuilt for each text it meets.
    """pw AS (SELECT near.qid, near.place, t.term, CASE WHEN q.term IS NOT NULL AND df + 1 <= 0.9 * n THEN t.tf * (ln((1 + n) / (df + 2)) + 1)
     WHEN q.term IS NULL AND df <= 0.9 * n THEN t.tf * (ln((1 + n) / (df + 1)) + 1) ELSE 0 END AS pw, coalesce(q.w, 0) AS w
  FROM near JOIN pterms t USING (place) JOIN pdf ON pdf.term = t.term LEFT JOIN qw q ON q.qid = near.qid AND q.term = t.term, sizes)""",
    "sims AS (SELECT qid, place, round(sum(w * pw) / (sqrt(sum(pw * pw)) * any_value(norm)), 9) AS sim FROM pw JOIN qn USING (qid) GROUP BY 1, 2)",
    "best AS (SELECT qid, place, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, place) AS r FROM sims)") + """
SELECT t.qid, coalesce(d.category, CASE WHEN b.sim > 0.3 THEN p.category END, 'default') AS category, coalesce(round(b.sim, 6), -1.0) AS similarity
FROM texts t LEFT JOIN direct d USING (qid) LEFT JOIN best b ON b.qid = t.qid AND r = 1 LEFT JOIN patterns p ON p.place = b.place""")
def tfidf_category(spark, d):
    """Every document behind an opening, and every opening alone (by negative ids); stored responses weigh two of the categories."""
    openings = ["perfect jobs", "your purposes name", "created a name", "questions", "feelings", "terribles", "me tell", "understand",
                "until next", "identity", "is mean", "you appreciate it", "ggg", "my praise", "thank you very"]
    opening = T.pick(openings, F.col("doc_id") % 15)
    docs = T.wide_table(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("qid"), F.concat(opening, F.lit(" "), F.col("text")).alias("text")).unionByName(
        docs.select((-1 - F.col("doc_id")).alias("qid"), opening.alias("text")))
    k = F.col("c_nationkey") % 3
    store = T.table(spark, d, "customer").select(
        F.when(k == 0, F.lit("praise")).when(k == 1, F.lit("identity")).otherwise(F.lit("other")).alias("category"),
        F.col("c_mktsegment").alias("response"))
    out = C.tfidf_category(q, store)
    return out.select("qid", "category", F.coalesce(F.round("similarity", 6), F.lit(-1.0)).alias("similarity"))
