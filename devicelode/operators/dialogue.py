"""Conversations ``(conv_id, turn, role, text)`` and stored responses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.functions import strip
from devicelode.operators.ordered import dense_position, look_back
from devicelode.operators.tagging import conv_category, conversation_categories
from devicelode.session import checkpointed

ASSISTANT = "Assistant"

# What the prompt says about a category (fixed values).
CATEGORY_LINES = {
    "greeting": "I greet users warmly. ",
    "farewell": "I say goodbye politely. ",
    "thanks": "I respond to gratitude graciously. ",
    "identity": "I explain who I am and what I can do. ",
    "confusion": "I help clarify misunderstandings. ",
}
THRESHOLD = 0.3
MAX_DF = 0.9
NAME_WEIGHT = 3


def context(conv: DataFrame, n: int = 5) -> DataFrame:
    """Add ``context``: the message and those before it in its conversation, ``n`` at most."""
    return look_back(conv, F.struct("role", "text"), ["turn"], ["conv_id"], n, "context")


def prompt_text(conv: DataFrame, assistant_name: str = ASSISTANT) -> DataFrame:
    """Add ``prompt``: an opening, a line for the category, the last three messages."""
    opening = f"I am {assistant_name}, a helpful AI assistant for mobile devices. "
    line = F.coalesce(*[F.when(F.col("category") == c, F.lit(text)) for c, text in CATEGORY_LINES.items()], F.lit(""))
    said = F.transform("_last", lambda m: F.concat(
        F.when(m["role"] == "user", F.lit("User")).otherwise(F.lit(assistant_name)), F.lit(": "), m["text"], F.lit(" ")))
    recent = look_back(conv_category(conv, assistant_name), F.struct("role", "text"), ["turn"], ["conv_id"], 3, "_last")
    return recent.withColumn("prompt", F.concat(
        F.lit(opening), line, F.array_join(said, ""), F.lit(f"{assistant_name}: "))).drop("_last")


def clean_reply(c: Column | str, assistant_name: str = ASSISTANT) -> Column:
    """A generated reply up to the next speaker mark, on one line, single-spaced."""
    first = F.get(F.split(c, f"User:|{re.escape(assistant_name)}:"), F.lit(0))
    return F.regexp_replace(F.replace(strip(first), F.lit("\n"), F.lit(" ")), r"(?U)\s+", " ")


# ---- response store --------------------------------------------------------

def unique_responses(rows: DataFrame) -> DataFrame:
    """``(category, response, pos)``: each response once per category, where it came first."""
    return rows.groupBy("category", "response").agg(F.min("pos").alias("pos"))


def response_store(rows: DataFrame) -> DataFrame:
    """``(category, place, response)``: the different responses of each category, numbered from 0 by where they came first.

    One row per response at any size; ``collect_list`` over ``place`` is up to the caller.
    """
    placed = dense_position(unique_responses(rows), ["pos", "response"], ["category"], out="place")
    return placed.select("category", (F.col("place") - 1).alias("place"), "response")


def response_categories(store: DataFrame) -> DataFrame:
    return store.select("category").distinct()


def responses_for(store: DataFrame, category: str) -> DataFrame:
    return store.filter(F.col("category") == category).select("category", "place", "response")


# ---- fallback category -----------------------------------------------------------

def _terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, term, tf)``: word 1-, 2- and 3-grams; words have two letters or more."""
    words = df.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)).alias("w"))
    space = F.lit(" ")
    two = F.transform("w", lambda t, i: F.concat(t, space, F.get("w", i + 1)))
    three = F.transform("w", lambda t, i: F.concat(t, space, F.get("w", i + 1), space, F.get("w", i + 2)))
    grams = words.select(*keys, F.explode_outer(
        F.concat("w", F.array_compact(two), F.array_compact(three))).alias("term")).filter("term IS NOT NULL")
    return grams.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def pattern_table(spark, assistant_name: str | None = None) -> DataFrame:
    """``(place, pattern, category, owner, weight)``: the phrases and the category names, as patterns.

    A category's name stands in the list several times; ``owner`` marks it, so
    that stored responses can add to its weight. A text that is in two
    categories counts for both and answers with the later one.
    """
    rows: dict[str, list] = {}
    place = 0
    for category, phrases in conversation_categories(assistant_name).items():
        for pattern, weight, owner in [(p, 1, None) for p in phrases] + [(category, NAME_WEIGHT, category)]:
            row = rows.setdefault(pattern, [place, pattern, category, None, 0])
            row[2], row[3], row[4] = category, owner or row[3], row[4] + weight
            place += 1
    return spark.createDataFrame([tuple(r) for r in rows.values()],
                                 "place int, pattern string, category string, owner string, weight bigint")


def tfidf_category(q: DataFrame, responses: DataFrame | None = None, assistant_name: str | None = None) -> DataFrame:
    """Add ``category`` and ``similarity``: by phrase, else by the most similar pattern, else ``default``.

    The similarity is the cosine of TF-IDF vectors fitted on all patterns and
    the one text: with n = patterns + 1, idf(t) = ln((1 + n) / (1 + df(t))) + 1,
    where the text counts as one more document for its own terms. That adds 1
    to df at most, so all texts share one pass of joins. ``responses`` is a
    table ``(category, response)`` whose rows weigh their category's name.
    """
    spark = q.sparkSession
    by_phrase = conv_category(q, assistant_name)
    patterns = pattern_table(spark, assistant_name)
    if responses is not None:
        more = responses.select("category", "response").distinct().groupBy(F.col("category").alias("owner")).agg(
            F.count(F.lit(1)).alias("_more"))
        patterns = patterns.join(more, "owner", "left").withColumn(
            "weight", F.col("weight") + F.coalesce("_more", F.lit(0))).drop("_more")
    # The patterns come from fixed lists, about a hundred, whatever the data: safe to broadcast.
    patterns = checkpointed(patterns.select("place", "pattern", "category", "weight"))
    n = patterns.agg(F.sum("weight") + 1).scalar()

    def idf(df):
        return F.when(df <= F.lit(MAX_DF) * n, F.log((F.lit(1) + n) / (df + 1)) + 1).otherwise(F.lit(0.0))

    pattern_terms = _terms(patterns.select("place", "weight", "pattern"), ["place", "weight"], "pattern")
    df_of = pattern_terms.groupBy("term").agg(F.sum("weight").alias("df"))
    weighed = checkpointed(pattern_terms.join(df_of, "term").select(
        "place", "term", "df", "tf", idf(F.col("df")).alias("idf_out"), idf(F.col("df") + 1).alias("idf_in")))
    base = weighed.groupBy("place").agg(F.sum(F.pow(F.col("tf") * F.col("idf_out"), 2)).alias("base"))
    vocabulary = weighed.groupBy("term").agg(
        F.max("df").alias("df"), F.collect_list(F.struct("place", "tf", "idf_in", "idf_out")).alias("used_in"))

    open_q = by_phrase.filter((F.col("category") == "default") & (strip("text") != "")).select("qid", "text")
    mine = _terms(open_q, ["qid"], "text").join(F.broadcast(vocabulary), "term", "left").withColumn(
        "w", F.col("tf") * idf(F.coalesce("df", F.lit(0)) + 1))
    # What a term adds to the text's own norm (place -1), and to each pattern it is in.
    part = "struct<place: int, dot: double, shift: double>"
    own = F.struct(F.lit(-1), F.col("w") * F.col("w"), F.lit(0.0)).cast(part)
    shared = F.transform("used_in", lambda p: F.struct(
        p["place"], F.col("w") * p["tf"] * p["idf_in"],
        F.pow(p["tf"], F.lit(2)) * (F.pow(p["idf_in"], F.lit(2)) - F.pow(p["idf_out"], F.lit(2)))).cast(part))
    sums = mine.select("qid", F.inline_outer(F.concat(F.array(own), F.coalesce(shared, F.array().cast(f"array<{part}>"))))).groupBy(
        "qid", "place").agg(F.sum("dot").alias("dot"), F.sum("shift").alias("shift"))
    # The text's norm is the same for all its patterns, so the best is found without it.
    near = F.round(F.col("dot") / F.sqrt(F.col("base") + F.col("shift")), 9)
    best = sums.join(F.broadcast(base), "place", "left").groupBy("qid").agg(
        F.max(F.when(F.col("place") < 0, F.sqrt("dot"))).alias("norm"),
        F.max(F.when(F.col("place") >= 0, F.struct(near.alias("near"), (-F.col("place")).alias("neg")))).alias("b"))
    named = best.filter("b IS NOT NULL").select(
        "qid", F.round(F.col("b.near") / F.col("norm"), 9).alias("similarity"), (-F.col("b.neg")).alias("place")
    ).join(F.broadcast(patterns.select("place", F.col("category").alias("_near"))), "place").drop("place")
    return by_phrase.join(named, "qid", "left").withColumn(
        "category", F.when(F.col("similarity") > THRESHOLD, F.col("_near")).otherwise(F.col("category"))).drop("_near")
