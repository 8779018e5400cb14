"""Keyword tags, intents and categories of questions ``(qid, text)``.

A phrase matches as a plain substring of the lower-cased text: "hi" is found in
"which". ``word_boundary=True`` asks for whole words instead.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.functions import normalise, strip


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_sql(text: str, phrases: Sequence[str], word_boundary: bool = False) -> str:
    if not phrases:
        return "false"
    if word_boundary:
        words = "|".join(rf"(?<!\w){re.escape(p)}(?!\w)" for p in phrases)
        return f"rlike({text}, {_quoted('(?U)' + words)})"
    return "(" + " OR ".join(f"contains({text}, {_quoted(p)})" for p in phrases) + ")"


# The tests are written as SQL text: hundreds of phrases are then one call into the JVM.

def has_any(text: str, phrases: Sequence[str], word_boundary: bool = False) -> Column:
    """True when one of the phrases is in the text column; stops at the first."""
    return F.expr(_any_sql(text, phrases, word_boundary))


def labels_found(text: str, dictionary: Mapping[str, Sequence[str]], word_boundary: bool = False) -> Column:
    """Labels with a phrase in the text column, in dictionary order."""
    cases = [f"CASE WHEN {_any_sql(text, ps, word_boundary)} THEN {_quoted(label)} END" for label, ps in dictionary.items()]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def first_label(text: str, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """First label, in dictionary order, with a phrase in the text column; else NULL."""
    cases = " ".join(f"WHEN {_any_sql(text, ps)} THEN {_quoted(label)}" for label, ps in dictionary.items())
    return F.expr(f"CASE {cases} END")


def lowered(df: DataFrame, text: str = "text", out: str = "_text") -> DataFrame:
    """Add the normalised text once, so that a hundred tests do not lower it again."""
    return df.withColumn(out, normalise(text))


def tag(df: DataFrame, text: str, dictionary: Mapping[str, Sequence[str]], out: str = "tags",
        word_boundary: bool = False) -> DataFrame:
    """Add the array of labels found in a text column."""
    return lowered(df, text).withColumn(out, labels_found("_text", dictionary, word_boundary)).drop("_text")


def feature_tags(q: DataFrame) -> DataFrame:
    return tag(q, "text", D.FEATURES, "features")


def spec_tags(q: DataFrame) -> DataFrame:
    return tag(q, "text", D.SPEC_REQUESTS, "specifications")


def phrase_flags(q: DataFrame) -> DataFrame:
    """Does the question ask for a recommendation, a comparison, specifications?"""
    t = "_text"
    return lowered(q).withColumns({
        "recommendation": has_any(t, D.RECOMMENDATION),
        "comparison": has_any(t, D.COMPARISON),
        "specification": has_any(t, D.SPECIFICATION),
    }).drop("_text")


def score_list(text: str, n_devices: Column, specs: Column, features: Column) -> Column:
    """Intents as ``array<struct<ord, intent, score>>`` in the order they are found."""
    hits: list[tuple[str, Column, float]] = [
        ("device_search", n_devices > 0, 0.7),
        ("recommendation", has_any(text, D.RECOMMENDATION), 0.7),
        ("specification", F.size(specs) > 0, 0.7),
        ("comparison", has_any(text, D.COMPARISON), 0.7),
        *[(f, F.array_contains(features, f), 0.7) for f in D.FEATURE_SPECS if f in D.FEATURES],
        *[(i, has_any(text, ps), 0.5) for i, ps in D.SIMPLE_INTENTS.items()],
    ]
    # Features enter the scores in the order of the feature dictionary.
    found = [F.when(cond, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("intent"), F.lit(score).alias("score")))
             for i, (name, cond, score) in enumerate(hits)]
    general = F.struct(F.lit(len(hits)).alias("ord"), F.lit("general").alias("intent"), F.lit(0.3).alias("score"))
    # "general" stands last and goes when anything stands before it.
    return F.filter(F.array_compact(F.array(*found, general)), lambda s, i: (i == 0) | (s["ord"] < len(hits)))


def intent_scores(q: DataFrame) -> DataFrame:
    """Add the scored intents of each question; ``n_devices`` is 0 where it is missing."""
    n_devices = F.coalesce("n_devices", F.lit(0)) if "n_devices" in q.columns else F.lit(0)
    tagged = lowered(q).withColumns({
        "_specs": labels_found("_text", D.SPEC_REQUESTS),
        "_features": labels_found("_text", D.FEATURES),
    })
    return tagged.withColumn(
        "intents", score_list("_text", n_devices, F.col("_specs"), F.col("_features"))
    ).drop("_text", "_specs", "_features")


def rank_intents(q: DataFrame) -> DataFrame:
    """Primary and secondary intent: best score first, ties in the order found."""
    ranked = F.array_sort(F.transform("intents", lambda s: F.struct(
        (-s["score"]).alias("neg"), s["ord"].alias("ord"), s["intent"].alias("intent"))))
    first, second = F.get(F.col("_r"), F.lit(0)), F.get(F.col("_r"), F.lit(1))
    return q.withColumn("_r", ranked).withColumns({
        "primary_intent": first["intent"],
        "secondary_intent": second["intent"],
        "confidence": -first["neg"],
    }).drop("_r")


def response_type(intents: Column, n_devices: Column) -> Column:
    """What kind of answer a question gets."""
    has = lambda name: F.exists(intents, lambda s: s["intent"] == name)
    return (
        F.when(has("comparison") & (n_devices >= 2), F.lit("comparison"))
        .when(has("device_search") & has("specification"), F.lit("device_specs"))
        .when(has("device_search"), F.lit("device_details"))
        .when(has("recommendation"), F.lit("recommendations"))
        .otherwise(F.lit("conversation"))
    )


def brand_focus(q: DataFrame, names: Sequence[str] = tuple(D.BRAND_NAMES)) -> DataFrame:
    """Add the first name of the list that is in the text."""
    return lowered(q).withColumn(
        "brand_focus", first_label("_text", {n: [n] for n in names})).drop("_text")


def tier_and_focus(q: DataFrame) -> DataFrame:
    """Add the price tier (the last that matches; high by default) and the other features asked for."""
    last_first = {t: D.FEATURES[t] for t in reversed(D.TIERS)}
    others = {label: ps for label, ps in D.FEATURES.items() if label not in D.TIERS}
    return lowered(q).withColumns({
        "tier": F.coalesce(first_label("_text", last_first), F.lit("high_end")),
        "focus_areas": labels_found("_text", others),
    }).drop("_text")


def conversation_categories(assistant_name: str | None = None) -> dict[str, list[str]]:
    """The category phrases, with the assistant's name among those of ``identity``."""
    cats = {c: list(ps) for c, ps in D.CONVERSATION.items()}
    if assistant_name:
        cats["identity"].append(assistant_name.lower())
    return cats


def conv_category(q: DataFrame, assistant_name: str | None = None) -> DataFrame:
    """Add the first category with a phrase in the text; none, or no text, is ``default``."""
    blank = F.coalesce(strip("text") == "", F.lit(True))
    found = first_label("_text", conversation_categories(assistant_name))
    return q.withColumn("_text", F.lower("text")).withColumn(
        "category", F.when(blank, F.lit("default")).otherwise(F.coalesce(found, F.lit("default")))).drop("_text")


def cascade_category(q: DataFrame, pair_found: Column | None = None) -> DataFrame:
    """Add the category of a question by a fixed series of tests.

    ``pair_found`` tells whether brand and name of one catalogue row are both in
    the text (see ``mentions.first_pair_mention``); it only decides at the end.
    """
    t = "_text"
    own = {f: D.FEATURES[f] for f in D.FEATURES if f in ("camera", "battery", "performance", "display")}
    asks = F.col("_asks")
    pair = pair_found if pair_found is not None else F.lit(False)
    return q.withColumn("_text", F.lower("text")).withColumn("_asks", has_any(t, D.RECOMMENDATION)).withColumn(
        "category",
        F.when(has_any(t, D.DEVICE_TYPES), F.when(asks, F.lit("recommendation")).otherwise(F.lit("device_search")))
        .when(has_any(t, D.BRAND_NAMES) & asks, F.lit("recommendation"))
        .when(has_any(t, D.COMPARISON), F.lit("comparison"))
        .when(has_any(t, D.SPECIFICATION), F.lit("specification"))
        .otherwise(F.coalesce(
            first_label(t, own),
            F.when(asks, F.lit("recommendation")),
            first_label(t, D.SIMPLE_CATEGORIES),
            F.when(pair, F.lit("device_search")),
            F.lit("general"))),
    ).drop("_text", "_asks")


def feature_to_specs(q: DataFrame, features: str = "features") -> DataFrame:
    """One row per specification kind shown for a feature of the question."""
    known = F.create_map(*[x for f, kinds in D.FEATURE_SPECS.items()
                           for x in (F.lit(f), F.array(*[F.lit(k) for k in kinds]))])
    pairs = q.withColumn("feature", F.explode_outer(features)).withColumn("_kinds", F.try_element_at(known, F.col("feature")))
    return pairs.select(*q.columns, "feature", F.posexplode_outer("_kinds").alias("place", "spec_type")).filter(
        F.col("spec_type").isNotNull())
