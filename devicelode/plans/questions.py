"""Answers to tables of questions ``(qid, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.operators import mentions as M
from devicelode.operators import recommend as R
from devicelode.operators import specs as S
from devicelode.operators import tagging as N
from devicelode.operators.ordered import first_per_key
from devicelode.session import checkpointed, kept, unsent

# What is said when nothing can be compared (fixed values).
COMPARE_MESSAGES = {
    "too_few": "I need at least two devices to compare. Please specify the devices you want to compare.",
    "not_found": "I couldn't find enough information to compare these devices.",
}


def _tagged(q: DataFrame) -> DataFrame:
    """``(qid, row, features, specifications, intents)``: all that the text alone tells.

    Made before anything is joined, so that texts are never shuffled. ``row`` is the question's identity, since ids may be null or repeat.
    """
    tags = N.lowered(q).select(
        "qid", M.text_row().alias("row"), "_text", N.labels_found("_text", D.FEATURES).alias("features"),
        N.labels_found("_text", D.SPEC_REQUESTS).alias("specifications"))
    return tags.select("qid", "row", "features", "specifications", N.score_list(
        "_text", F.lit(0), F.col("specifications"), F.col("features")).alias("intents"))


def _with_devices(tagged: DataFrame) -> DataFrame:
    """Put the device intent in front where devices were found, in place of "general"."""
    found = F.struct(F.lit(0).alias("ord"), F.lit("device_search").alias("intent"), F.lit(0.7).alias("score"))
    others = F.filter("intents", lambda s: s["intent"] != "general")
    typed = tagged.withColumn("intents", F.when(
        F.col("n_devices") > 0, F.concat(F.array(found), others)).otherwise(F.col("intents")))
    return typed.withColumn("response_type", N.response_type(F.col("intents"), F.col("n_devices")))


def analyze(q: DataFrame, cat: DataFrame, **kw) -> DataFrame:
    """One row per question: its devices and brands, tags, scored intents, kind of answer.

    ``devices``: all different ``(brand, device, full_name)`` of the text, longest match first; ``brands``: their brands in that
    order. Both are empty without a match. The text itself is left behind. Null and repeated ids are questions of their own.
    """
    # Kept, so that what found them is off the disks when questions are shuffled.
    found = kept(M.mention_lists(M.name_matches(q, cat, **kw)), "found")
    none = F.array().cast("array<struct<brand: string, device: string, pos: bigint>>")
    joined = _tagged(q).join(unsent(found), "row", "left").withColumn("_all", F.coalesce("devices", none)).withColumn("n_devices", F.size("_all").cast("bigint"))
    named = F.transform("_all", lambda m: F.struct(m["brand"].alias("brand"), m["device"].alias("device"), F.concat(m["brand"], F.lit(" "), m["device"]).alias("full_name")))
    listed = joined.withColumns({"devices": named, "brands": F.array_distinct(F.transform("_all", lambda m: m["brand"]))})
    first = F.get("_all", F.lit(0))
    return N.rank_intents(_with_devices(listed)).select(
        "qid", "n_devices", first["brand"].alias("first_brand"), first["device"].alias("first_device"), "devices", "brands",
        "features", "specifications", "intents", "primary_intent", "secondary_intent", "confidence", "response_type")


def categories(q: DataFrame, cat: DataFrame, **kw) -> DataFrame:
    """All columns of ``q`` and ``category``, the cascade's, with the catalogue's pairs of brand and name as its last test."""
    # Kept, as in ``analyze``.
    pairs = kept(M.first_pair_mention(q, cat, **kw).select("row"), "pairs").withColumn("_pair", F.lit(True))
    joined = q.withColumn("row", M.text_row()).join(unsent(pairs), "row", "left")
    return N.cascade_category(joined, F.coalesce("_pair", F.lit(False))).drop("row", "_pair")


def _documents(cat: DataFrame, specs: DataFrame, spec_order: str) -> DataFrame:
    """Catalogue rows with the first specification document of their URL, parsed.

    Only documents of the given rows are sorted out; the rest of the table is
    dropped at the scan side of a semi join.
    """
    few = specs.join(unsent(cat.select("device_url").distinct()), "device_url", "left_semi")
    firsts = first_per_key(few, ["device_url"], spec_order, ["device_url", "specifications"])
    return S.with_entries(S.with_nested(S.parse_specs(cat.join(unsent(firsts), "device_url", "left"))))


def _pairs(q: DataFrame, cat: DataFrame, **kw) -> DataFrame:
    """``(row, d1, d2)``: the first two devices of each text that names one."""
    top = M.device_mentions(q, cat, top=2, **kw)
    return top.groupBy("row").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("pos", "brand", "device"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.struct("pos", "brand", "device"))).alias("d2"))


def compare_status(q: DataFrame, cat: DataFrame, within: DataFrame | None = None, **kw) -> DataFrame:
    """``(qid, status, message)``: ``ok`` when two devices can be compared, else why not.

    ``within``: catalogue rows that can be compared, all of ``cat`` by default; a device of none of their names is ``not_found``.
    """
    pairs = _pairs(q, cat, **kw)
    short = F.when(F.col("d2.pos").isNull(), F.lit("too_few"))
    if within is not None:
        names = M.catalogue_names(within)
        for side in ("d1", "d2"):
            named = names.select(F.struct("brand", "device").alias("_name"), F.lit(True).alias(f"_{side}"))
            pairs = pairs.join(unsent(named), F.struct(F.col(f"{side}.brand"), F.col(f"{side}.device")) == F.col("_name"), "left").drop("_name")
        short = short.when(F.col("_d1").isNull() | F.col("_d2").isNull(), F.lit("not_found"))
    pairs = q.select("qid", M.text_row().alias("row")).join(unsent(pairs), "row", "left")
    told = F.create_map(*[F.lit(x) for kv in COMPARE_MESSAGES.items() for x in kv])
    return pairs.select("qid", short.otherwise(F.lit("ok")).alias("status")).withColumn("message", F.try_element_at(told, F.col("status")))


def compare(q: DataFrame, cat: DataFrame, specs: DataFrame, spec_order: str = "device_url", **kw) -> DataFrame:
    """Specifications of the first two devices of each question, side by side.

    ``(qid, place, spec, device_1, value_1, device_2, value_2)``; the kinds asked
    for, or five common ones. Values are made once per device, not per question, and of each only the kinds asked for travel.
    Of several documents with one URL the first by ``spec_order`` is used.
    """
    # Rows, positions and kinds only; kept, as the joins below start from them.
    asked = N.spec_tags(q).select("qid", M.text_row().alias("row"), F.when(F.size("specifications") > 0, F.col("specifications")).otherwise(
        F.array(*[F.lit(s) for s in D.DEFAULT_COMPARISON])).alias("kinds"))
    pairs = kept(_pairs(q, cat, **kw).filter(F.col("d2.pos").isNotNull()).join(unsent(asked), "row").select(
        "qid", F.col("d1.pos").alias("p1"), F.col("d2.pos").alias("p2"), "kinds"), "pairs")
    used = pairs.select(F.explode(F.array("p1", "p2")).alias("pos"), "kinds").groupBy("pos").agg(
        F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("wanted"))
    docs = _documents(cat.join(unsent(used), "pos"), specs, spec_order).select(
        "pos", F.concat("brand_name", F.lit(" "), "device_name").alias("name"), S.comparison_texts(F.col("entries"), F.col("wanted")).alias("texts"))
    values = kept(docs.select("pos", "name", F.explode_outer("texts").alias("spec", "value")), "values")
    names = values.select("pos", "name").distinct()
    lines = pairs.select("qid", "p1", "p2", F.posexplode_outer("kinds").alias("place", "spec"))
    for side in ("1", "2"):
        lines = lines.join(unsent(names.select(F.col("pos").alias(f"p{side}"), F.col("name").alias(f"device_{side}"))), f"p{side}")
        lines = lines.join(unsent(values.select(F.col("pos").alias(f"p{side}"), "spec", F.col("value").alias(f"value_{side}"))), [f"p{side}", "spec"], "left")
    return lines.select("qid", "place", "spec", "device_1", "value_1", "device_2", "value_2")


def device_answers(q: DataFrame, cat: DataFrame, specs: DataFrame, spec_order: str = "device_url", **kw) -> DataFrame:
    """For questions about a device: its report of the asked specifications, or its summary.

    ``(qid, response_type, device_url, answer)``. The device is the first row,
    in file order, among those that carry one of the mentioned names.
    """
    found = M.mention_lists(M.name_matches(q, cat, **kw)).select(
        "row", F.size("devices").cast("bigint").alias("n_devices"), F.array_min(F.transform("devices", lambda m: m["pos"])).alias("pos"))
    tagged = _with_devices(_tagged(q).join(unsent(found), "row"))
    wanted = checkpointed(tagged.filter(F.col("response_type").isin("device_specs", "device_details")).select(
        "qid", "pos", "specifications", "response_type"))
    docs = S.with_facts(_documents(cat.join(unsent(wanted.select("pos").distinct()), "pos", "left_semi"), specs, spec_order))
    joined = wanted.join(unsent(docs.drop("specifications")), "pos")
    told = S.device_summary(S.spec_report(S.requested_specs(joined)))
    return told.select("qid", "response_type", "device_url",
                       F.when(F.col("response_type") == "device_specs", F.col("report")).otherwise(F.col("summary")).alias("answer"))


def recommendation_pool(cat: DataFrame, specs: DataFrame, spec_order: str = "device_url") -> DataFrame:
    """The devices that can be recommended, with parsed documents and facts.

    At most five for each of 24 brand choices and three tiers, 360 rows in all.
    """
    shown = checkpointed(R.first_unique(R.tier_slices(cat)))
    wanted = F.broadcast(shown.select("device_url").distinct())
    few = specs.join(wanted, "device_url", "left_semi")
    firsts = first_per_key(few, ["device_url"], spec_order, ["device_url", "specifications"])
    return S.with_facts(S.with_nested(S.parse_specs(shown.join(firsts, "device_url", "left"))))


def recommend(q: DataFrame, cat: DataFrame, specs: DataFrame, spec_order: str = "device_url") -> DataFrame:
    """``(qid, place, brand_name, device_name, device_url, highlights)``, up to five per question.

    Questions meet the small pool table by brand and tier; they are never
    shuffled. A brand that no catalogue row carries gets no recommendation.
    """
    asked = N.brand_focus(N.tier_and_focus(q)).select(
        "qid", F.coalesce("brand_focus", F.lit("")).alias("brand_focus"), "tier", "focus_areas")
    pool = recommendation_pool(cat, specs, spec_order)
    met = asked.join(F.broadcast(pool), ["brand_focus", "tier"])  # at most 360 rows, see above
    return S.highlights(met).select("qid", "place", "tier", "brand_focus", "brand_name", "device_name", "device_url", "highlights")
