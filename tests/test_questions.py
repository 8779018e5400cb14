import json
import math
import re

import pytest
from pyspark.sql import functions as F

from devicelode.operators import ordered
from devicelode import dictionaries as D
from devicelode.operators import dialogue as G
from devicelode.operators import mentions as M
from devicelode.operators import specs as S
from devicelode.operators import tagging as N
from wiring import tables as T
from devicelode.plans import analyze, categories, compare, compare_status, device_answers, recommend

CAT = "pos bigint, brand_name string, device_name string, device_url string, device_image string"
# A device called "A" is found in most texts, as plain substrings are.
DEVICES = [("Samsung", "Galaxy S23"), ("Samsung", "Galaxy S23 Ultra"), ("Apple", "iPhone 15"), ("Nokia", "3.1"), ("Nokia", "(x)"),
           ("LG", ""), ("Apple", "iPhone 15"), ("Oppo", "A")]
TEXTS = ["Compare Galaxy S23 Ultra and apple IPHONE 15", "nokia 3.1 battery", "which phone", "", "nokia 3x1", "the (x) or samsung galaxy s23",
         "iPhone 15 iphone 15"]


def devices(spark):
    return spark.createDataFrame([(i, b, d, f"u{i}", "") for i, (b, d) in enumerate(DEVICES)], CAT)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts or TEXTS)), "qid bigint, text string")


# What each of TEXTS mentions, in order.
MENTIONED = [
    [("samsung", "galaxy s23 ultra"), ("apple", "iphone 15"), ("samsung", "galaxy s23"), ("oppo", "a")],
    [("nokia", "3.1"), ("oppo", "a")],
    [],
    [],
    [("oppo", "a")],
    [("samsung", "galaxy s23"), ("nokia", "(x)"), ("oppo", "a")],
    [("apple", "iphone 15")],
]


@pytest.mark.parametrize("limit", [0, 1000])
def test_mentions(spark, limit):
    rows = M.device_mentions(ask(spark), devices(spark), broadcast_names=limit).collect()
    for qid, text in enumerate(TEXTS):
        got = [(r.brand, r.device) for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == qid]
        assert got == MENTIONED[qid], text


def test_large_path_has_no_nested_loop(spark):
    text = M.device_mentions(ask(spark), devices(spark), broadcast_names=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_first_pair(spark):
    rows = {r.qid: r.pos for r in M.first_pair_mention(ask(spark), devices(spark)).collect()}
    assert rows == {0: 2, 1: 3, 5: 0}


def test_partial_only_without_exact(spark):
    names = spark.createDataFrame([(1, "nokia", "3.1"), (1, "nok", "."), (2, "SAM", "galaxy"), (3, "nokia", "3x1"), (4, "", "iphone")],
                                  "qid bigint, brand string, device string")
    rows = M.match_partial(ask(spark), names, devices(spark)).collect()
    assert sorted((r.qid, r.pos, r.how) for r in rows) == [
        (1, 3, "exact"), (2, 0, "partial"), (2, 1, "partial"), (4, 2, "partial"), (4, 6, "partial")]
    many = spark.range(40).select(F.col("id").alias("pos"), F.lit("B").alias("brand_name"), F.concat(F.lit("name"), "id").alias("device_name"),
                                  F.lit("u").alias("device_url"), F.lit("").alias("device_image"))
    one = spark.createDataFrame([(1, "b", "name")], "qid bigint, brand string, device string")
    assert sorted(r.pos for r in M.match_partial(one, one, many).collect()) == list(range(10))


# ---- tags ------------------------------------------------------------------------

def test_substrings_and_word_boundaries(spark):
    q = ask(spark, "which way", "hi there", "5000 mAh", "CAN I go")
    loose = {r.qid: r.tags for r in N.tag(q, "text", {"g": ["hi"], "m": ["mAh"], "c": ["can I"]}).collect()}
    assert loose == {0: ["g"], 1: ["g"], 2: [], 3: []}
    strict = {r.qid: r.tags for r in N.tag(q, "text", {"g": ["hi"]}, word_boundary=True).collect()}
    assert strict[0] == [] and strict[1] == ["g"]


def test_last_tier_wins(spark):
    rows = N.tier_and_focus(ask(spark, "best cheap phone", "balanced top camera", "nothing")).orderBy("qid").collect()
    assert [r.tier for r in rows] == ["budget", "mid_range", "high_end"]
    assert rows[1].focus_areas == ["camera"]


def test_intents_ties_and_general(spark):
    rows = N.rank_intents(N.intent_scores(ask(spark, "compare camera", "zzz", "hello"))).orderBy("qid").collect()
    assert (rows[0].primary_intent, rows[0].secondary_intent, rows[0].confidence) == ("specification", "comparison", 0.7)
    assert (rows[1].primary_intent, rows[1].secondary_intent, rows[1].confidence) == ("general", None, 0.3)
    assert rows[2].primary_intent == "greeting" and rows[2].confidence == 0.5


def test_conversation_category_and_name(spark):
    q = ask(spark, "  ", "zzz bot-9", "yes sir")
    assert [r.category for r in N.conv_category(q).orderBy("qid").collect()] == ["default", "default", "affirmation"]
    assert [r.category for r in N.conv_category(q, "Bot-9").orderBy("qid").collect()][1] == "identity"


def test_cascade(spark):
    q = ask(spark, "a phone", "best phone", "camera", "zzz", "bye")
    assert [r.category for r in N.cascade_category(q).orderBy("qid").collect()] == ["device_search", "recommendation", "camera", "general", "farewell"]
    assert N.cascade_category(ask(spark, "zzz"), F.lit(True)).first().category == "device_search"


def test_analysis(spark):
    rows = analyze(ask(spark), devices(spark)).orderBy("qid").collect()
    assert [r.response_type for r in rows] == ["comparison", "device_specs", "recommendations", "conversation",
                                               "device_details", "comparison", "device_details"]
    assert (rows[0].n_devices, rows[0].first_brand, rows[0].first_device) == (4, "samsung", "galaxy s23 ultra")


# ---- specifications ------------------------------------------------------------------

DOC = {"Network": {"Technology": "LTE"}, "technology": "LTE", "display": {"size": "6", "Size": "7"}, "Display": {"type": "OLED"},
       "battery_type": "Li", "Battery": {"type": "Li-Po", "charging": {"wired": "20W", "wireless": "5W"}}, "misc": {"price": "9"}}


def parsed(spark, doc=DOC, kinds=("battery", "display")):
    df = spark.createDataFrame([("u", json.dumps(doc) if isinstance(doc, dict) else doc)], "device_url string, specifications string")
    df = S.with_facts(S.with_entries(S.with_nested(S.parse_specs(df))))
    return df.withColumn("specifications", F.array(*[F.lit(k) for k in kinds]).cast("array<string>"))


def brute_requested(doc, kinds):
    out, added = [], []

    def add(kind, key, value):
        if key.lower() not in added:
            added.append(key.lower())
            out.append((kind, key))

    for kind in kinds:
        for path in D.SPEC_PATHS.get(kind, []):
            levels = [doc] + [v for v in doc.values() if isinstance(v, dict)]
            for level in levels:
                if path in level:
                    if isinstance(level[path], dict):
                        for k, v in level[path].items():
                            add(kind, k, v)
                    else:
                        add(kind, path, level[path])
    return out


@pytest.mark.parametrize("kinds", [("battery", "display"), ("display", "battery"), ("price", "os", "battery"), (), ("unknown", "memory")])
def test_requested_specs_equal_brute_force(spark, kinds):
    got = S.requested_specs(parsed(spark, kinds=kinds)).first().requested
    assert [(r.spec_type, r.key) for r in got] == brute_requested(DOC, kinds)


@pytest.mark.parametrize("doc", [None, "", "{bad", "[1]", "{}"])
def test_bad_documents_are_empty(spark, doc):
    row = S.requested_specs(parsed(spark, doc)).first()
    assert row.specs == {} and row.requested == []
    assert S.spec_report(S.requested_specs(parsed(spark, doc).withColumns({"brand_name": F.lit("b"), "device_name": F.lit("d")}))).first().report is None


def test_comparison_text_flattens(spark):
    texts = parsed(spark).select(S.comparison_texts(F.col("entries")).alias("t")).first().t
    assert texts["battery"] == "type: Li-Po, charging: wired: 20W, wireless: 5W, battery_type: Li, wired: 20W, wireless: 5W"
    assert texts["memory"] == "Not specified" and set(texts) == set(D.SPEC_PATHS)


def test_highlights_fall_back(spark):
    df = parsed(spark, {"a": "b"}).withColumns({"tier": F.lit("budget"), "focus_areas": F.array().cast("array<string>")})
    assert S.highlights(df).first().highlights == ["Affordable device with good features"]
    df = df.withColumn("focus_areas", F.array(F.lit("audio"), F.lit("camera")))
    assert S.highlights(df).first().highlights == ["A great choice for audio, camera"]


def test_other_highlights_stop_at_plain_text(spark):
    doc = {"audio jack": {"a": "1", "b": "2"}, "Audio": "yes", "audio out": {"c": "3"}}
    df = parsed(spark, doc).withColumns({"tier": F.lit("budget"), "focus_areas": F.array(F.lit("audio"))})
    assert S.highlights(df).first().highlights == ["Audio - a: 1", "Audio: yes"]


# ---- answers ----------------------------------------------------------------------------

def spec_table(spark):
    return spark.createDataFrame([("u1", json.dumps({"Battery": {"type": "5000"}})), ("u2", json.dumps({"Memory": {"internal": "128"}})),
                                  ("u3", json.dumps({"battery": {"type": "2990"}}))], "device_url string, specifications string")


def test_compare(spark):
    q = ask(spark, "Galaxy S23 Ultra versus apple IPHONE 15")
    rows = compare(q, devices(spark), spec_table(spark)).orderBy("place").collect()
    assert [r.spec for r in rows] == D.DEFAULT_COMPARISON
    by = {r.spec: (r.value_1, r.value_2) for r in rows}
    assert (rows[0].device_1, rows[0].device_2) == ("Samsung Galaxy S23 Ultra", "Apple iPhone 15")
    # "samsung" is not in the text, so the short name ranks by its own length
    assert by["battery"] == ("type: 5000", "Not specified") and by["memory"] == ("Not specified", "internal: 128")
    status = {r.qid: r.status for r in compare_status(ask(spark), devices(spark)).collect()}
    assert status == {0: "ok", 1: "ok", 2: "too_few", 3: "too_few", 4: "too_few", 5: "ok", 6: "too_few"}


def test_device_answers(spark):
    rows = {r.qid: r for r in device_answers(ask(spark), devices(spark), spec_table(spark)).collect()}
    assert rows[1].response_type == "device_specs" and "  - Type: 2990" in rows[1].answer
    assert rows[6].answer.startswith("I found information about Apple iPhone 15.")


def test_recommend(spark):
    rows = recommend(ask(spark, "best samsung", "cheap pixel", "battery"), devices(spark), spec_table(spark)).orderBy("qid", "place").collect()
    assert [(r.qid, r.device_name) for r in rows if r.qid == 0] == [(0, "Galaxy S23"), (0, "Galaxy S23 Ultra")]
    assert not [r for r in rows if r.qid == 1]  # a product name no brand carries
    third = [r for r in rows if r.qid == 2]
    assert len(third) == 5 and third[0].brand_name == "Samsung" and len({(r.brand_name, r.device_name) for r in third}) == 5


# ---- dialogue ------------------------------------------------------------------------------

def brute_tfidf(text):
    patterns, owner = [], {}
    for cat, ps in D.CONVERSATION.items():
        for p in ps + [cat] * 3:
            patterns.append(p)
            owner[p] = cat

    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [grams(p) for p in patterns] + [grams(text)]
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vec = []
    for d in docs:
        v = {t: d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(d) if df[t] <= 0.9 * n}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({t: x / norm for t, x in v.items()})
    sims = [sum(x * p.get(t, 0) for t, x in vec[-1].items()) for p in vec[:-1]]
    best = max(range(len(sims)), key=lambda i: (round(sims[i], 9), -i))
    return (owner[patterns[best]] if sims[best] > 0.3 else "default"), sims[best]


def test_tfidf_equals_a_plain_fit(spark):
    texts = ["me tell", "qqq zzz", "job", "identity", "your purposes", "is mean", "a b", "me tell me tell xyz abc", "talk me"]
    rows = G.tfidf_category(ask(spark, *texts)).orderBy("qid").collect()
    for r in rows:
        direct = [c for c, ps in D.CONVERSATION.items() if any(p in r.text for p in ps)]
        want, sim = (direct[0], None) if direct else brute_tfidf(r.text)
        assert r.category == want, r.text
        if sim:
            assert r.similarity == pytest.approx(sim, abs=1e-8)


def test_clean_reply(spark):
    rows = ask(spark, " fine \n\n thanks  User: no", "a\tb Bot: c", "").select("qid", G.clean_reply("text", "Bot").alias("r")).orderBy("qid").collect()
    assert [r.r for r in rows] == ["fine thanks", "a b", ""]


def test_response_store_is_unique_and_numbered(spark, monkeypatch):
    monkeypatch.setattr(ordered, "bucket_of", lambda order: F.floor(F.col(order) / 10))
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 15), ("b", "x", 3), ("a", "z", 31), ("a", "n", None)],
                                 "category string, response string, pos bigint")
    store = G.response_store(rows)
    assert sorted(tuple(r) for r in store.collect()) == [("a", 0, "n"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 0, "x")]
    assert {r.response for r in G.responses_for(store, "b").collect()} == {"x"}


# ---- plans ------------------------------------------------------------------------------------

def test_core_plans_stay_in_the_jvm(spark):
    q, cat, specs = ask(spark), devices(spark), spec_table(spark)
    for df in (analyze(q, cat), compare(q, cat, specs), recommend(q, cat, specs), device_answers(q, cat, specs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_null_and_repeated_question_ids_match_alike_both_ways(spark):
    q = spark.createDataFrame([(None, "alpha rocket"), (1, "alpha rocket"), (1, "rocket here")], "qid long, text string")
    cat = spark.createDataFrame([(0, "Alpha", "Rocket", "u", "")], "pos long, brand_name string, device_name string, device_url string, device_image string")
    got = [sorted((tuple(r) for r in M.name_matches(q, cat, broadcast_names=n).collect()), key=repr) for n in (0, 100)]
    assert got[0] == got[1] and len(got[0]) == 3


ROCKETS = [(0, "Alpha", "Rocket", "u", ""), (1, "Beta", "Comet", "v", ""), (2, "Alpha", "Moon 9", "w", "")]
TWINS = [(None, "alpha rocket"), (None, "beta comet and rocket"), (1, "alpha rocket"), (1, "alpha and its moon 9"), (1, "nothing"), (2, "alpha rocket"), (2, "alpha rocket"), (None, None), (3, None)]


@pytest.mark.parametrize("limit", [0, 100])
def test_rows_with_null_or_repeated_ids_are_texts_of_their_own(spark, limit):
    q = spark.createDataFrame(TWINS, "qid long, text string")
    cat = spark.createDataFrame(ROCKETS, CAT)
    listed = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    mentions = listed(M.device_mentions(q, cat, broadcast_names=limit), "qid", "rank", "device")
    assert mentions == sorted([(None, 1, "rocket"), (None, 1, "comet"), (None, 2, "rocket"), (1, 1, "rocket"), (1, 1, "moon 9"), (2, 1, "rocket"), (2, 1, "rocket")], key=repr)
    pairs = listed(M.first_pair_mention(q, cat, broadcast_names=limit), "qid", "device")
    assert pairs == sorted([(None, "rocket"), (None, "comet"), (1, "rocket"), (1, "moon 9"), (2, "rocket")], key=repr)
    told = listed(analyze(q, cat, broadcast_names=limit), "qid", "n_devices", "first_device")
    assert told == sorted([(None, 1, "rocket"), (None, 2, "comet"), (1, 1, "rocket"), (1, 1, "moon 9"), (1, 0, None), (2, 1, "rocket"), (2, 1, "rocket"), (None, 0, None), (3, 0, None)], key=repr)
    kinds = listed(categories(q, cat, broadcast_names=limit), "qid", "text", "category")
    assert len(kinds) == len(TWINS) and {t for _, t, c in kinds if c == "device_search"} == {t for _, t in TWINS if t and t != "nothing"}
    status = listed(compare_status(q, cat, broadcast_names=limit), "qid", "status")
    assert status == sorted([(i, "ok" if t and "comet" in t else "too_few") for i, t in TWINS], key=repr)


def test_analysis_lists_devices_and_brands(spark):
    row = analyze(ask(spark), devices(spark)).filter("qid = 0").first()
    assert [(d.brand, d.device, d.full_name) for d in row.devices] == [(b, d, f"{b} {d}") for b, d in MENTIONED[0]]
    assert row.brands == ["samsung", "apple", "oppo"]


def test_devices_outside_the_comparable_rows_are_not_found(spark):
    cat = devices(spark)
    rows = {r.qid: (r.status, r.message) for r in compare_status(ask(spark), cat, within=cat.filter("brand_name <> 'Apple'")).collect()}
    assert rows[0] == ("not_found", "I couldn't find enough information to compare these devices.") and rows[1][0] == "ok" and rows[2][0] == "too_few"


def test_piece_filter_lets_every_known_piece_through(spark, monkeypatch):
    monkeypatch.setattr(M, "BITS_PER_NAME", 20_000)
    known = spark.range(40).select(F.concat(F.lit("piece "), "id").alias("gram"))
    test = M.piece_filter(known, 40)
    asked = spark.range(20_000).select("id", F.concat(F.lit("piece "), "id").alias("p"))
    passed = [r.id for r in asked.filter(test(F.col("p"))).collect()]
    assert set(range(40)) <= set(passed) and len(passed) < 60


def test_hot_pieces_are_dealt_and_met_once(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_PIECE", 5)
    q = spark.range(40).select(F.col("id").alias("qid"), F.concat(F.lit("alpha rocket no "), "id").alias("text"))
    rows = M.name_matches(q, spark.createDataFrame(ROCKETS, CAT), broadcast_names=0).collect()
    assert sorted(r.qid for r in rows) == list(range(40))


def test_tables_that_grow_are_sent_round_by_no_estimate(spark, sf):
    """Files are compressed: an estimate by their size sends a catalogue thirty times as large round, which the driver must hold."""
    cat = T.wide_catalogue(spark, sf)
    q = T.questions(spark, sf)
    frames = {
        "questions": q, "keys": M.name_keys(M.catalogue_names(cat)),
        "analyze": analyze(q, cat, broadcast_names=0), "categories": categories(q, cat, broadcast_names=0),
        "status": compare_status(q, cat, within=cat.filter("pos % 3 <> 1"), broadcast_names=0),
        "compare": compare(q, cat, T.spec_documents(spark, sf), broadcast_names=0)}
    for name, df in frames.items():
        plan = df._jdf.queryExecution().sparkPlan().toString()
        # Only pieces met by more than ``HOT_PIECE`` texts are sent, by a hint.
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[gram" not in line]
        assert not joins, (name, joins)


def test_compared_documents_are_not_sent_round(spark, sf):
    """Specification documents are made from a small file and are far larger than it."""
    from wiring.question_queries import compare_values

    assert "BroadcastHashJoin" not in compare_values(spark, sf)._jdf.queryExecution().sparkPlan().toString()


def test_texts_meet_few_names_that_they_do_not_hold(spark, monkeypatch):
    """Names alike in all but four of their digits, so that any six characters are shared by twenty."""
    cat = spark.createDataFrame([(i * 20 + j, "Alpha", f"gear {i:02d}7799{j:02d}", "u", "") for i in range(20) for j in range(20)], CAT)
    q = spark.createDataFrame([(i, f"how much is the alpha gear {i % 20:02d}7799{i * 7 % 20:02d}?") for i in range(100)], "qid long, text string")
    met = []
    monkeypatch.setattr(M, "_met_by_shuffle", lambda *a, by=M._met_by_shuffle: met.append(by(*a)) or met[0])
    assert M.name_matches(q, cat, broadcast_names=0).count() == 100 and met[0].count() <= 110


def test_names_at_all_places_of_long_texts(spark):
    names = ["hm", "orbit", "rocket", "comet twelve", "a name of some twenty-six é"]
    cat = spark.createDataFrame([(i, "Alpha", n, "u", "") for i, n in enumerate(names)], CAT)
    rows = [(k, "é" + "x" * k + names[k % 5] + "y" * (k % 7) + names[(k + 2) % 5]) for k in [*range(0, 30), *range(470, 520), *range(985, 1015)]]
    q = spark.createDataFrame(rows, "qid long, text string")
    got = sorted((r.qid, r.device) for r in M.name_matches(q, cat, broadcast_names=0).collect())
    assert got == sorted((k, n) for k, t in rows for n in names if n in t)
