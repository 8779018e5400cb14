from devicelode.llm import language
from devicelode.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 250 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(odd_docs, no_docs, docs):
    model = language.trained(docs)
    got = language.identified(odd_docs, model)
    assert set(odd_docs.columns) < set(got.columns) and got.count() == odd_docs.count()
    for r in got.collect():
        if not language.has_letter(r["text"]):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in model.langs
    assert language.identified(no_docs, model).count() == 0
    assert language.trained(no_docs) is None
    assert {r["lang_pred"] for r in language.identified(odd_docs, None).collect()} == {"und"}


def test_id_source_and_label_are_no_inputs(docs):
    model = language.trained(docs)
    first = {r["text"]: r["score"] for r in language.identified(docs, model).collect()}
    for r in language.identified(docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang", "'q' as source"), model).collect():
        assert first[r["text"]] == r["score"]


def test_rejection_is_calibrated(docs):
    model = language.trained(docs)
    accepted = language.identified(docs, model).filter("accepted").count()
    assert accepted >= 0.97 * docs.count()
    assert model.scores("qqq zzz xxx 你好")[0] < 1


def test_long_words_are_cut_into_several_training_pieces(spark):
    docs = spark.createDataFrame([(1, "xx", "a" * 3000 + "z" * 900), (2, "yy", "b " * 10)], "doc_id long, lang string, text string")
    got = language.sample(docs, per_language=5, per_document=10)
    pieces = {x: sorted(got.loc[got["lang"] == x, "piece"]) for x in ("xx", "yy")}
    assert sorted("".join(pieces["xx"])) == sorted("a" * 3000 + "z" * 900) and max(map(len, pieces["xx"])) <= language.LONGEST and len(pieces["yy"]) == 1
    assert len(language.sample(docs, per_language=5, per_document=2)) <= 3


def test_query_tells_what_is_accepted(spark, sf):
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert {r["accepted"] for r in rows} <= {True, False} and all(r["accepted"] is False for r in rows if r["lang_pred"] == "und")
