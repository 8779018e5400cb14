"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelode.llm import identifiers, infill, language, leaks, licences, lines, maintext, neardup, packing, periodic, search, sharding, urls
from devicelode.llm.common import table
from devicelode.llm.oracles import OP5, OP9, OP11, OP13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op5_exact_top_k": OP5, "op9_decontamination": OP9, "op11_periodic_runs": OP11, "op13_fill_in_middle": OP13}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by rule or host reputation; a page shows the document whose number ends its path, and a labelled
    document that is toxic or of no quality is a bad outcome for the page's host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.host_and_path(F.col("url"))[1], r"([0-9]{1,18})(?:\.html)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return urls.judge(pages, shown.join(labels, "doc_id").select("url", "bad"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@query
def op3_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(search.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.trained(docs.filter(~F.col("held_out")))
    return language.identified(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query
def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents"), **lines.WIDE).select("doc_id", "text", "n_lines", "n_removed")


@query
def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.col("found").alias("spans"))


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_tandems(table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = found.withColumn("top", periodic.strongest(F.col("runs")))
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                      F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                      F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extracted(table(spark, sf_dir, "pages"))
