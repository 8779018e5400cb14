"""Benchmark decontamination: hashes of document windows looked up in the set of test windows' hashes, hits verified by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import ascii_lower, saved

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCUMENTS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def test_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``item_id, window, gram``: every window of each item and its hash; an item of fewer words is one window."""
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window"))
    return windows.distinct().withColumn("gram", F.xxhash64("window"))


def _grams(words: Column, size: int) -> Column:
    """``start, size, gram`` of every window of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    one = lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.xxhash64(F.slice(words, i + 1, size)).alias("gram"))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), one)


def _key() -> list[Column]:
    """A document's id and two hashes of its text: repeated rows share them and have the same result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g")]


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, _h, _g, item_id, start, length``: each occurrence of a window, verified word by word.

    Window hashes of documents are looked up in the set of the items' window hashes, which is counted first and broadcast
    up to a bound; beyond it hashes and places are shuffled, never words. Only documents with a hash of the set are then
    read again, and the words at its places compared.
    """
    windows = saved(test_windows(benchmark, width), "windows")
    sizes = sorted(r[0] for r in windows.select(F.size("window")).distinct().collect())  # ``width`` different ones at most
    key = ["doc_id", "_h", "_g"]
    tokens = docs.select(*_key(), words_of(F.col("text").cast("string")).alias("words"))
    placed = tokens.select(*key, F.explode_outer(F.concat(*[_grams(F.col("words"), n) for n in sizes or [width]])).alias("g")).select(*key, "g.*")
    known = _bounded(saved(windows.select("gram").distinct(), "grams"), BROADCAST_WINDOWS)
    found = saved(placed.join(known, "gram").groupBy(*key).agg(F.collect_set(F.struct("start", "size", "gram")).alias("places")).toDF(
        "_id", "_fh", "_fg", "places"), "found")
    asked = _bounded(saved(found.select("_id", "_fh", "_fg"), "asked"), BROADCAST_DOCUMENTS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_fh")) & (F.col("_g") == F.col("_fg"))
    texts = docs.select(*_key(), "text").join(asked, same, "left_semi")
    texts = texts.select(*key, words_of(F.col("text").cast("string")).alias("words"))
    there = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["gram"].alias("gram"), F.slice("words", p["start"] + 1, p["size"]).alias("window")))
    seen = texts.join(found, same).select(*key, F.explode_outer(there).alias("w")).select(*key, "w.*")
    return seen.join(_bounded(windows, BROADCAST_WINDOWS), ["gram", "window"]).select(*key, "item_id", "start", F.size("window").alias("length"))


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def grow(seen, span):
        end = span["start"] + span["length"]
        return F.struct(F.greatest(seen["end"], end).alias("end"),
                        (seen["words"] + F.greatest(end - F.greatest(seen["end"], span["start"]), F.lit(0))).alias("words"))

    return F.aggregate(spans, zero, grow)["words"]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated`` and the join columns ``_h, _g``.

    A word inside any occurrence of a window is hit; ``spans`` holds the occurrences (start, length, counted in words).
    Null and empty texts have no words; items without words have no windows; items that share an id count once. Only the
    columns ``doc_id``, ``text`` and ``item_id`` are read.
    """
    found = hits(docs, benchmark, width).groupBy("doc_id", "_h", "_g").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = saved(found.toDF("_id", "_fh", "_fg", "spans", "items"), "hits")
    base = docs.select(*_key(), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_words"))
    same = base["doc_id"].eqNullSafe(found["_id"]) & (base["_h"] == found["_fh"]) & (base["_g"] == found["_fg"])
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return base.join(found, same, "left").select(
        "doc_id", "_h", "_g", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        "spans", (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, spans: bool = False) -> DataFrame:
    """``docs`` with its own columns, without contaminated documents or, with ``spans``, without the words that are hit."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    found = contamination(docs, benchmark, width).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_fh"), F.col("_g").alias("_fg"), F.col("spans").alias("_spans")).distinct()
    found = saved(found, "leaks")
    found = F.broadcast(found) if not spans and found.count() <= BROADCAST_DOCUMENTS else found
    key = _key()
    same = key[0].eqNullSafe(F.col("_id")) & (key[1] == F.col("_fh")) & (key[2] == F.col("_fg"))
    if not spans:
        return row.join(found, same, "left_anti").select("row.*")
    text = F.col("text").cast("string")
    gaps, words = F.split(text, WORD), F.regexp_extract_all(text, F.lit(f"({WORD})"))
    hit = lambda i: F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["length"]))
    rest = F.array_join(F.transform(words, lambda w, i: F.concat(F.when(hit(i), F.lit("")).otherwise(w), F.get(gaps, i + 1))), "")
    cleaned = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(F.get(gaps, F.lit(0)), rest))
    return row.join(found, same, "left").select("row.*", cleaned.alias("_cleaned")).select(
        *[F.col("_cleaned").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
