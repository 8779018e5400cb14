"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from devicelode.llm.common import saved

SPACE, INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
LOCAL = r"[A-Za-z0-9._%+-]"
#: The kinds in their order. Loops are possessive and starts inside a run are left out where the run's start fails alike, so
#: that every pattern takes linear time; the matches are those of the plain patterns.
KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A white-space delimited token that holds a digit or an at sign: what the contexts may point at.
TOKEN = rf"(?<!{INK})[^\x20\x09-\x0D0-9@]*+[0-9@]{INK}*+"
#: Seed entities beyond the fixed kinds, by the whole value: keys of at least 32 hexadecimal digits of both sorts.
SEEDS = {"secret": r"^(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}$"}


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds; the digits are read from the right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    small = F.forall(F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.length(p) <= 3) & (
        F.coalesce(F.left(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    size = F.length(digits)
    return (F.when(kind == "ip", small).when(kind == "card", F.when(size.between(12, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", size.between(9, 15)).otherwise(True))


def _key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g")]


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, _h, _g, kind, start, end, value, before``: matches of the fixed kinds that pass their test, and ``token`` rows.

    Offsets are code points, ``before`` is up to 64 characters of context. Each kind's gaps and matches alternate, so a
    running sum over a document's rows of that kind gives the offsets; only matches are shuffled, not texts.
    """
    text = F.col("text").cast("string")
    some = docs.filter(text.rlike("[0-9@]")).select(*_key(), text.alias("text")).distinct()

    def parts(kind: str, pattern: str) -> Column:
        found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern)
        rows = F.transform(found, lambda value, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"),
                                                            value.alias("value"), F.right(F.get(gaps, i), F.lit(64)).alias("before")))
        return F.when(F.contains("text", F.lit("@")), rows) if kind == "email" else F.when(F.contains("text", F.lit("+")), rows) if kind == "phone" else rows

    listed = F.flatten(F.array_compact(F.array(*[parts(k, p) for k, p in {**KINDS, "token": TOKEN}.items()])))
    rows = some.select("doc_id", "_h", "_g", F.explode(listed).alias("m")).select("doc_id", "_h", "_g", "m.*")
    order = Window.partitionBy("doc_id", "_h", "_g", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).filter(
        _valid(F.col("kind"), F.col("value"))).select("doc_id", "_h", "_g", "kind", "start", "end", "value", "before")


def occurrences(found: DataFrame) -> DataFrame:
    """Adds ``cue`` and ``shape``, the lexical pattern, and cuts a token to its ``value``.

    A token ``name=value`` or ``name:value`` has its own name as cue; otherwise the cue is the word before, with the one
    before that if it is only a sign. Quotes, brackets and closing punctuation about a value belong to the context.
    """
    token = F.col("kind") == "token"
    name = F.when(token, F.regexp_extract("value", r"^([^0-9@=:]{1,64}[=:])", 1)).otherwise("")
    lead = F.length(F.regexp_extract(F.substr("value", F.length(name) + 1), r"^[\"'(<\[{]*", 0)) + F.length(name)
    body = F.when(token, F.regexp_replace(F.substr("value", lead + 1), r"[\"')>\]},.;:!?]+$", "")).otherwise(F.col("value"))
    word = F.regexp_extract("before", rf"({INK}*\p{{L}}{INK}*(?:{SPACE}+[^\x20\x09-\x0D\p{{L}}]+)?){SPACE}*$", 1)
    cue = F.lower(F.regexp_replace(F.when(name != "", name).otherwise(word), rf"{SPACE}+|[\"'(<\[]+$", ""))
    start = F.when(token, F.col("start") + lead).otherwise(F.col("start"))
    shape = F.concat(F.when(F.contains(body, F.lit("@")), "@").otherwise(""), F.when(body.rlike(r"\p{L}"), "a").otherwise(""),
                     F.when(body.rlike("[0-9]"), "9").otherwise(""))
    return found.select("doc_id", "_h", "_g", "kind", start.alias("start"), (start + F.length(body)).alias("end"), body.alias("value"),
                        cue.alias("cue"), shape.alias("shape")).filter(F.length("value") > 0)


def _free(rows: DataFrame) -> DataFrame:
    """Token rows that meet no row of another kind in their document."""
    spot = ["doc_id", "_h", "_g"]
    base = F.col("kind") != "token"
    so_far = Window.partitionBy(*spot).orderBy("start", "end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*spot).orderBy("start", "end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = (F.coalesce(F.max(F.when(base, F.col("end"))).over(so_far), F.lit(0)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.lit(2**31 - 1)) < F.col("end"))
    return rows.withColumn("_met", met).filter(~base & ~F.col("_met")).drop("_met")


def bootstrapped(rows: DataFrame, seeds: dict[str, str] = SEEDS, rounds: int = 3, support: int = 5, trust: float = 0.8) -> DataFrame:
    """Token rows that trusted patterns point at, ``kind`` being that of the pattern's seeds.

    ``rows``: a saved table of ``occurrences``. A pattern is a cue with a shape of value, an instance a value. Seeds are the
    entities of the fixed kinds and values that fit a seed expression. Each round a pattern's trust is the summed score of
    its distinct instances over their number plus one, and an instance's score the largest trust among its patterns (1 for
    seeds). Patterns need ``support`` distinct seeds of one kind. Only patterns with a seed take part, as others stay at 0.
    """
    spot = ["doc_id", "_h", "_g"]
    free = _free(rows)
    secret = F.coalesce(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in seeds.items()], F.lit(None).cast("string"))
    tokens = free.withColumn("seed", secret)
    known = rows.filter("kind != 'token'").withColumn("seed", F.col("kind")).unionByName(tokens).filter("cue != ''")
    edges = saved(known.groupBy("cue", "shape", "value").agg(F.max("seed").alias("seed")), "edges")
    backed = saved(edges.filter("seed is not null").groupBy("cue", "shape", "seed").agg(F.count(F.lit(1)).alias("seeds"))
                   .groupBy("cue", "shape").agg(F.max(F.struct("seeds", "seed")).alias("top")).filter(F.col("top.seeds") >= support)
                   .select("cue", "shape", F.col("top.seed").alias("meant")), "backed")
    graph = saved(edges.join(backed, ["cue", "shape"]), "graph")
    scores = graph.withColumn("score", F.when(F.col("seed") == F.col("meant"), 1.0).otherwise(0.0))
    trusts = None
    for _ in range(rounds):
        trusts = saved(scores.groupBy("cue", "shape").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust")), "trusts")
        offered = graph.join(trusts, ["cue", "shape"]).groupBy("value", "meant").agg(F.max("trust").alias("offered"))
        scores = saved(graph.join(offered, ["value", "meant"]).withColumn(
            "score", F.when(F.col("seed") == F.col("meant"), 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(F.col("offered")))
            .select("cue", "shape", "value", "score"), "scores")
    chosen = saved(backed.join(trusts.filter(F.col("trust") >= trust), ["cue", "shape"]).select("cue", "shape", "meant"), "patterns")
    return tokens.join(chosen, ["cue", "shape"]).select(*spot, F.col("meant").alias("kind"), "start", "end")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts ``n_email, n_ip, n_card, n_phone`` of the fixed kinds, ``base`` and ``found``.

    ``base`` lists the spans of the fixed kinds as ``kind:start:end``, by start, then kind in its order; ``found`` adds those that contexts gave.
    Null and empty texts have none; repeated rows have the same ones. Only ``doc_id`` and ``text`` are read.
    """
    rows = saved(occurrences(matches(docs)), "occurrences")
    added = bootstrapped(rows, **options)
    names = [*KINDS, *SEEDS]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("kind"))
    spans = rows.filter("kind != 'token'").select("doc_id", "_h", "_g", "kind", "start", "end", F.lit(True).alias("fixed")).unionByName(
        added.withColumn("fixed", F.lit(False)))
    counts = [F.count_if(F.col("fixed") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    listed = F.array_sort(F.collect_set(F.struct("start", place.alias("place"), "end", "kind", "fixed")))
    per = saved(spans.groupBy("doc_id", "_h", "_g").agg(*counts, listed.alias("spans")).withColumnsRenamed(
        {"doc_id": "_id", "_h": "_fh", "_g": "_fg"}), "spans")
    base = docs.select(*_key())
    same = base["doc_id"].eqNullSafe(per["_id"]) & (base["_h"] == per["_fh"]) & (base["_g"] == per["_fg"])
    written = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    return base.join(per, same, "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        written(F.filter("spans", lambda s: s["fixed"])).alias("base"), written(F.col("spans")).alias("found"))
