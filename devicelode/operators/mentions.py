"""Catalogue names mentioned in texts.

A name is mentioned when it is a substring of the lower-cased text. Testing all
texts against all names would be a nested loop, so every name is known by one
six-character piece of itself, the one fewest names share, and meets only
the texts that hold that piece. Shorter names stand for themselves. Names too
many to broadcast are known by twelve characters where they have as many, since
among millions six are shared by several names and by many texts of others.
What meets is then tested in full, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from devicelode.functions import strip
from devicelode.operators.ordered import within_rows
from devicelode.session import checkpointed, kept, unsent

GRAM, LONG_GRAM = 6, 12
# Name tables up to this size are sent to every executor; larger ones are shuffled.
BROADCAST_NAMES = 200_000
BROADCAST_CHARS = 32_000_000
# Bits of the piece filter for each name, and its least and largest size, 16 MB. Beyond two million names it lets more pieces through.
BITS_PER_NAME = 64
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
# Texts are cut into windows of so many places before each place is looked at, as finding a place in a text takes as long as the text before it.
WINDOW = 500
# A piece met by more texts than this is dealt over several tasks.
HOT_PIECE = 100_000


def text_row() -> Column:
    """Which row of ``(qid, text)`` a row is, by what it holds: 128 bits of hash over both.

    Rows equal in both are alike in everything that is asked of them; null and repeated ids keep texts apart.
    """
    return F.struct(F.xxhash64(F.lit(1), F.isnull("qid"), "qid", "text").alias("a"), F.xxhash64(F.lit(2), "text", F.isnull("qid"), "qid").alias("b"))


def pieces(text: Column, size: int) -> Column:
    """All different substrings of one length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def name_keys(names: DataFrame, name: str = "device", size: int = GRAM) -> DataFrame:
    """``(name, gram)``: the piece by which each distinct name is found, of ``size`` characters, or of ``GRAM`` in shorter names."""
    distinct = names.select(name).distinct()
    of = lambda n: F.when(F.length(name) >= size, n(size)).otherwise(n(GRAM)) if size > GRAM else n(GRAM)
    # The outer form: a plain explode would first test for an empty list, making all pieces twice.
    grams = distinct.filter(F.length(name) >= GRAM).select(name, F.explode_outer(of(lambda n: pieces(F.col(name), n))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    # Fewest names first, then the place in the name: one number, so that plain hashing does.
    fewest = F.col("names") * (1 << 31) + F.instr(F.col(name), F.col("gram"))
    rarest = grams.join(unsent(shared), "gram").groupBy(name).agg(F.min(fewest).alias("_best")).select(
        name, F.substring(F.col(name), (F.col("_best") % (1 << 31)).cast("int"), of(F.lit)).alias("gram"))
    return rarest.unionByName(distinct.filter(F.length(name) < GRAM).select(name, F.col(name).alias("gram")))


def text_grams(text: Column, short_lengths: Column) -> Column:
    """All six-character pieces, and the shorter ones of the lengths in use."""
    short = [F.when(F.array_contains(short_lengths, n), pieces(text, n)).otherwise(F.array().cast("array<string>"))
             for n in range(1, GRAM)]
    return F.concat(pieces(text, GRAM), *short)


def catalogue_names(cat: DataFrame) -> DataFrame:
    """Distinct lower-cased ``(brand, device)`` with the position of the first row; empty names left out."""
    return (cat.select("pos", F.lower("brand_name").alias("brand"), F.lower("device_name").alias("device"))
            .filter(F.col("device").isNotNull() & (F.col("device") != "") & F.col("brand").isNotNull())
            .groupBy("brand", "device").agg(F.min("pos").alias("pos")))


def names_fit(cat: DataFrame, rows: int) -> bool:
    """Whether the names are few and short enough to broadcast, by a count of rows and one of characters."""
    if not within_rows(cat, rows):
        return False
    chars = cat.agg(F.sum(F.length("brand_name") + F.length("device_name"))).first()[0]
    return (chars or 0) <= BROADCAST_CHARS


def piece_filter(keyed: DataFrame, names: int):
    """A test of pieces by two bits each: true for every piece of ``keyed``, and for about one in a thousand others.

    The bits are one row of at most ``MOST_BITS``, whatever the number of names, put into the plan as a scalar.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_NAME * names):
        bits *= 2
    numbers = lambda piece: [F.pmod(h, F.lit(bits)) for h in (F.xxhash64(piece), F.shiftrightunsigned(F.xxhash64(piece), 32))]
    set_bits = keyed.select(F.explode(F.array(*numbers(F.col("gram")))).alias("n")).groupBy(F.floor(F.col("n") / 64).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(n % 64 AS int))")).alias("word"))
    words = keyed.sparkSession.range(bits // 64).join(unsent(set_bits), "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    known = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda w: w["word"])).scalar()

    def test(piece: Column) -> Column:
        first, second = (F.getbit(F.get(known, F.shiftright(n, 6).cast("int")), (n % 64).cast("int")) == 1 for n in numbers(piece))
        return first & second

    return test


def _held(texts: DataFrame, lengths: Column, test) -> DataFrame:
    """``(row, gram)``: the pieces of each text that pass ``test``, of ``LONG_GRAM`` characters, of ``GRAM``, and of the shorter lengths in use.

    Cut down by the test before anything is shuffled; a piece that a text holds more than once may come out as often. Behind a text's last
    whole piece its ends come out where they pass, as pieces of a shorter length.
    """
    last = F.floor(F.greatest(F.length("_text") - 1, F.lit(0)) / WINDOW).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("_text", k * WINDOW + 1, F.lit(WINDOW + LONG_GRAM - 1)))
    sizes = F.concat(F.array(F.lit(LONG_GRAM), F.lit(GRAM)), lengths)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length("window"), F.lit(WINDOW)), F.lit(1)))
    at = texts.select("row", F.explode_outer(windows).alias("window")).select("row", "window", F.explode_outer(sizes).alias("size")).select(
        "row", "window", "size", F.explode_outer(places).alias("at"))
    # A list of one, exploded, so that a piece is cut out once and not for each use of it in the test; no lambda, so that all of it is compiled.
    return at.select("row", F.explode_outer(F.array(F.substring("window", F.col("at"), F.col("size")))).alias("gram")).filter(test(F.col("gram")))


def _met_by_shuffle(texts: DataFrame, keyed: DataFrame, lengths: Column) -> DataFrame:
    """Texts beside the names whose piece they hold, with names too many to broadcast.

    A text's pieces, of ``LONG_GRAM`` characters and the ``GRAM`` that they begin with, are held against the piece filter before anything is shuffled; only
    what passes is, as row number and piece, and it is kept, so that pieces met by very many texts can be counted and dealt over several tasks. A row meets a
    piece once however often it holds it, told where pieces meet their names, so what meets needs no shuffle of its own for that. Texts are shuffled at most
    once, to meet their candidates.
    """
    keyed = kept(keyed, "names")
    probe = kept(_held(texts, lengths, piece_filter(keyed, keyed.count())), "pieces")
    hot = probe.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PIECE).select(
        "gram", F.ceil(F.col("n") / HOT_PIECE).cast("int").alias("salts"))
    salted = keyed.join(F.broadcast(hot), "gram", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = probe.join(F.broadcast(hot), "gram", "left").select("row", "gram", F.pmod(F.col("row.a"), F.coalesce("salts", F.lit(1))).cast("int").alias("_salt"))
    met = dealt.repartition("gram", "_salt").distinct().join(unsent(salted), ["gram", "_salt"]).select("row", "brand", "device", "pos")
    return met.join(unsent(texts), "row")


def name_matches(q: DataFrame, cat: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """``(qid, brand, device, pos, full, with_brand, row)`` for each name in each text.

    ``full``: "brand device" is in the text; ``with_brand``: the brand is in it
    somewhere. Every row of ``q`` is matched by itself, also where a qid is null or repeats; ``row`` tells which
    (``text_row``). Rows equal in qid and text have the same ``row`` and all their matches once each.
    """
    names = catalogue_names(cat)
    lengths = names.filter(F.length("device") < GRAM).agg(F.collect_set(F.length("device"))).scalar()
    texts = q.select("qid", text_row().alias("row"), strip(F.lower("text")).alias("_text")).filter(F.col("_text").isNotNull())
    if names_fit(cat, broadcast_names):
        keyed = names.join(unsent(name_keys(names)), "device")
        grams = F.explode_outer(text_grams(F.col("_text"), lengths)).alias("gram")
        met = texts.select("qid", "row", "_text", grams).join(F.broadcast(keyed), "gram")
    else:
        met = _met_by_shuffle(texts, names.join(unsent(name_keys(names, size=LONG_GRAM)), "device"), lengths)
    return (
        met.filter(F.contains("_text", F.col("device")))
        .select(
            "qid", "brand", "device", "pos",
            F.contains("_text", F.concat("brand", F.lit(" "), "device")).alias("full"),
            F.contains("_text", F.col("brand")).alias("with_brand"), "row")
    )


def _by_length() -> list[Column]:
    """Longest text matched first; then file order, the full form before the short one."""
    matched = F.length("device") + F.when(F.col("full"), F.length("brand") + 1).otherwise(F.lit(0))
    return [matched.desc(), F.col("pos"), F.when(F.col("full"), F.lit(0)).otherwise(F.lit(1))]


def device_mentions(q: DataFrame, cat: DataFrame, top: int | None = None, **kw) -> DataFrame:
    """``(qid, rank, brand, device, pos, row)``: different names in each text, ranked longest first.

    With ``top`` only the first few ranks are kept, cut down before the shuffle. Ranks are those of one row of ``q``
    (see ``name_matches``), whatever its qid; of rows equal in qid and text each has all its ranks.
    """
    rank = F.dense_rank().over(W.partitionBy("row").orderBy(*_by_length(), "brand", "device"))
    ranked = name_matches(q, cat, **kw).withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("qid", "rank", "brand", "device", "pos", "row")


def mention_lists(matches: DataFrame) -> DataFrame:
    """One row per text with a match, from ``name_matches``: ``(row, devices)``, the different ``(brand, device, pos)``, longest match first."""
    length = F.length("device") + F.when(F.col("full"), F.length("brand") + 1).otherwise(F.lit(0))
    listed = F.array_sort(F.collect_set(F.struct((-length).alias("place"), "pos", F.when(F.col("full"), 0).otherwise(1).alias("form"), "brand", "device")))
    return matches.groupBy("row").agg(listed.alias("_found")).select(
        "row", F.transform("_found", lambda m: F.struct(m["brand"].alias("brand"), m["device"].alias("device"), m["pos"].alias("pos"))).alias("devices"))


def first_pair_mention(q: DataFrame, cat: DataFrame, **kw) -> DataFrame:
    """``(qid, brand, device, pos, row)``: the first catalogue row, in file order, whose brand and device name are both in the text.

    One row for each different ``(qid, text)``; join it to questions by ``text_row()``.
    """
    return (name_matches(q, cat, **kw).filter("with_brand").groupBy("row")
            .agg(F.first("qid").alias("qid"), F.min_by(F.struct("brand", "device", "pos"), "pos").alias("m")).select("qid", "m.*", "row"))


def match_partial(q: DataFrame, names: DataFrame, cat: DataFrame, n: int = 10, **kw) -> DataFrame:
    """First ``n`` catalogue rows per question by exact name, or else by parts of names.

    ``names`` has ``(qid, brand, device)``. A question none of whose names is in
    the catalogue takes the rows whose brand and device name hold the asked
    ones. Exact matches are all kept.
    """
    rows = cat.withColumns({"_b": F.lower("brand_name"), "_d": F.lower("device_name")})
    full_names = rows.select("_b", "_d").distinct()
    asked = names.select("qid", F.lower("brand").alias("brand"), F.lower("device").alias("device")).join(
        unsent(full_names.select(F.col("_b").alias("brand"), F.col("_d").alias("device"), F.lit(True).alias("known"))),
        ["brand", "device"], "left")
    # The names of one question, and whether any of them is in the catalogue.
    # Used three times below, one of them to see how many names are asked for.
    asked = checkpointed(asked.groupBy("qid").agg(
        F.collect_set(F.struct("brand", "device", F.coalesce("known", F.lit(False)).alias("known"))).alias("names"),
        F.max(F.coalesce("known", F.lit(False))).alias("answered")
    ).select("qid", "answered", F.inline("names")))
    exact = (asked.filter("known").join(rows, (F.col("brand") == F.col("_b")) & (F.col("device") == F.col("_d")))
             .select("qid", *cat.columns, F.lit("exact").alias("how")))

    # The asked name is the part, the catalogue name the text. Rows of the same
    # name are one text; each asked name needs only its first n rows.
    open_asked = asked.filter(~F.col("answered")).select("qid", "brand", "device")
    parts = open_asked.select("brand", "device").distinct().select(
        F.lit(0).cast("bigint").alias("pos"), F.col("brand").alias("brand_name"), F.col("device").alias("device_name"))
    texts = full_names.select(F.struct("_b", "_d").alias("qid"), F.col("_d").alias("text"))
    held = (name_matches(texts, parts, **kw)
            .filter(F.contains(F.col("qid._b"), F.col("brand")))
            .select("brand", "device", F.col("qid._b").alias("_b"), F.col("qid._d").alias("_d")))
    first_of_name = W.partitionBy("brand", "device").orderBy("pos")
    firsts = (held.join(rows.select("_b", "_d", "pos"), ["_b", "_d"]).withColumn("_n", F.row_number().over(first_of_name))
              .filter(F.col("_n") <= n).select("brand", "device", "pos"))
    place = W.partitionBy("qid").orderBy("pos")
    partial = (open_asked.join(firsts, ["brand", "device"]).select("qid", "pos").distinct()
               .withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n)
               .join(cat, "pos").select("qid", *cat.columns, F.lit("partial").alias("how")))
    return exact.unionByName(partial)
