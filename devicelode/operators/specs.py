"""Specification documents: parsing, look-ups, highlights and report texts.

A document is JSON ``{category: {feature: value or list}}`` with some scalars at
the top. It is parsed once into a map per row; look-ups are then expressions
over that map, so nothing here is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode import dictionaries as D
from devicelode.functions import fill, full_name, let, lookup, readable_key, title_case

RAW_MAP = "map<string,string>"
FOUND = "array<struct<path: string, key: string, value: string>>"
FEATURE = "array<struct<key: string, value: string>>"
NO_MATCH = "Not specified"


def as_map(c: Column | str) -> Column:
    """JSON object text -> map of raw texts in key order; NULL for anything else.

    Most values are plain text; they are told by their first character, which
    costs far less than a failed parse.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.ltrim(c).startswith("{"), F.from_json(c, RAW_MAP))


def parse_specs(df: DataFrame, column: str = "specifications", out: str = "specs") -> DataFrame:
    """Add the parsed document, an empty map when it is missing or malformed."""
    empty = F.create_map().cast(RAW_MAP)
    return df.withColumn(out, F.coalesce(as_map(column), empty))


def with_nested(df: DataFrame, specs: str = "specs", out: str = "nested") -> DataFrame:
    """Add the second level: category -> its map, NULL where the value is no object."""
    return df.withColumn(out, F.transform_values(specs, lambda k, v: as_map(v)))


def spec_rows(df: DataFrame, specs: str = "specs") -> DataFrame:
    """Long rows ``(device_url, cat_pos, cat, key, pos, value)``; top-level scalars have no key."""
    cats = df.select("device_url", F.posexplode_outer(specs).alias("cat_pos", "cat", "raw")).filter("cat IS NOT NULL")
    inner = cats.select("device_url", "cat_pos", "cat", "raw", as_map("raw").alias("m"))
    return inner.select("device_url", "cat_pos", "cat", "raw", "m", F.posexplode_outer("m").alias("pos", "key", "v")).filter(
        F.col("m").isNull() | F.col("key").isNotNull()
    ).select("device_url", "cat_pos", "cat", "key", "pos",
             F.when(F.col("m").isNull(), F.col("raw")).otherwise(F.col("v")).alias("value"))


def parse_pictures(df: DataFrame, column: str = "pictures") -> DataFrame:
    """Picture list from its text, single quotes allowed; NULL unless it has elements."""
    parsed = F.from_json(F.replace(F.col(column), F.lit("'"), F.lit('"')), "array<string>")
    return df.withColumn(column, F.when(F.size(parsed) > 0, parsed))


# ---- requested specifications ---------------------------------------------

def document_entries(specs: Column, nested: Column) -> Column:
    """All entries of a document with the path they are found by: ``array<struct<path, key, value>>``.

    First those found at the top, by category: the fields of an object, or a
    plain value under the category's own name. Then those one level down, by
    feature name, in the same way.
    """

    def entry(path, key, value):
        return F.struct(path.alias("path"), key.alias("key"), value.alias("value"))

    def found(path, raw, inner):
        return F.when(raw.isNull(), F.array().cast(FOUND)).when(
            inner.isNotNull(), F.transform(F.map_entries(inner), lambda e: entry(path, e["key"], e["value"]))
        ).otherwise(F.array(entry(path, path, raw)))

    def of_document(inner):
        top = F.flatten(F.transform(
            F.map_entries(specs), lambda c: found(c["key"], c["value"], F.try_element_at(inner, c["key"]))))
        features = F.flatten(F.transform(
            F.map_values(inner), lambda m: F.coalesce(F.map_entries(m), F.array().cast(FEATURE))))
        below = F.flatten(F.transform(features, lambda f: let(as_map(f["value"]), lambda m: found(f["key"], f["value"], m))))
        return F.concat(top, below)

    return let(nested, of_document)


def with_entries(df: DataFrame, out: str = "entries") -> DataFrame:
    """Add the entries of the documents to rows with ``specs`` and ``nested``."""
    return df.withColumn(out, document_entries(F.col("specs"), F.col("nested")))


def entries_of(kinds: Column, entries: Column, paths: Mapping[str, Sequence[str]] = D.SPEC_PATHS) -> Column:
    """Entries for each kind, its paths in order, keys possibly repeated."""
    places = F.create_map(*[x for kind, ps in paths.items() for x in (F.lit(kind), F.array(*[F.lit(p) for p in ps]))])

    def of_document(known):
        def of_kind(kind):
            def at_path(path):
                return F.transform(F.filter(known, lambda e: e["path"] == path), lambda e: F.struct(
                    kind.alias("spec_type"), e["key"].alias("key"), e["value"].alias("value")))

            wanted = F.coalesce(F.try_element_at(places, kind), F.array().cast("array<string>"))
            return F.flatten(F.transform(wanted, at_path))

        return F.flatten(F.transform(kinds, of_kind))

    return let(entries, of_document)


def _first_of_key(entries: Column) -> Column:
    """Each key once, case ignored, where it comes first."""

    def first(found):
        def by_keys(keys):
            return F.filter(found, lambda e, i: F.array_position(keys, F.get(keys, i)) == i + 1)

        return let(F.transform(found, lambda e: F.lower(e["key"])), by_keys)

    return let(entries, first)


def requested_specs(df: DataFrame, requested: str = "specifications", out: str = "requested",
                    paths: Mapping[str, Sequence[str]] = D.SPEC_PATHS) -> DataFrame:
    """Add the entries asked for; a key is kept once over **all** kinds, the first in order.

    ``df`` has the document's ``entries`` and the array of requested kinds.
    """
    return df.withColumn(out, _first_of_key(entries_of(F.col(requested), F.col("entries"), paths)))


def comparison_texts(entries: Column, kinds: Column | Sequence[str] = tuple(D.SPEC_PATHS)) -> Column:
    """Map of kind -> its entries as ``k: v, k: v``; kinds without entries are "Not specified". ``kinds`` may be a column of lists."""
    all_kinds = kinds if isinstance(kinds, Column) else F.array(*[F.lit(k) for k in kinds])

    def shown(e):
        inner = as_map(e["value"])
        flat = F.array_join(F.transform(F.map_entries(inner), lambda s: F.concat(s["key"], F.lit(": "), s["value"])), ", ")
        return F.concat(e["key"], F.lit(": "), F.coalesce(flat, e["value"]))

    def of_document(known):
        def text(kind):
            found = _first_of_key(entries_of(F.array(kind), known))
            return F.coalesce(F.nullif(F.array_join(F.transform(found, shown), ", "), F.lit("")), F.lit(NO_MATCH))

        return F.transform(all_kinds, text)

    return F.map_from_arrays(all_kinds, let(entries, of_document))


# ---- highlights and texts -----------------------------------------------------

def _camera(specs: Column, nested: Column) -> Column:
    """Camera modules: of the category's object, or the category's own text."""
    name = F.when(F.map_contains_key(specs, F.lit("main_camera")), F.lit("main_camera")).otherwise(F.lit("Main Camera"))
    inner, raw = F.try_element_at(nested, name), F.try_element_at(specs, name)
    return F.when(inner.isNotNull(), F.try_element_at(inner, F.lit("modules"))).otherwise(raw)


def _battery(specs: Column, nested: Column) -> Column:
    return F.when(F.map_contains_key(specs, F.lit("battery_type")), F.try_element_at(specs, F.lit("battery_type"))).otherwise(
        F.try_element_at(F.try_element_at(nested, F.lit("battery")), F.lit("type")))


def _inner(specs: Column, nested: Column, low: str, title: str, key: str) -> Column:
    """``nested[low][key]``, from the title-case category only if the lower-case one is absent; empty is NULL."""
    name = F.when(F.map_contains_key(specs, F.lit(low)), F.lit(low)).otherwise(F.lit(title))
    return F.nullif(F.try_element_at(F.try_element_at(nested, name), F.lit(key)), F.lit(""))


def main_facts(specs: Column, nested: Column) -> dict[str, Column]:
    """The five facts highlights are made of, by focus area."""
    return {
        "camera": _camera(specs, nested),
        "battery": _battery(specs, nested),
        "performance": _inner(specs, nested, "platform", "Platform", "chipset"),
        "display": _inner(specs, nested, "display", "Display", "size"),
        "storage": _inner(specs, nested, "memory", "Memory", "internal"),
    }


# How a fact is introduced (fixed values).
FACT_LABELS = {"camera": "Main camera", "battery": "Battery", "performance": "Processor",
               "display": "Display", "storage": "Storage"}
TIER_LINES = {"high_end": "Premium flagship device", "mid_range": "Great value mid-range device",
              "budget": "Affordable device with good features"}


def with_facts(df: DataFrame) -> DataFrame:
    """Add the struct of main facts to rows with ``specs`` and ``nested``."""
    facts = main_facts(F.col("specs"), F.col("nested"))
    return df.withColumn("facts", F.struct(*[c.alias(n) for n, c in facts.items()]))


def main_highlights(focus: Column, facts: Column) -> Column:
    """Lines for the main facts that were asked for; all of them when nothing was."""
    wanted = lambda area: (F.size(focus) == 0) | F.array_contains(focus, area)
    return F.array_compact(F.array(*[
        F.when(wanted(area), F.concat(F.lit(f"{label}: "), facts[area])) for area, label in FACT_LABELS.items()]))


def other_highlights(focus: Column, specs: Column, nested: Column) -> Column:
    """For each other focus area the first entry of every category named after it.

    The search for an area ends at the first such category that is no object.
    """

    def of_document(inner):
        def lines(area):
            def line(k):
                first = F.get(F.map_entries(F.try_element_at(inner, k)), F.lit(0))
                return F.when(F.try_element_at(inner, k).isNull(), F.concat(
                    title_case(area), F.lit(": "), F.try_element_at(specs, k))
                ).otherwise(F.concat(title_case(area), F.lit(" - "), first["key"], F.lit(": "), first["value"]))

            def reached(named):
                scalar_at = F.array_position(F.transform(named, lambda k: F.try_element_at(inner, k).isNull()), True)
                return F.when(scalar_at > 0, F.slice(named, 1, scalar_at.cast("int"))).otherwise(named)

            named = F.filter(F.map_keys(inner), lambda k: F.contains(F.lower(k), F.lower(area)))
            return F.array_compact(F.transform(let(named, reached), line))

        return F.flatten(F.transform(rest, lines))

    rest = F.filter(focus, lambda a: ~a.isin(list(FACT_LABELS)))
    return let(nested, of_document)


def highlights(df: DataFrame, focus: str = "focus_areas", tier: str = "tier", out: str = "highlights") -> DataFrame:
    """Add the highlight lines of each row, with the generic and the tier line as last resorts.

    ``df`` has ``specs``, ``nested``, ``facts``, the focus areas and the tier.
    """
    areas = F.col(focus)
    found = df.withColumn("_lines", F.concat(
        main_highlights(areas, F.col("facts")), other_highlights(areas, F.col("specs"), F.col("nested"))))
    generic = F.concat(F.lit("A great choice for "), F.array_join(areas, ", "))
    by_tier = F.coalesce(*[F.when(F.col(tier) == t, F.lit(line)) for t, line in TIER_LINES.items()])
    return found.withColumn(out, F.when(F.size("_lines") > 0, F.col("_lines"))
                            .when(F.size(areas) > 0, F.array(generic)).otherwise(F.array(by_tier))).drop("_lines")


# Sentences of the answers (fixed values).
FOUND_DEVICE = ("I found information about {brand_name} {device_name}. Would you like to know about its "
                "specifications, price, or something else?")
MORE = " Would you like to know more specific information about this device?"
SPEC_INTRO = "Here are the {specs} specifications for the {device_name}:"


def device_summary(df: DataFrame) -> DataFrame:
    """Add a few sentences about each device from its main facts."""
    f = F.col("facts")
    sentences = F.array_compact(F.array(
        F.concat(F.lit("It has a "), f["display"], F.lit(" display")),
        F.concat(F.lit("It's powered by a "), f["performance"]),
        F.concat(F.lit("The main camera is "), f["camera"]),
        F.concat(F.lit("It has a "), f["battery"])))
    body = F.when(F.size(sentences) > 0, F.concat(F.lit(" "), F.array_join(sentences, ". "), F.lit("."))).otherwise(F.lit(""))
    return df.withColumn("summary", F.concat(
        fill(FOUND_DEVICE, brand_name="brand_name", device_name="device_name"), body, F.lit(MORE)))


def spec_report(df: DataFrame, requested: str = "specifications", entries: str = "requested") -> DataFrame:
    """Add the report text: one block of lines per kind, keys made readable; NULL when there is nothing to tell."""
    kinds = F.array_distinct(F.col(requested))

    def line(e):
        inner = as_map(e["value"])
        flat = F.array_join(F.transform(F.map_entries(inner), lambda s: F.concat(
            readable_key(s["key"]), F.lit(": "), s["value"])), ", ")
        return F.concat(F.lit("  - "), readable_key(e["key"]), F.lit(": "), F.coalesce(flat, e["value"]), F.lit("\n"))

    def block(kind):
        own = F.filter(F.col(entries), lambda e: e["spec_type"] == kind)
        head = F.concat(F.lit("• "), F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, F.lit(2), F.length(kind)))), F.lit(":\n"))
        return F.concat(head, F.array_join(F.transform(own, line), ""), F.lit("\n"))

    known = F.filter(kinds, lambda k: k.isin(list(D.SPEC_PATHS)))
    intro = fill(SPEC_INTRO, specs=F.array_join(F.col(requested), ", "), device_name=full_name("brand_name", "device_name"))
    body = F.array_join(F.transform(known, block), "")
    report = F.btrim(F.concat(intro, F.lit("\n\n"), body), F.lit(" \n"))
    return df.withColumn("report", F.when((F.size("specs") > 0) & (F.size(known) > 0), report))


def spec_lookup(df: DataFrame, out: str, *names: str) -> DataFrame:
    """Add the raw value of the first category that is there."""
    return df.withColumn(out, lookup("specs", *names))
