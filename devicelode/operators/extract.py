"""Rows out of stored pages ``(page_id, url, html)``.

Everything is read from a page by expressions inside its own row (``markup``): no Python worker and, but for picture galleries
kept on another page, no shuffle. Lists are exploded in the outer form and filtered afterwards: a plain explode first tests
for an empty list and so works every list out twice. Comments, scripts and styles are taken off first. Sections and items
end where their tags balance; rows and cells belong to the table nearest around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.functions import (
    digits_int, gallery_url, json_quote, let, resolve_url, snake_key, strip, url_base, url_id,
)
from devicelode.functions.text import DEFAULT_BASE_URL
from devicelode.operators import markup as M
from devicelode.operators.markup import attribute, content, lines_of, text_of
from devicelode.session import checkpointed, unsent

# Cells that carry a promoted field: field -> (data-spec name, category, feature, detailed key). Fixed values.
PROMOTED = {
    "technology": ("nettech", "Network", "Technology", ("network", "technology")),
    "display_type": ("displaytype", "Display", "Type", ("display", "displaytype")),
    "dimensions": ("dimensions", "Body", "Dimensions", ("body", "dimensions")),
    "os": ("os", "Platform", "OS", ("platform", "os")),
    "colors": ("colors", "Misc", "Colors", ("misc", "colors")),
    "battery_type": ("batdescription1", "Battery", "Type", ("battery", "type")),
    "sensors": ("sensors", "Features", "Sensors", ("features", "sensors")),
}
CAMERAS = {
    "main_camera": ("cam1modules", "Main Camera", ["Single", "Dual", "Triple", "Quad"], ("main_camera", "modules")),
    "selfie_camera": ("cam2modules", "Selfie camera", ["Single", "Dual"], ("selfie_camera", "modules")),
}
BAND_FEATURES = ["2G bands", "3G bands", "4G bands", "5G bands"]
REGIONS = ["International", "USA", "EU", "China", "Japan", "Korea", "India"]


# ---- marked cells -----------------------------------------------------------

ROW = r"(?i)<tr(?=[\s/>])[^>]*>((?:[^<]++|<(?!/?tr[\s/>]))*+)"
CELL = r"(?i)<td(?=[\s/>])[^>]*>(?:[^<]++|<(?!/?t[dr][\s/>]))*+"
MARKED = r"(?i)<td(?=[\s/>])(?=[^>]*\bdata-spec)[^>]*>(?:[^<]++|<(?!/?t[dr][\s/>]))*+"


def _all(fragment: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(fragment, F.lit(pattern), F.lit(group))


def marked_cells(own: Column) -> Column:
    """All value cells that carry a ``data-spec`` name, with their insides: ``struct<names, bodies>``."""
    cells = F.flatten(F.transform(F.filter(own, lambda t: F.contains(t, F.lit("data-spec"))), lambda t: _all(t, MARKED, 0)))
    named = F.filter(cells, lambda c: M.has_word(attribute(c, "class"), "nfo") & attribute(c, "data-spec").isNotNull())
    return let(named, lambda cs: F.struct(F.transform(cs, lambda c: attribute(c, "data-spec")).alias("names"),
                                          F.transform(cs, lambda c: M.body(c)).alias("bodies")))


def spec_cell(marked: Column, name: str) -> Column:
    """Inside of the first cell of a name; NULL if there is none."""
    return F.get(marked["bodies"], (F.array_position(marked["names"], name) - 1).cast("int"))


def with_content(pages: DataFrame) -> DataFrame:
    """Add ``_html``, the page's content, ``_own``, the texts of its tables, and ``_marked``, its marked cells."""
    return pages.withColumn("_html", content("html")).withColumn("_own", M.own_tables(F.col("_html"))).withColumn("_marked", marked_cells(F.col("_own")))


# ---- links, listings, chains ---------------------------------------------------

def _links(fragment: Column) -> Column:
    """All links: ``array<struct<href, raw>>``, ``raw`` the inside; those without ``href`` are left out."""
    found = F.transform(M.flat(fragment, "a"), lambda a: F.struct(attribute(a, "href").alias("href"), M.body(a).alias("raw")))
    return F.filter(found, lambda a: a["href"].isNotNull())


def _hrefs(fragment: Column) -> Column:
    return F.array_compact(F.transform(M.flat(fragment, "a"), lambda a: attribute(a, "href")))


def extract_links(pages: DataFrame, section: str | None = None) -> DataFrame:
    """Links of a section (or of the whole page) -> ``(page_id, pos, href, text)``."""
    body = content("html") if section is None else M.section(content("html"), section)
    scoped = pages.select("page_id", body.alias("body"))
    links = scoped.select("page_id", F.posexplode_outer(_links(F.col("body"))).alias("pos", "link")).filter("link IS NOT NULL")
    return links.select("page_id", "pos", "link.href", text_of(F.col("link.raw")).alias("text"))


def extract_brands(pages: DataFrame, base_url: str = DEFAULT_BASE_URL, section: str = "st-text") -> DataFrame:
    """Brand index -> ``(name, url, device_count)``; entries without name or link are left out.

    The name is the link text before its first digit, the count the number in
    front of "devices". Sort with ``catalog.sort_brands``.
    """
    links = extract_links(pages, section)
    name = strip(F.regexp_replace("text", r"\d+.*$", ""))
    count = F.regexp_extract("text", r"(\d+)\s*devices?", 1).try_cast("bigint")
    return links.select(
        "page_id", "pos", name.alias("name"), F.col("href"), F.coalesce(count, F.lit(0).cast("bigint")).alias("device_count")
    ).filter((F.col("name") != "") & (F.col("href") != "")).select(
        "page_id", "pos", "name", resolve_url("href", base_url).alias("url"), "device_count")


def extract_brand_menu(pages: DataFrame, base_url: str = DEFAULT_BASE_URL, section: str = "brandmenu-v2") -> DataFrame:
    """Brand menu -> ``(name, url, device_count)``: the whole link text, and the digits of its span."""
    rows = pages.select("page_id", M.section(content("html"), section).alias("body")).select(
        "page_id", F.posexplode_outer(_links(F.col("body"))).alias("pos", "link")).filter("link IS NOT NULL")
    return rows.select(
        "page_id", "pos", text_of(F.col("link.raw")).alias("name"), resolve_url(F.col("link.href"), base_url).alias("url"),
        digits_int(F.coalesce(M.first(F.col("link.raw"), "span"), F.lit(""))).alias("device_count"))


def extract_listing(pages: DataFrame, base_url: str = DEFAULT_BASE_URL, section: str = "makers") -> DataFrame:
    """Listing page -> ``(page_id, pos, name, url, image_url)``; items whose first link leads nowhere are left out.

    An item inside an item is an item of its own; the outer one holds its link too.
    """
    items = pages.select("page_id", M.section(content("html"), section).alias("body")).select(
        "page_id", F.posexplode_outer(M.elements(F.col("body"), "li")).alias("pos", "item")).filter("item IS NOT NULL")
    link = items.select("page_id", "pos", F.get(M.flat(F.col("item.inner"), "a"), F.lit(0)).alias("a"), M.start_tag(F.col("item.inner"), "img").alias("img"))
    found = link.select("page_id", "pos", attribute(F.col("a"), "href").alias("href"), "a", attribute(F.col("img"), "src").alias("src"))
    return found.filter(F.col("href").isNotNull()).select(
        "page_id", "pos", text_of(M.body(F.col("a"))).alias("name"), resolve_url("href", base_url).alias("url"), F.coalesce("src", F.lit("")).alias("image_url"))


def listing_count(pages: DataFrame) -> DataFrame:
    """Devices a listing says it has: the number in its heading, else its items."""
    html = F.col("_html")
    heading = text_of(F.coalesce(M.first(M.section(html, "review-header"), "h1"), F.lit("")))
    stated = F.regexp_extract(heading, r"(\d+)\s+phones?", 1).try_cast("bigint")
    items = F.size(_all(M.section(html, "makers"), r"(?is)<li[\s/>]", 0)).cast("bigint")
    return pages.withColumn("_html", content("html")).select("page_id", "url", F.coalesce(
        stated, F.nullif(items, F.lit(-1).cast("bigint")), F.lit(0).cast("bigint")).alias("devices"))


def next_page(pages: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Add ``next_url``: the first link after the current-page mark, unless it is ``#``."""
    def after(parts: Column) -> Column:
        mark = F.array_position(F.transform(parts, lambda p: F.startswith(F.lower(F.substring(p, 1, 8)), F.lit("</strong"))), True).cast("int")
        return F.when(mark > 0, F.array_join(F.slice(parts, mark, F.size(parts)), ""))

    behind = let(M.pieces(M.section(content("html"), "nav-pages"), "strong"), after)
    href = F.nullif(attribute(M.start_tag(behind, "a"), "href"), F.lit("#"))
    return pages.withColumn("next_url", resolve_url(href, base_url))


def page_chain(pages: DataFrame, starts: DataFrame, base_url: str = DEFAULT_BASE_URL, on_cycle: str = "error") -> DataFrame:
    """Pages reached from each start by next-page links -> ``(start_url, step, url)``, chains of any length.

    Jumps are doubled: after k rounds a jump crosses 2^k pages, so a chain of n pages takes log2(n) joins. Each round is
    checkpointed, which keeps the plan short and survives lost executors. Each jump knows the smallest address that it
    crosses: a page that is the smallest of its own jump is crossed by itself, so its chain is a cycle, found once jumps are as long as the cycle.
    ``on_cycle``: ``error`` raises and names such pages; ``stop`` ends each chain in front of the first page it has already passed.
    Of pages stored twice under one address the one of the highest ``page_id`` counts.
    """
    if on_cycle not in ("error", "stop"):
        raise ValueError("on_cycle is error or stop")
    have = pages.select("url").distinct()
    latest = next_page(pages, base_url).groupBy("url").agg(F.max_by(F.struct("next_url"), "page_id")["next_url"].alias("next_url"))
    jumps = checkpointed(
        latest.filter(F.col("next_url").isNotNull()).join(have.withColumnRenamed("url", "next_url"), "next_url", "left_semi")
        .select("url", "next_url", F.col("next_url").alias("least")))
    reached = starts.select("url").distinct().join(have, "url", "left_semi").select(
        F.col("url").alias("start_url"), F.lit(0).cast("bigint").alias("step"), "url")
    span, cycles = 1, False
    while not jumps.isEmpty():
        if not cycles and (named := [r["url"] for r in jumps.filter("url = least").orderBy("url").limit(5).collect()]):
            if on_cycle == "error":
                raise ValueError(f"next-page links form a cycle through {', '.join(named)}")
            cycles = True
            reached = checkpointed(reached.groupBy("start_url", "url").agg(F.min("step").alias("step")).select("start_url", "step", "url"))
        further = reached.join(jumps, "url").select(
            "start_url", (F.col("step") + span).alias("step"), F.col("next_url").alias("url"))
        if cycles:
            further = further.groupBy("start_url", "url").agg(F.min("step").alias("step")).join(reached, ["start_url", "url"], "left_anti")
            further = checkpointed(further.select("start_url", "step", "url"))
            if further.isEmpty():
                break
        reached = checkpointed(reached.unionByName(further))
        second = jumps.select(F.col("url").alias("next_url"), F.col("next_url").alias("_far"), F.col("least").alias("_least"))
        jumps = checkpointed(jumps.join(second, "next_url").select("url", F.col("_far").alias("next_url"), F.least("least", "_least").alias("least")))
        span *= 2
    return reached


def page_title(pages: DataFrame) -> DataFrame:
    """Add ``title``: the text of the first heading, ``''`` if there is none."""
    return pages.withColumn("title", _title(content("html")))


def _title(html: Column) -> Column:
    return text_of(F.coalesce(M.first(html, "h1"), F.lit("")))


# ---- specification tables ---------------------------------------------------------

def split_bands(lined: Column, value: Column) -> Column:
    """List of band configurations of a cell; NULL when it is a single plain text.

    Lines make the list. A single line with `` - `` in it is folded over its
    parts: a part that names a region closes the text before it.
    """
    full = F.filter(F.transform(F.split(lined, "\n"), lambda p: strip(p)), lambda p: p != "")
    by_line = F.filter(F.transform(F.split(value, "\n"), lambda p: strip(p)), lambda p: p != "")
    state = "struct<open: string, list: array<string>>"

    def fold(acc, part):
        names_region = part.rlike("|".join(REGIONS))
        joined = F.concat(acc["open"], F.lit(" - "), part)
        closes = names_region & (acc["open"] != "")
        return F.struct(
            F.when(closes, F.lit("")).when(acc["open"] != "", joined).otherwise(part).alias("open"),
            F.when(closes, F.concat(acc["list"], F.array(joined))).otherwise(acc["list"]).alias("list"),
        ).cast(state)

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("list")).cast(state)
    folded = F.aggregate(F.split(value, " - "), start, fold, lambda acc: F.when(
        (acc["open"] != "") & ~F.array_contains(acc["list"], acc["open"]),
        F.concat(acc["list"], F.array(acc["open"]))).otherwise(acc["list"]))
    dashed = F.contains(value, F.lit(" - "))
    several = F.size(F.split(lined, "\n")) > 1
    bands = F.when((F.size(full) <= 1) & dashed, F.when(F.size(by_line) > 1, by_line).otherwise(folded)).otherwise(full)
    return F.when((several | dashed) & (F.size(bands) > 0), bands)


def with_tables(pages: DataFrame) -> DataFrame:
    """Add ``tables``: the specification tables of each page as nested arrays.

    ``array<struct<table_pos, cat, rows: array<struct<row_pos, feature, key, value, bands, more>>>>``;
    ``more`` marks a continuation row. Tables without a heading are left out,
    so are rows that repeat the heading and rows of fewer than two cells.
    """
    def raw_row(tr, i):
        return F.struct(i.alias("row_pos"), M.first(tr, "th").alias("th"), _all(tr, CELL, 0).alias("cells"))

    def raw_table(table, i):
        return F.struct(i.alias("table_pos"), text_of(M.first(table, "th")).alias("cat"), F.transform(_all(table, ROW), raw_row).alias("rows"))

    def texts(row):
        name, body = F.get(row["cells"], F.lit(0)), M.body(F.get(row["cells"], F.lit(1)))
        return F.struct(
            row["row_pos"].alias("row_pos"),
            text_of(M.body(name)).alias("feature"),
            strip(F.coalesce(attribute(name, "data-spec"), F.lit(""))).alias("key"),
            M.has_word(attribute(name, "class"), "ttl").alias("ttl"),
            text_of(body).alias("value"), lines_of(body).alias("lined"))

    def with_bands(cat):
        def of(row):
            banded = (cat == "Network") & row["feature"].isin(BAND_FEATURES)
            return F.struct(
                row["row_pos"].alias("row_pos"), row["feature"].alias("feature"), row["key"].alias("key"),
                row["value"].alias("value"),
                F.when(banded, split_bands(row["lined"], row["value"])).alias("bands"),
                ((row["feature"] == "") & row["ttl"]).alias("more"))
        return of

    def clean_table(t):
        data = F.filter(t["rows"], lambda r: (F.size(r["cells"]) >= 2)
                        & F.coalesce(text_of(r["th"]) != t["cat"], F.lit(True)))
        return F.struct(t["table_pos"].alias("table_pos"), t["cat"].alias("cat"),
                        F.transform(F.transform(data, texts), with_bands(t["cat"])).alias("rows"))

    staged = with_content(pages).withColumn(
        "_tables", F.transform(F.slice("_own", 2, F.size("_own")), raw_table))
    return staged.withColumn(
        "tables", F.transform(F.filter("_tables", lambda t: t["cat"].isNotNull()), clean_table)).drop("_tables", "_own")


def extract_spec_rows(pages: DataFrame) -> DataFrame:
    """Table rows as they stand -> ``(page_id, table_pos, cat, row_pos, feature, key, value, more)``."""
    tables = with_tables(pages).select("page_id", F.inline_outer("tables")).filter("table_pos IS NOT NULL")
    return tables.select("page_id", "table_pos", "cat", F.inline_outer("rows")).filter("row_pos IS NOT NULL").select(
        "page_id", "table_pos", "cat", "row_pos", "feature",
        F.when(F.col("key") != "", F.col("key")).otherwise(snake_key("feature")).alias("key"), "value", "more")


def _folded(rows: Column) -> Column:
    """Rows with their continuation rows: ``array<struct<feature, key, items, listed>>``.

    A continuation adds its value to the last row that has a feature name.
    """
    def of_heads(heads):
        def join_up(head, i):
            until = F.coalesce(F.get(heads, i + 1)["row_pos"], F.lit(2_147_483_647))
            more = F.when(head["feature"] != "", F.filter(
                rows, lambda r: r["more"] & (r["row_pos"] > head["row_pos"]) & (r["row_pos"] < until)))
            extra = F.coalesce(F.transform(more, lambda r: r["value"]), F.array().cast("array<string>"))
            return let(extra, lambda values: F.struct(
                head["feature"].alias("feature"), head["key"].alias("key"), head["value"].alias("value"),
                F.concat(F.coalesce(head["bands"], F.array(head["value"])), values).alias("items"),
                (head["bands"].isNotNull() | (F.size(values) > 0)).alias("listed"), head["bands"].alias("bands")))

        return F.transform(heads, join_up)

    return let(F.filter(rows, lambda r: ~r["more"]), of_heads)


def with_folded(pages: DataFrame) -> DataFrame:
    """Add ``folded``: the tables with continuation rows joined to their feature."""
    return with_tables(pages).withColumn("folded", F.transform("tables", lambda t: F.struct(
        t["table_pos"].alias("table_pos"), t["cat"].alias("cat"), _folded(t["rows"]).alias("rows"))))


def fold_continuations(pages: DataFrame) -> DataFrame:
    """``(page_id, table_pos, cat, feature, item_pos, item, listed)``: every value of every feature."""
    tables = with_folded(pages).select("page_id", F.inline_outer("folded")).filter("table_pos IS NOT NULL")
    rows = tables.select("page_id", "table_pos", "cat", F.inline_outer("rows")).filter("feature IS NOT NULL")
    return rows.select("page_id", "table_pos", "cat", "feature", "listed", F.posexplode_outer("items").alias("item_pos", "item"))


# ---- promoted fields ------------------------------------------------------------------

def _json_items(items: Column, listed: Column) -> Column:
    quoted = F.transform(items, lambda x: json_quote(x))
    return F.when(listed, F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))).otherwise(F.get(quoted, F.lit(0)))


def _table_rows(folded: Column, cat: str) -> Column:
    return F.flatten(F.transform(F.filter(folded, lambda t: t["cat"] == cat), lambda t: t["rows"]))


def _plain(row: Column) -> Column:
    """Value as text; a list as its JSON."""
    return F.when(row["listed"], _json_items(row["items"], row["listed"])).otherwise(F.get(row["items"], F.lit(0)))


def _promoted(field: str) -> Column:
    spec, cat, feature, _ = PROMOTED[field]
    rows = F.filter(_table_rows(F.col("folded"), cat), lambda r: r["feature"] == feature)
    from_table = F.get(F.transform(rows, _plain), F.size(rows) - 1)
    return F.coalesce(text_of(spec_cell(F.col("_marked"), spec)), from_table, F.lit(""))


def _camera(field: str) -> Column:
    spec, cat, features, _ = CAMERAS[field]
    rows = F.filter(_table_rows(F.col("folded"), cat), lambda r: r["feature"].isin(features))
    from_table = F.get(F.transform(rows, _plain), F.lit(0))
    return F.coalesce(lines_of(spec_cell(F.col("_marked"), spec)), from_table, F.lit(""))


def promote_fields(pages: DataFrame) -> DataFrame:
    """Add the promoted text fields: the marked cell, else the table row, else ``''``."""
    return with_folded(pages).withColumns({f: _promoted(f) for f in PROMOTED}).drop("_html", "_marked", "tables", "folded")


def promote_cameras(pages: DataFrame) -> DataFrame:
    """Add ``main_camera`` and ``selfie_camera``: the marked cell with its lines, else the first camera row."""
    return with_folded(pages).withColumns({f: _camera(f) for f in CAMERAS}).drop("_html", "_marked", "tables", "folded")


def price_info(pages: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Add ``price_info`` (JSON of text and link, ``{}`` without a price) and ``features_other``."""
    other = lines_of(spec_cell(F.col("_marked"), "featuresother"))
    return with_content(pages).withColumns({
        "price_info": _price_json(F.col("_marked"), base_url),
        "features_other": F.nullif(other, F.lit("")),
    }).drop("_html", "_own", "_marked")


def _price_json(marked: Column, base_url: str) -> Column:
    cell = spec_cell(marked, "price")
    href = F.nullif(attribute(M.start_tag(cell, "a"), "href"), F.lit(""))
    filled = F.to_json(F.struct(text_of(cell).alias("text"), resolve_url(href, base_url).alias("url")))
    return F.when(cell.isNull(), F.lit("{}")).otherwise(filled)


# ---- pictures ---------------------------------------------------------------------------

def own_pictures(html: Column, base_url: str = DEFAULT_BASE_URL) -> Column:
    """Main picture, then thumbnails, of a specification page."""
    main = F.slice(_hrefs(M.section(html, "specs-photo-main")), 1, 1)
    thumbs = _hrefs(M.section(html, "specs-photo-sub"))
    none = F.array().cast("array<string>")
    links = F.filter(F.concat(F.coalesce(main, none), F.coalesce(thumbs, none)), lambda h: h != "")
    return F.filter(F.transform(links, lambda h: resolve_url(h, base_url)), lambda u: ~u.endswith(".php"))


def gallery_images(html: Column) -> Column:
    """Images of a gallery page, placeholders left out."""
    images = F.transform(M.flat(M.by_id(html, "pictures-list"), "img"), lambda i: attribute(i, "src"))
    return F.filter(F.array_compact(images), lambda u: (u != "") & ~u.endswith("placeholder.jpg"))


def picture_list(pages: DataFrame, galleries: DataFrame | None = None, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """``(page_id, url, pictures)``: own pictures, then new ones of the page's gallery.

    Galleries are other stored pages, found by the URL made from the page's
    own; of several under one URL that of the highest ``page_id`` counts.
    Only picture lists are shuffled for that, not pages.
    """
    own = pages.select("page_id", "url", content("html").alias("_html")).select(
        "page_id", "url", own_pictures(F.col("_html"), base_url).alias("own"), gallery_url(url_base("url"), url_id("url"), base_url).alias("gallery"))
    if galleries is None:
        return own.select("page_id", "url", F.col("own").alias("pictures"))
    more = galleries.select("page_id", F.col("url").alias("gallery"), F.filter(
        gallery_images(content("html")), lambda u: ~u.endswith(".php")).alias("images"))
    more = more.groupBy("gallery").agg(F.max_by("images", "page_id").alias("images"))
    added = F.array_except(F.coalesce("images", F.array().cast("array<string>")), F.col("own"))
    return own.join(unsent(more), "gallery", "left").select("page_id", "url", F.concat("own", added).alias("pictures"))


# ---- whole records ------------------------------------------------------------------------

def _document(entries: Column) -> Column:
    """``array<struct<cat, key, json>>`` -> JSON object text; a repeated key keeps its place and takes its last value.

    An entry without a key sets a scalar at the top; without a value too it
    only makes sure the category is there.
    """
    def last(found):
        return F.get(found, F.size(found) - 1)["json"]

    def of_entries(known):
        def category(c):
            def parts(own):
                def fields(keyed):
                    return F.transform(F.array_distinct(F.transform(keyed, lambda e: e["key"])), lambda k: F.concat(
                        json_quote(k), F.lit(":"), let(F.filter(keyed, lambda e: e["key"] == k), last)))

                inner = F.array_join(let(F.filter(own, lambda e: e["key"].isNotNull()), fields), ",")
                scalar = F.filter(own, lambda e: e["key"].isNull())
                return F.coalesce(let(scalar, last), F.concat(F.lit("{"), inner, F.lit("}")))

            own = F.filter(known, lambda e: (e["cat"] == c) & e["json"].isNotNull())
            return F.concat(json_quote(c), F.lit(":"), let(own, parts))

        cats = F.array_distinct(F.transform(known, lambda e: e["cat"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(cats, category), ","), F.lit("}"))

    return let(entries, of_entries)


ENTRY = "array<struct<cat: string, key: string, json: string>>"


def _entry(cat, key, json) -> Column:
    return F.struct(cat.alias("cat"), key.alias("key"), json.alias("json"))


def _spec_entries(folded: Column) -> Column:
    nothing = F.lit(None).cast("string")

    def of_table(t):
        def of_row(r):
            value = _json_items(r["items"], r["listed"])
            # The network technology is also a field of its own at the top.
            alone = F.when((t["cat"] == "Network") & (r["feature"] == "Technology"),
                           _entry(F.lit("technology"), nothing, json_quote(r["value"])))
            return F.array(_entry(t["cat"], r["feature"], value), alone)

        rows = F.flatten(F.transform(t["rows"], of_row))
        return F.concat(F.array(_entry(t["cat"], nothing, nothing)), rows)

    return F.array_compact(F.flatten(F.transform(folded, of_table))).cast(ENTRY)


def _detailed_entries(folded: Column, base_url: str) -> Column:
    nothing = F.lit(None).cast("string")

    def of_table(t):
        cat = F.replace(F.lower(t["cat"]), F.lit(" "), F.lit("_"))

        def of_row(r):
            first = F.coalesce(r["bands"], F.array(r["value"]))
            key = F.when(r["key"] != "", r["key"]).otherwise(snake_key(r["feature"]))
            alone = F.when((t["cat"] == "Network") & (r["feature"] == "Technology"),
                           _entry(F.lit("network"), F.lit("technology"), json_quote(r["value"])))
            return F.array(alone, _entry(cat, key, _json_items(first, r["bands"].isNotNull())))

        return F.concat(F.array(_entry(cat, nothing, nothing)), F.flatten(F.transform(t["rows"], of_row)))

    named = {f: PROMOTED[f][3] for f in ("technology", "display_type", "dimensions", "os", "colors", "battery_type")}
    named |= {f: CAMERAS[f][3] for f in CAMERAS} | {"sensors": PROMOTED["sensors"][3]}
    promoted = [F.when(F.col(f) != "", _entry(F.lit(c), F.lit(k), json_quote(F.col(f)))) for f, (c, k) in named.items()]
    other = F.nullif(lines_of(spec_cell(F.col("_marked"), "featuresother")), F.lit(""))
    price = F.nullif(F.col("price_info"), F.lit("{}"))
    tail = F.array(*promoted, F.when(other.isNotNull(), _entry(F.lit("features"), F.lit("other"), json_quote(other))),
                   F.when(price.isNotNull(), _entry(F.lit("price"), nothing, price)))
    return F.array_compact(F.concat(F.flatten(F.transform(folded, of_table)), tail)).cast(ENTRY)


def assemble_records(pages: DataFrame, galleries: DataFrame | None = None, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Specification pages -> one full record each, in the 14-column layout plus ``detailed_specs``."""
    folded = with_folded(pages).withColumn("title", _title(F.col("_html")))
    fields = folded.withColumns({f: _promoted(f) for f in PROMOTED} | {f: _camera(f) for f in CAMERAS}).withColumn(
        "price_info", _price_json(F.col("_marked"), base_url))
    records = fields.select(
        "page_id", F.col("url").alias("device_url"), F.col("title").alias("name"),
        F.to_json(own_pictures(F.col("_html"), base_url)).alias("pictures"),
        _document(_spec_entries(F.col("folded"))).alias("specifications"),
        _document(_detailed_entries(F.col("folded"), base_url)).alias("detailed_specs"),
        "technology", "display_type", "dimensions", "os", "colors", "battery_type",
        "main_camera", "selfie_camera", "sensors", "price_info")
    if galleries is None:
        return records
    cols = records.columns
    pics = picture_list(pages, galleries, base_url).select("page_id", F.to_json("pictures").alias("pictures"))
    return records.drop("pictures").join(unsent(pics), "page_id").select(*cols)
