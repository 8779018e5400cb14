"""Elements, attributes and character references of HTML, by expressions over the page's own row.

``content`` makes a page plain first: comments, scripts and styles go, angle brackets inside quoted attribute values and
all references that stand for markup are written one way. Afterwards a tag ends at its first ``>``. A page is then cut into pieces at the tags of one name; each
piece is a tag of that name and all that follows up to the next one, so a position in the list takes the place of an offset in
the text. An element ends at the end tag that balances its start tag among the tags of its name, or else at the end of the page.
"""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from devicelode.functions import let, strip

# A tag with its quotes whole; one with an odd quote ends at its first ``>``.
WHOLE_TAG = r"""<[a-zA-Z](?:(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
BRACKET_IN_QUOTES = r"""=\s*(?:"[^"<>]*[<>]|'[^'<>]*[<>])"""
OTHER_REFERENCES = r"&(?!(?:amp|lt|gt|quot|#39);)"
ANY_TAGS = r"(?:<[/!?]?[a-zA-Z][^>]*>)+"
NO_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: The five references that stay in a page's text until its tags are gone; the ampersand is decoded last.
KEPT = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
BUCKETS = 256
TO_THE_END = 2_147_483_647


# ---- character references -----------------------------------------------------------

def _named() -> list[dict[str, str]]:
    """All names of the standard, dealt by checksum so that a look-up reads a handful."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, chars in html.entities.html5.items():
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = chars
    return buckets


def _remapped() -> list[str]:
    """What the numbers 128 to 159 stand for: the characters of Windows-1252."""
    return [bytes([n]).decode("windows-1252", "ignore") or chr(n) for n in range(128, 160)]


NAMED = json.dumps(_named(), ensure_ascii=False)
#: Names that also hold without a semicolon, in front of any text.
BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len)


def _numbered(ref: Column) -> Column:
    """The character of ``#233;`` or ``#xE9;``; no character is U+FFFD."""
    hexed = F.regexp_extract(ref, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    number = F.regexp_extract(ref, r"^#0*([0-9]+)", 1)
    code = F.coalesce(F.when(hexed != "", F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10).cast("long"))).otherwise(
        F.when(F.length(number) <= 7, number.try_cast("long"))), F.lit(0).cast("long"))

    def of(n: Column) -> Column:
        wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        at = F.get(F.array(*[F.lit(c) for c in _remapped()]), (n - 128).cast("int"))
        return F.when(wrong, F.lit("�")).when(n.between(128, 159), at).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return let(code, of)


def _escaped(chars: Column) -> Column:
    """Characters that would read as markup, as one of the kept references."""
    for ref, char in reversed(KEPT.items()):
        chars = F.replace(chars, F.lit(char), F.lit(ref))
    return chars


def normalised(text: Column) -> Column:
    """All numeric and named references as characters, but for those of markup, which come out as one of ``KEPT``."""
    names = F.from_json(F.lit(NAMED), "array<map<string, string>>")

    def named(ref: Column) -> Column:
        return F.element_at(F.get(names, F.pmod(F.crc32(ref.cast("binary")), F.lit(BUCKETS)).cast("int")), ref)

    def by_prefix(part: Column) -> Column:
        fits = F.filter(F.array(*[F.lit(n) for n in BARE]), lambda n: F.startswith(part, n))
        return let(F.get(fits, F.size(fits) - 1), lambda n: F.when(n.isNull(), F.concat(F.lit("&amp;"), part)).otherwise(
            F.concat(_escaped(named(n)), F.substring(part, F.length(n) + 1, F.length(part)))))

    def resolved(part: Column) -> Column:
        def of(ref: Column) -> Column:
            rest = F.substring(part, F.length(ref) + 1, F.length(part))
            return F.when(ref == "", F.concat(F.lit("&amp;"), part)).when(ref.isin("lt;", "gt;", "amp;", "quot;", "#39;"), F.concat(F.lit("&"), part)).when(
                F.startswith(ref, F.lit("#")), F.concat(_escaped(_numbered(ref)), rest)).otherwise(
                F.coalesce(F.concat(_escaped(named(ref)), rest), by_prefix(part)))

        return let(F.regexp_extract(part, r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)", 0), of)

    def of(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), resolved), ""))

    return F.when(F.regexp_like(text, F.lit(OTHER_REFERENCES)), let(F.split(text, "&"), of)).otherwise(text)


def decode(text: Column) -> Column:
    """The references that ``normalised`` left."""
    for ref, char in KEPT.items():
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


# ---- pages and texts ------------------------------------------------------------------

def _quoted(page: Column) -> Column:
    """Angle brackets inside quoted attribute values as references. Few pages have any; the others pass as they are."""
    def plain(token: Column) -> Column:
        inside = F.substring(token, F.lit(2), F.length(token) - 2)
        return F.when(F.regexp_like(token, F.lit("^<[a-zA-Z]")) & F.endswith(token, F.lit(">")), F.concat(
            F.lit("<"), F.replace(F.replace(inside, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(">"))).otherwise(token)

    tokens = F.regexp_extract_all(page, F.lit(rf"(?s){WHOLE_TAG}|[^<]++|<"), F.lit(0))
    return F.when(F.regexp_like(page, F.lit(BRACKET_IN_QUOTES)), F.array_join(F.transform(tokens, plain), "")).otherwise(page)


def content(page: Column | str) -> Column:
    """HTML without comments, scripts and styles, its tags and references made plain."""
    return let(F.regexp_replace(page, NO_CONTENT, ""), lambda bare: let(_quoted(bare), normalised))


def text_of(fragment: Column) -> Column:
    """Text of a fragment, its pieces run together, outer white space off."""
    return strip(decode(F.regexp_replace(fragment, ANY_TAGS, "")))


def lines_of(fragment: Column) -> Column:
    """Text of a fragment with a line break for every tag between texts."""
    return strip(decode(F.regexp_replace(fragment, ANY_TAGS, "\n")))


# ---- tags ---------------------------------------------------------------------------

def attribute(start_tag: Column, name: str) -> Column:
    """Value of an attribute of the tag that ``start_tag`` begins with, quoted either way or bare; NULL if it has none."""
    other = rf"""(?:[\s/]++|(?!{name}\s*=)[^\s"'>=/]++(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
    pattern = rf"""(?is)^<[a-z][^\s/>]*+{other}{name}\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)"""

    def unquoted(v: Column) -> Column:
        plain = F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.when(v != "", decode(plain))

    return let(F.regexp_extract(start_tag, pattern, 1), unquoted)


def has_word(value: Column, word: str) -> Column:
    """Whether an attribute's value holds a word, as classes do; false for NULL."""
    return F.coalesce(F.array_contains(F.split(value, r"\s+"), word), F.lit(False))


def body(element: Column) -> Column:
    """What stands behind the start tag that ``element`` begins with."""
    return F.substring(element, F.locate(">", element) + 1, F.lit(TO_THE_END))


def pieces(page: Column, tag: str | Column) -> Column:
    """The page cut in front of each start and end tag of a name, which may be a column; the first piece is never a tag."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.split(F.concat(F.lit(" "), page), F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])")))


def _step(piece: Column) -> Column:
    """1 at a start tag, -1 at an end tag, 0 at a tag that is both, and in front of the first."""
    both = F.substring(piece, F.locate(">", piece) - 1, F.lit(1)) == "/"
    return F.when(F.startswith(piece, F.lit("</")), -1).when(F.startswith(piece, F.lit("<")) & ~both, 1).otherwise(0)


def inner(parts: Column, at: Column) -> Column:
    """Inside of the element whose start tag opens piece ``at`` (from 1), up to the end tag that balances it."""
    def of(rest: Column) -> Column:
        state = "struct<depth: int, seen: int, end: int>"

        def walk(s: Column, p: Column) -> Column:
            return let(s["depth"] + _step(p), lambda depth: F.struct(
                F.when(s["end"] >= 0, s["depth"]).otherwise(depth).alias("depth"), (s["seen"] + 1).alias("seen"),
                F.when((s["end"] < 0) & (depth == 0), s["seen"]).otherwise(s["end"]).alias("end")).cast(state))

        first = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("end")).cast(state)
        return let(F.aggregate(rest, first, walk), lambda s: F.concat(body(F.get(parts, at - 1)), F.array_join(
            F.slice(rest, F.lit(1), F.when(s["end"] >= 0, s["end"]).otherwise(s["seen"])), "")))

    return let(F.slice(parts, at + 1, F.size(parts)), of)


def section(page: Column, css_class: str, tag: str = "div") -> Column:
    """Inside of the first element of a class; NULL if there is none."""
    def of(parts: Column) -> Column:
        marked = F.transform(parts, lambda p: F.contains(p, F.lit(css_class)) & (_step(p) == 1) & has_word(attribute(p, "class"), css_class))
        return let(F.array_position(marked, True).cast("int"), lambda at: F.when(at > 0, inner(parts, at)))

    return let(page, lambda whole: F.when(F.contains(whole, F.lit(css_class)), let(pieces(whole, tag), of)))


def by_id(page: Column, name: str) -> Column:
    """Inside of the element of an id, whatever its tag; NULL if there is none."""
    start = rf"""(?is)<([a-z][a-z0-9]*+)(?=\s)(?:[\s/]++|(?!id\s*=)[^\s"'>=/]++(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+id\s*=\s*(?:"{name}"|'{name}'|{name}(?=[\s>]))"""

    def of_page(whole: Column) -> Column:
        def of(parts: Column) -> Column:
            marked = F.transform(parts, lambda p: F.contains(p, F.lit(name)) & (_step(p) == 1) & (F.coalesce(attribute(p, "id"), F.lit("")) == name))
            return let(F.array_position(marked, True).cast("int"), lambda at: F.when(at > 0, inner(parts, at)))

        return let(F.regexp_extract(whole, start, 1), lambda tag: F.when(tag != "", let(pieces(whole, tag), of)))

    return let(page, of_page)


def _opens(piece: Column) -> Column:
    return F.startswith(piece, F.lit("<")) & ~F.startswith(piece, F.lit("</"))


def _by_nesting(parts: Column, one_by_one, nested) -> Column:
    """``one_by_one()`` where no element holds another or is both start and end, else ``nested(depths, spans)``.

    ``depths``: how many elements are open behind each piece; an end tag that ends nothing changes nothing. ``spans``: the elements in the order of their
    start tags, as ``at``, the first piece counted from 0, and ``until``, the one behind the last, the number of pieces where the page leaves it open.
    """
    steps = F.transform(parts, lambda p: _step(p))
    simple = F.regexp_like(F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("</")), ")").otherwise(
        F.when(_opens(p), F.when(_step(p) == 1, "(").otherwise("x")).otherwise(""))), ""), F.lit(r"^(\(\))*\(?$"))

    def of_steps(known: Column) -> Column:
        begin = F.array().cast("array<int>")
        depths = F.aggregate(known, begin, lambda d, s: F.concat(d, F.array(F.greatest(F.coalesce(F.get(d, F.size(d) - 1), F.lit(0)) + s, F.lit(0)))))

        def of_depths(d: Column) -> Column:
            def span(at: Column) -> Column:
                behind = F.array_position(F.transform(F.slice(d, at + 2, F.size(d)), lambda x: x < F.get(d, at)), True).cast("int")
                return F.struct(at.alias("at"), F.when(behind > 0, at + behind).otherwise(F.size(d)).alias("until"))

            starts = F.filter(F.transform(known, lambda s, i: F.when(s == 1, i)), lambda i: i.isNotNull())
            return let(F.transform(starts, span), lambda spans: nested(d, spans))

        return let(depths, of_depths)

    return F.when(simple, one_by_one()).otherwise(let(steps, of_steps))


def elements(page: Column, tag: str) -> Column:
    """All elements of a name that may hold their like: ``array<struct<tag, inner>>`` in the order of their start tags."""
    def of(parts: Column) -> Column:
        def one_by_one() -> Column:
            return F.transform(F.filter(parts, _opens), lambda p: F.struct(p.alias("tag"), body(p).alias("inner")))

        def nested(depths: Column, spans: Column) -> Column:
            def of_span(span: Column) -> Column:
                start = F.get(parts, span["at"])
                rest = F.slice(parts, span["at"] + 2, span["until"] - span["at"] - 1)
                return F.struct(start.alias("tag"), F.concat(body(start), F.array_join(rest, "")).alias("inner"))

            return F.transform(spans, of_span)

        return _by_nesting(parts, one_by_one, nested)

    return let(pieces(page, tag), of)


def flat(page: Column, tag: str) -> Column:
    """All elements of a name that can't hold their like, as start tag and inside: each ends at the next tag of the name."""
    return F.filter(pieces(page, tag), _opens)


def first(page: Column, tag: str) -> Column:
    """Inside of the first element of a name up to its first end tag; NULL if there is none."""
    return let(F.nullif(F.regexp_extract(page, rf"(?i)<{tag}(?=[\s/>])[^>]*>(?:[^<]++|<(?!/{tag}[\s>]))*+", 0), F.lit("")), body)


def start_tag(page: Column, tag: str) -> Column:
    """The first start tag of a name; NULL if there is none."""
    return F.nullif(F.regexp_extract(page, rf"(?i)<{tag}(?=[\s/>])[^>]*>", 0), F.lit(""))


# ---- tables ---------------------------------------------------------------------------

def own_tables(page: Column) -> Column:
    """Texts: first all that stands in no table, then the inside of each table in the order of their start tags.

    The depth behind each start and end tag gives each piece the table nearest around it. In the text of a table, the rows
    and cells of tables inside it are renamed, so that they are no rows of it, and their texts stay.
    """
    def of(parts: Column) -> Column:
        def one_by_one() -> Column:
            return F.concat(F.array(F.array_join(F.filter(parts, lambda p: ~_opens(p)), "")), F.transform(F.filter(parts, _opens), body))

        def nested(depths: Column, spans: Column) -> Column:
            renamed = lambda p: F.regexp_replace(p, r"(?i)<(/?)(table|tr|td|th)(?=[\s/>])", "<$1x-$2")

            def of_span(span: Column) -> Column:
                def piece(i: Column) -> Column:
                    p = F.get(parts, i)
                    return F.when(i == span["at"], body(p)).when(F.get(depths, i) == F.get(depths, span["at"]), p).otherwise(renamed(p))

                return F.array_join(F.transform(F.sequence(span["at"], span["until"] - 1), piece), "")

            loose = F.array_join(F.filter(parts, lambda p, i: F.get(depths, i) == 0), "")
            return F.concat(F.array(loose), F.transform(spans, of_span))

        return _by_nesting(parts, one_by_one, nested)

    return let(pieces(page, "table"), of)
