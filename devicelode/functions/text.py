"""Scalar functions over columns. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from both ends of a text, the Unicode white space set.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

DEFAULT_BASE_URL = "https://www.example.com/"

# Requests per minute allowed for each tier (fixed values).
TIER_LIMITS = {"basic": 60, "premium": 300}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalise(c: Column | str) -> Column:
    """Lower case, outer white space removed."""
    return strip(F.lower(_col(c)))


def snake_key(c: Column | str) -> Column:
    """``Main Camera`` -> ``main_camera``; hyphens count as spaces."""
    return F.translate(F.lower(_col(c)), " -", "__")


def title_case(c: Column | str) -> Column:
    """Upper case for each letter that follows a non-letter, else lower case.

    ``initcap`` only starts words after white space, so ``2g/3g`` would differ.
    """
    chars = F.split(_col(c), "")
    before = F.concat(F.array(F.lit("")), chars)  # one longer; its last pair is NULL and dropped

    def cased(ch, prev):
        return F.when(F.upper(prev) != F.lower(prev), F.lower(ch)).otherwise(F.upper(ch))

    return F.array_join(F.zip_with(chars, before, cased), "")


def readable_key(c: Column | str) -> Column:
    """``battery_type`` -> ``Battery Type``."""
    return title_case(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def digits_int(c: Column | str) -> Column:
    """All digits of a text read as one integer; 0 when there are none."""
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def url_id(url: Column | str) -> Column:
    """Id of a device page: text after the last ``-``, up to the first ``.``."""
    return F.substring_index(F.substring_index(_col(url), "-", -1), ".", 1)


def url_base(url: Column | str) -> Column:
    """Last path part up to its first dot, without a trailing ``-id``."""
    stem = F.substring_index(F.substring_index(_col(url), "/", -1), ".", 1)
    return F.regexp_replace(stem, "-[^-]*$", "")


def gallery_url(base: Column | str, page_id: Column | str, base_url: str = DEFAULT_BASE_URL) -> Column:
    return F.concat(F.lit(base_url), _col(base), F.lit("-pictures-"), _col(page_id), F.lit(".php"))


def resolve_url(href: Column | str, base_url: str = DEFAULT_BASE_URL) -> Column:
    return F.concat(F.lit(base_url), _col(href))


def mask_key(c: Column | str) -> Column:
    """First eight characters, dots, last four. Short keys overlap, as text slices do."""
    c = _col(c)
    return F.concat(F.left(c, F.lit(8)), F.lit("..."), F.right(c, F.lit(4)))


def _age_seconds(ts: Column | str, now: Column | str) -> Column:
    micros = F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(_col(ts).cast("timestamp"))
    return micros / F.lit(1_000_000)


def age_text(ts: Column | str, now: Column | str) -> Column:
    """Age in the largest whole unit among seconds, minutes, hours and days."""
    secs = _age_seconds(ts, now)

    def words(divisor, unit):
        # cast truncates towards zero
        return F.concat((secs / divisor).cast("bigint").cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(secs < 60, words(1, "seconds"))
        .when(secs < 3600, words(60, "minutes"))
        .when(secs < 86400, words(3600, "hours"))
        .when(secs >= 86400, words(86400, "days"))
    )


def is_expired(ts: Column | str, now: Column | str, hours: float = 24) -> Column:
    """True when strictly older than ``hours``."""
    return _age_seconds(ts, now) / 3600 > F.lit(float(hours))


def iso_ts(c: Column | str) -> Column:
    """ISO-8601 text to timestamp; bad text gives NULL."""
    return _col(c).try_cast("timestamp")


def ts_iso(c: Column | str) -> Column:
    """Timestamp to ISO text; microseconds are left out when they are zero."""
    c = _col(c).cast("timestamp")
    whole = F.unix_micros(c) % 1_000_000 == 0
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def full_name(brand: Column | str, device: Column | str) -> Column:
    return F.concat(_col(brand), F.lit(" "), _col(device))


def device_key(brand: Column | str, device: Column | str) -> Column:
    return F.concat(_col(brand), F.lit("_"), _col(device))


def lookup(mapping: Column | str, *names: str) -> Column:
    """Value of the first of ``names`` that is a key of the map."""
    m = _col(mapping)
    return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])


def join_list(arr: Column | str, sep: str = ", ") -> Column:
    return F.array_join(_col(arr), sep)


def percent(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100``, and 100 when there is nothing to divide by."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(100.0))


def valid_tier(c: Column | str) -> Column:
    """Known tiers pass, all else (NULL too) becomes ``basic``."""
    c = _col(c)
    return F.when(c.isin(list(TIER_LIMITS)), c).otherwise(F.lit("basic"))


def tier_limit(c: Column | str) -> Column:
    """Requests per minute for a tier."""
    out = F.lit(TIER_LIMITS["basic"])
    return F.when(_col(c) == "premium", F.lit(TIER_LIMITS["premium"])).otherwise(out)


def fill(template: str, **fields: Column | str) -> Column:
    """Put columns into the ``{name}`` places of a fixed template.

    The template is cut up when the plan is made, so a value that itself holds
    braces is never filled again.
    """
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(_col(fields[piece]).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row.

    Inside a lambda an outer expression is evaluated again for every element,
    and the optimizer may move one there; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_quote(c: Column | str) -> Column:
    """A text as a quoted, escaped JSON string."""
    wrapped = F.to_json(F.struct(_col(c).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
