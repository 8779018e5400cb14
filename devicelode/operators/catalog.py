"""Filters, paging, projections, set rules and counts over a catalogue.

A catalogue is ``(pos, brand_name, device_name, device_url, device_image)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelode.dictionaries import POPULAR_BRANDS
from devicelode.functions import full_name, strip
from devicelode.functions.text import DEFAULT_BASE_URL
from devicelode.operators.ordered import dense_position, first_per_key

# Up to this many rows a page is picked by a top-k; deeper pages are picked by rank.
TOP_K_ROWS = 10_000
# Values looked at to cut a table into ranges, and the number of cuts.
SAMPLE, CUTS = 4_000, 64


# ---- filters -------------------------------------------------------------

def by_brand(cat: DataFrame, brand: str | None) -> DataFrame:
    """Rows of one brand, case ignored; ``None`` keeps all."""
    return cat if brand is None else cat.filter(F.lower("brand_name") == F.lit(brand.lower()))


def search(cat: DataFrame, text: str) -> DataFrame:
    """Rows whose brand or device name holds ``text``, case ignored."""
    needle = F.lit(text.lower())
    return cat.filter(F.contains(F.lower("brand_name"), needle) | F.contains(F.lower("device_name"), needle))


def search_full_name(cat: DataFrame, text: str, n: int = 10) -> DataFrame:
    """First ``n`` rows whose device name, or "brand device", holds ``text``."""
    needle = F.lit(text.lower())
    found = F.contains(F.lower("device_name"), needle) | F.contains(
        F.lower(full_name("brand_name", "device_name")), needle)
    return head(cat.filter(found), n)


def _bounds(rows: DataFrame, key: str, size: int) -> list:
    """Values of ``key`` that cut the rows into parts of about one size: some of a sample, at least one unless all are NULL."""
    some = rows.filter(F.col(key).isNotNull()).select(key)
    values = {v for (v,) in some.sample(min(1.0, SAMPLE / size), 7).collect() if v == v}
    if not values:
        least = some.agg(F.min(key)).first()[0]
        return [] if least is None else [least]
    ranked = sorted(values)
    return sorted({ranked[i * len(ranked) // CUTS] for i in range(CUTS)})


def _slice(rows: DataFrame, keys: list[str], skip: int, take: int, size: int) -> list[DataFrame]:
    """Rows ``skip + 1`` to ``skip + take`` of ``size`` by ``keys``, as parts in order.

    Bounds cut the rows into ranges between two bounds and ranges of one value; their counts tell which of them hold the page. A range that
    lies in the page whole is taken as it is, the one or two at its ends are cut again, those of one value by the next key. Counts and
    bounds are all that is collected, and only the key is read for them.
    """
    if skip == 0 and take >= size:
        return [rows]
    if size <= TOP_K_ROWS or not keys:
        return [rows.orderBy(*keys).offset(skip).limit(take) if keys else rows.offset(skip).limit(take)]
    key = keys[0]
    kind = rows.schema[key].dataType
    bounds = [F.lit(v).cast(kind) for v in _bounds(rows, key, size)]
    value = F.col(key)
    listed = F.array(*bounds).cast(f"array<{kind.simpleString()}>")
    place = F.when(value.isNull(), -1).otherwise(2 * F.size(F.filter(listed, lambda b: b < value)) + F.array_contains(listed, value).cast("int"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(place.alias("_at")).agg(F.count(F.lit(1))).collect())
    parts, before = [], 0
    for at, n in counts:
        first, last = max(skip - before, 0), min(skip + take - before, n)
        if last > first:
            one = at < 0 or at % 2 == 1
            low, high = (at // 2 - 1, at // 2)
            if at < 0:
                part = rows.filter(value.isNull())
            elif one:
                part = rows.filter(value == bounds[at // 2])
            else:
                part = rows.filter(value > bounds[low]) if low >= 0 else rows
                part = part.filter(value < bounds[high]) if high < len(bounds) else part.filter(value.isNotNull())
            parts += _slice(part, keys[1:] if one else keys, first, last - first, n)
        before += n
    return parts


def paginate(df: DataFrame, limit: int = 100, offset: int = 0, order: str = "pos") -> DataFrame:
    """One page of rows in file order, each with the ``total`` row count. NULL comes first; equal values are in the order of the rows' hashes.

    The first pages are a top-k. A page far behind would make that top-k hold everything before it, so there the range of
    ``order`` that holds the page is looked for by counting (``_slice``), and only its rows are sorted; the table is neither shuffled nor written.
    """
    placed = df.withColumn("_tie", F.xxhash64(*df.columns))
    if offset + limit <= TOP_K_ROWS:
        total = df.agg(F.count(F.lit(1))).scalar()
        return placed.orderBy(order, "_tie").offset(offset).limit(limit).drop("_tie").withColumn("total", total)
    total = df.count()
    parts = _slice(placed, [order, "_tie"], offset, limit, total) if offset < total else []
    page = parts[0] if parts else placed.limit(0)
    for part in parts[1:]:
        page = page.unionByName(part)
    return page.drop("_tie").withColumn("total", F.lit(total).cast("bigint"))


def by_url(df: DataFrame, url: str, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Rows with this URL; a URL without ``http`` gets the site prefix."""
    full = url if url.startswith("http") else base_url + url
    return df.filter(F.col("device_url") == full)


def match_urls(df: DataFrame, urls: DataFrame, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """``by_url`` for a table of URLs ``(device_url)``."""
    given = F.col("device_url")
    wanted = urls.select(
        F.when(given.startswith("http"), given).otherwise(F.concat(F.lit(base_url), given)).alias("device_url"))
    return df.join(wanted.distinct(), "device_url", "left_semi")


def match_exact(cat: DataFrame, names: DataFrame) -> DataFrame:
    """Rows that equal one of the ``(brand, device)`` names, case ignored."""
    wanted = names.select(F.lower("brand").alias("_b"), F.lower("device").alias("_d")).distinct()
    same = (F.lower(cat["brand_name"]) == wanted["_b"]) & (F.lower(cat["device_name"]) == wanted["_d"])
    return cat.join(wanted, same, "left_semi")


def select_brands(brands: DataFrame, urls: Sequence[str] | DataFrame) -> DataFrame:
    """Brand rows whose ``url`` was chosen."""
    if isinstance(urls, DataFrame):
        return brands.join(urls.select("url").distinct(), "url", "left_semi")
    return brands.filter(F.col("url").isin(list(urls)))


def delete_brands(cat: DataFrame, spec: DataFrame, brands: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Catalogue and specification rows left when whole brands go.

    A specification row goes when its URL belongs to a removed catalogue row.
    """
    gone = F.coalesce(F.col("brand_name").isin(list(brands)), F.lit(False))
    removed = cat.filter(gone).select("device_url").distinct()
    return cat.filter(~gone), spec.join(removed, "device_url", "left_anti")


def valid_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the named columns (name and URL by default) are filled."""
    keep = F.lit(True)
    for c in columns or ("device_name", "device_url"):
        keep = keep & F.col(c).isNotNull() & (strip(c) != "")
    return df.filter(keep)


def format_device(df: DataFrame) -> DataFrame:
    """Device row with its full name and the alias columns of the answers."""
    return df.withColumns({
        "name": full_name("brand_name", "device_name"),
        "url": F.col("device_url"),
        "image_url": F.col("device_image"),
    })


# ---- order and set rules ---------------------------------------------------

def sort_brands(df: DataFrame, name: str = "name") -> DataFrame:
    """Brands by name, in code-point order."""
    return df.orderBy(name)


def head(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return df.orderBy(order).limit(n)


def tail_rows(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The last ``n`` rows, still in file order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def concat_distinct(first: DataFrame, second: DataFrame, order: str = "pos") -> DataFrame:
    """``first`` then ``second`` without repeated rows; ``part`` tells them apart.

    Rows repeat when all columns but the position agree; the earliest stays.
    """
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    same = [c for c in first.columns if c != order]
    # Numbers only, so that rows are combined by hashing.
    own = F.min(F.when(F.col("part") == 0, F.col(order))).alias("_own")
    found = both.groupBy(*same).agg(F.min("part").alias("part"), own, F.min(order).alias("_any"))
    return found.select(F.when(F.col("part") == 0, F.col("_own")).otherwise(F.col("_any")).alias(order), *same, "part")


def except_brands(cat: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Rows of all other brands."""
    return cat.filter(~F.coalesce(F.col("brand_name").isin(list(brands)), F.lit(False)))


def popular_split(cat: DataFrame, brands: Sequence[str] = tuple(POPULAR_BRANDS)) -> DataFrame:
    """Popular brands first, the others behind them, repeated rows dropped."""
    return concat_distinct(cat.filter(F.col("brand_name").isin(list(brands))), except_brands(cat, brands))


def array_union_ordered(*arrays: Column) -> Column:
    """All elements in order of first appearance."""
    return F.array_distinct(F.concat(*arrays))


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def top_per_brand(cat: DataFrame, brands: Sequence[str] = tuple(POPULAR_BRANDS), n: int = 5) -> DataFrame:
    """First device of each named brand, in the order of the names, at most ``n``."""
    place = F.array_position(F.array(*[F.lit(b) for b in brands]), F.col("brand_name"))
    firsts = first_per_key(cat.filter(F.col("brand_name").isin(list(brands))), ["brand_name"], "pos", cat.columns)
    return firsts.withColumn("place", place).orderBy("place").limit(n).withColumn(
        "highlight", F.concat(F.lit("Top "), F.col("brand_name"), F.lit(" device")))


# ---- groups ----------------------------------------------------------------

def brands_with_devices(cat: DataFrame) -> DataFrame:
    """``(brand_name, place, pos, name, url, image)``: each brand's devices in file order, numbered from 0.

    One row per device at any size; nesting them per brand is up to the caller.
    """
    placed = dense_position(cat, ["pos"], ["brand_name"], out="place")
    return placed.select("brand_name", (F.col("place") - 1).alias("place"), "pos", F.col("device_name").alias("name"),
                         F.col("device_url").alias("url"), F.col("device_image").alias("image"))


def brand_counts(cat: DataFrame) -> DataFrame:
    """Devices per brand; nothing is known about the expected number here."""
    return cat.groupBy(F.col("brand_name").alias("name")).agg(
        F.count(F.lit(1)).alias("devices")).withColumn("expected", F.lit(0).cast("bigint"))


def data_presence(cat: DataFrame, specs: DataFrame, brand: str, approximate: bool = False) -> DataFrame:
    """Distinct brands and specification URLs, and whether ``brand`` is there."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    n_urls = specs.agg(distinct("device_url")).scalar()
    return cat.agg(
        distinct("brand_name").alias("brands"),
        F.coalesce(F.bool_or(F.col("brand_name") == brand), F.lit(False)).alias("exists"),
    ).withColumn("device_urls", n_urls)


def expected_total(brands: DataFrame) -> DataFrame:
    """Devices expected over the chosen brands."""
    return brands.agg(F.coalesce(F.sum("device_count"), F.lit(0)).cast("bigint").alias("total_devices"))


def completion(cat: DataFrame, brands: DataFrame) -> DataFrame:
    """Per chosen brand: devices obtained against devices expected."""
    obtained = cat.groupBy("brand_name").agg(F.count(F.lit(1)).alias("devices"))
    return brands.join(obtained, brands["name"] == obtained["brand_name"], "left").select(
        "name", F.coalesce("devices", F.lit(0)).cast("bigint").alias("devices"),
        F.col("device_count").cast("bigint").alias("expected"))


def brand_checks(brands: DataFrame, cat: DataFrame, specs: DataFrame) -> DataFrame:
    """Per chosen brand: is there data, how many specification URLs in all and of its own."""
    with_spec = specs.select("device_url").distinct()
    spec_count = with_spec.agg(F.count(F.lit(1))).scalar()
    per_brand = cat.groupBy("brand_name").agg(F.count(F.lit(1)).alias("_n"))
    own = (cat.select("brand_name", "device_url").distinct().join(with_spec, "device_url", "left_semi")
           .groupBy(F.col("brand_name").alias("_b")).agg(F.count(F.lit(1)).alias("_own")))
    return (
        brands.join(per_brand, brands["name"] == per_brand["brand_name"], "left")
        .join(own, brands["name"] == own["_b"], "left")
        .select("name", F.col("_n").isNotNull().alias("exists"), spec_count.alias("total_specs"),
                F.coalesce("_own", F.lit(0)).cast("bigint").alias("brand_specs"))
    )


def snapshot_status(snapshot: DataFrame, now: Column | str, hours: float = 24) -> DataFrame:
    """One row: brands, newest time, age in words and whether it has expired."""
    from devicelode.functions import age_text, is_expired

    newest = snapshot.agg(F.count(F.lit(1)).alias("brand_count"), F.max("snapshot_ts").alias("last_updated"))
    moment = F.lit(now) if isinstance(now, str) else now
    return newest.withColumns({
        "time_since_update": age_text("last_updated", moment),
        "is_expired": is_expired("last_updated", moment, hours),
    })
