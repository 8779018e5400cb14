"""Keeping the catalogue and its specifications up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.operators.ordered import first_per_key, one_per_key
from devicelode.session import unsent


def unify(cat: DataFrame, specs: DataFrame, dedupe: bool = False, order: str | None = None) -> DataFrame:
    """Catalogue with its specification rows; devices without any are kept.

    A device with several specification rows comes out several times, unless
    ``dedupe`` keeps the first by ``order``. Matched and unmatched devices are
    joined apart: an inner join can be split on a hot URL of either side, a
    left join could only be split on the left.
    """
    if dedupe:
        specs = first_per_key(specs, ["device_url"], order or "name", specs.columns)
    known = specs.select("device_url").distinct()
    extra = [c for c in specs.columns if c != "device_url"]
    matched = cat.join(specs, "device_url").select(*cat.columns, *extra)
    types = {f.name: f.dataType for f in specs.schema.fields}
    bare = cat.join(known, "device_url", "left_anti").select(
        *cat.columns, *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    return matched.unionByName(bare)


def new_devices(listing: DataFrame, cat: DataFrame) -> DataFrame:
    """Listed devices that the catalogue does not have."""
    return listing.join(unsent(cat.select("device_url").distinct()), "device_url", "left_anti")


def untracked_devices(listing: DataFrame, cat: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed devices that the catalogue has and the ledger has not."""
    return (listing.join(unsent(cat.select("device_url").distinct()), "device_url", "left_semi")
            .join(unsent(ledger.select("device_url").distinct()), "device_url", "left_anti"))


def upsert(target: DataFrame, updates: DataFrame, key: str = "device_url", order: str | None = None) -> DataFrame:
    """Replace the rows of updated keys, append unknown keys.

    With ``order`` a key that is updated more than once takes its last row.
    """
    cols = target.columns
    if order:
        latest = one_per_key(updates, [key], order, cols, last=True)
    else:
        latest = updates.select(*cols)
    kept = target.join(updates.select(key).distinct(), key, "left_anti")
    return kept.select(*cols).unionByName(latest)


def append_new_only(target: DataFrame, rows: DataFrame, order: str, key: str = "device_url") -> DataFrame:
    """Rows to append: the first of each key, unless the target has the key."""
    firsts = first_per_key(rows, [key], order, rows.columns)
    return firsts.join(target.select(key).distinct(), key, "left_anti").select(*rows.columns)


def refresh_report(new: DataFrame, updated: DataFrame, brands: DataFrame, processed: DataFrame, now: str) -> DataFrame:
    """Counts of one refresh; the full-update time is set only when all brands were processed.

    ``brands`` holds the brands asked for and ``processed`` those done, both by ``name``.
    """
    total = brands.agg(F.count_distinct("name")).scalar()
    done = processed.agg(F.count_distinct("name")).scalar()
    changes = new.select(F.lit(True).alias("is_new")).unionByName(updated.select(F.lit(False).alias("is_new")))
    return (
        changes.agg(F.count_if("is_new").alias("new_devices"), F.count_if(~F.col("is_new")).alias("updated_devices"))
        .withColumns({"brands_processed": done, "total_brands": total})
        .withColumn("last_full_update", F.when(F.col("brands_processed") == F.col("total_brands"),
                                               F.lit(now).cast("timestamp")))
    )
