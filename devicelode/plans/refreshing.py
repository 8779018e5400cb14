"""One refresh of the catalogue from stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelode.functions.text import DEFAULT_BASE_URL
from devicelode.operators import extract as E
from devicelode.operators import refresh as R
from devicelode.operators.ordered import first_per_key
from devicelode.session import checkpointed, unsent
from devicelode.sources.keyed import read_keyed, upsert_keyed


def plan_refresh(listing: DataFrame, cat: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed devices to extract, ``reason`` is ``new`` or ``updated``."""
    new = R.new_devices(listing, cat).withColumn("reason", F.lit("new"))
    return new.unionByName(R.untracked_devices(listing, cat, ledger).withColumn("reason", F.lit("updated")))


def refresh(spark: SparkSession, listing: DataFrame, pages: DataFrame, root: str, now: str, galleries: DataFrame | None = None,
            base_url: str = DEFAULT_BASE_URL, asked: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """Bring the tables under ``root`` up to date; the report, which is also kept under ``root/reports``.

    ``listing`` has ``(pos, brand_name, device_name, device_url, device_image)``, ``pages`` the stored specification pages, ``galleries`` the
    stored picture pages. ``catalogue``, ``specs`` and ``ledger`` are tables of ``create_keyed``: each gets one delta of the devices
    processed. A device without a stored page is left for the next time; a brand is processed when it is listed
    and none of its devices was left. ``asked``: the brands asked for, by ``name``, those listed if not told; the full-update time is
    set when all of them were processed. The three commits are made one after the other: a run lost between them, or a
    ``batch`` run again, finds its devices as it left them and does the rest.
    """
    cat, specs, ledger = (read_keyed(spark, f"{root}/{t}") for t in ("catalogue", "specs", "ledger"))
    stored = pages.select(F.col("url").alias("device_url")).distinct()
    listed = first_per_key(listing, ["device_url"], "pos", listing.columns)
    # Kept, since three tables and the report are made from it.
    plan = checkpointed(plan_refresh(listed, cat, ledger).join(unsent(stored.withColumn("_stored", F.lit(True))), "device_url", "left"))
    todo = plan.filter("_stored").drop("_stored")

    # Of pages stored twice the last is read.
    last = pages.groupBy("url").agg(F.max("page_id").alias("page_id")).join(
        unsent(todo.select(F.col("device_url").alias("url"))), "url", "left_semi").select("page_id")
    records = E.assemble_records(pages.join(unsent(last), "page_id", "left_semi"), galleries, base_url).select(*specs.columns)
    entries = todo.select("device_url", F.lit(now).cast("timestamp").alias("last_updated"), F.col("brand_name").alias("brand"))

    top = cat.agg(F.coalesce(F.max("pos"), F.lit(-1))).scalar()
    added = todo.filter(F.col("reason") == "new").withColumn("pos", F.col("pos") + top + 1).select(*cat.columns)

    upsert_keyed(records, f"{root}/specs")
    upsert_keyed(added, f"{root}/catalogue")
    upsert_keyed(entries, f"{root}/ledger")

    brands = listing.select(F.col("brand_name").alias("name")).distinct()
    processed = brands.join(plan.filter("_stored IS NULL").select(F.col("brand_name").alias("name")), "name", "left_anti")
    asked = brands if asked is None else asked.select("name")
    report = R.refresh_report(todo.filter(F.col("reason") == "new"), todo.filter(F.col("reason") == "updated"), asked, processed.join(asked, "name", "left_semi"), now)
    place = f"{root}/reports/run={now if batch is None else batch}".replace(":", "-")
    report.withColumn("run_at", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place).drop("run_at")


def last_full_update(spark: SparkSession, root: str) -> DataFrame:
    """``last_full_update`` of the newest run that processed all brands asked for; NULL if none did."""
    return spark.read.parquet(f"{root}/reports").agg(F.max("last_full_update").alias("last_full_update"))
