"""From a stored brand index to catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.functions.text import DEFAULT_BASE_URL
from devicelode.operators import extract as E
from devicelode.operators.ordered import first_per_key
from devicelode.operators.refresh import append_new_only


def harvest(pages: DataFrame, index_url: str, base_url: str = DEFAULT_BASE_URL, on_cycle: str = "stop") -> DataFrame:
    """``(brand_name, step, place, device_name, device_url, device_image)``: the devices of every brand of an index page.

    ``pages`` holds the index, the listing pages it leads to, and whatever else is stored. Each brand's chain of listing pages is followed
    to its end (``page_chain``); ``step`` is the page of the chain, ``place`` the item on the page. A brand whose page
    isn't stored has no rows; of pages stored twice the one of the highest ``page_id`` counts.
    """
    brands = E.extract_brands(pages.filter(F.col("url") == index_url), base_url)
    # Two entries for one page are one brand, the first.
    owners = first_per_key(brands, ["url"], "pos", ["url", "name"])
    chains = E.page_chain(pages, owners.select("url"), base_url, on_cycle)
    wanted = chains.join(owners.withColumnRenamed("url", "start_url"), "start_url").select("url", "step", F.col("name").alias("brand_name"))
    latest = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    read = latest.join(wanted.select("url").distinct(), "url", "left_semi")
    items = E.extract_listing(pages.join(read.select("page_id"), "page_id", "left_semi"), base_url).withColumnRenamed("url", "device_url")
    return items.join(read, "page_id").join(wanted, "url").select(
        "brand_name", "step", F.col("pos").alias("place"), F.col("name").alias("device_name"), "device_url", F.col("image_url").alias("device_image"))


def harvest_new(pages: DataFrame, index_url: str, cat: DataFrame, base_url: str = DEFAULT_BASE_URL, on_cycle: str = "stop") -> DataFrame:
    """Catalogue rows to append: the harvested devices whose URL ``cat`` doesn't have, each once, where it stands first."""
    found = harvest(pages, index_url, base_url, on_cycle)
    placed = found.withColumn("_first", F.col("step") * (1 << 32) + F.col("place"))
    return append_new_only(cat, placed, "_first").drop("_first", "step", "place")
