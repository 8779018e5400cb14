"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelode.functions import json_quote
from devicelode.sources.keyed import latest_commit, new_version, publish


def append_rows(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add rows to a table; CSV files each carry the header."""
    writer = df.write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def write_brand_snapshot(brands: DataFrame, path: str, ts: str) -> None:
    """Brand rows ``(pos, name, url, device_count)`` -> one snapshot document, whatever the number of brands.

    The document has one brand a line, in the order of ``pos``, between a line that opens it and one that closes it. Its lines are sorted over
    part files that, read one after the other, are the document; ``read_brand_snapshot(parts=True)`` reads them side by side.
    """
    total = brands.agg(F.count(F.lit(1))).scalar()
    place = F.struct("pos", "name", "url")
    last = brands.agg(F.max(place)).scalar()
    entry = F.concat(F.to_json(F.struct("name", "url", F.coalesce("device_count", F.lit(0)).alias("device_count")), {"ignoreNullFields": "false"}),
                     F.when(place == last, F.lit("")).otherwise(F.lit(",")))
    one = brands.sparkSession.range(1)
    head = one.select(F.lit(0).alias("_part"), F.lit(None).cast("bigint").alias("_pos"), F.concat(
        F.lit('{"timestamp":'), json_quote(F.lit(ts)), F.lit(',"brand_count":'), total, F.lit(',"brands":[')).alias("value"))
    foot = one.select(F.lit(2).alias("_part"), F.lit(None).cast("bigint").alias("_pos"), F.lit("]}").alias("value"))
    lines = head.unionByName(brands.select(F.lit(1).alias("_part"), F.col("pos").cast("bigint").alias("_pos"), entry.alias("value"))).unionByName(foot)
    # The last entry has no comma: it must come last among entries of its position too.
    ordered = lines.orderBy("_part", "_pos", F.endswith("value", F.lit(",")).cast("int").desc())
    ordered.select("value").write.mode("overwrite").text(path)


def overwrite_swap(df: DataFrame, path: str, seen: int | None = None) -> int:
    """Write a new version of a table, then publish it as the next commit; the commit's number.

    ``df`` may be derived from the current version: nothing is overwritten. Readers see the old version until the commit
    is made, so a job lost half way leaves the table as it was. Of two writers that started from the same commit
    only one publishes; the other gets ``ConcurrentWrite``. ``seen``: the commit that ``df`` was derived from, the newest now if not told.
    """
    spark = df.sparkSession
    number = latest_commit(spark, path)[0] if seen is None else seen
    version = new_version(number + 1)
    df.write.mode("errorifexists").parquet(f"{path}/versions/{version}")
    return publish(spark, path, number + 1, {"version": version})


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table kept by ``overwrite_swap``."""
    content = latest_commit(spark, path)[1]
    if content is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/versions/{content['version']}")


def preview(df: DataFrame, n: int = 50, order: str = "pos") -> DataFrame:
    """The first ``n`` rows in file order."""
    return df.orderBy(order).limit(n)


def serialise_specs(df: DataFrame) -> DataFrame:
    """Turn the structured columns of records into JSON text, ready for a flat file."""
    structured = [f.name for f in df.schema.fields
                  if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    return df.withColumns({c: F.to_json(c) for c in structured})
