"""Readers. Each returns a lazy DataFrame with a fixed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelode import schemas

RAW_MAP = "map<string,string>"
RECORD = T.StructField("_record", T.StringType())


def _fields(record: Column) -> Column:
    """How many fields a record has that Spark kept as it is because it does not fit the layout; NULL for one that fits."""
    return F.length(F.regexp_replace(F.regexp_replace(record, r'"[^"]*+"', ""), "[^,]", "")) + 1


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV with a header -> ``(pos, brand_name, device_name, device_url, device_image)``.

    Rows of less than three fields are left out; blank fields and a missing image become ``''``.
    ``pos`` numbers the rows from 0 in file order: a row number inside each
    file split plus the rows of the splits before it, so no task ever sees more
    than one split. Meant for ingest; keep the result as Parquet.
    """
    raw = (
        spark.read.schema(T.StructType([*schemas.CATALOGUE, RECORD]))
        # Only a reader of all columns tells a short row from one with blank fields.
        .option("columnNameOfCorruptRecord", "_record").option("columnPruning", False)
        .option("header", True).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
        )
        .filter(F.col("device_url").isNotNull() | F.coalesce(_fields(F.col("_record")) >= 3, F.lit(True)))
    )
    split = ["_file", "_start"]
    sizes = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per file split is left here, so a single ordered pass is fine.
    earlier = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*split, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*split).orderBy("_row")
    return (
        raw.join(offsets, split)
        .select(
            (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint").alias("pos"),
            *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in schemas.CATALOGUE.names],
        )
    )


def _decoded_once(c: Column) -> Column:
    """JSON text that may have been encoded twice, with the outer encoding taken off."""
    return F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specification CSV in the 4- or the 14-column layout -> the 14 columns.

    The narrow layout keeps a whole record as JSON in its fourth column; its
    inner document and its promoted fields are taken out. Rows of less than four
    fields are left out, blank URLs and documents are ``''``. Fields hold line
    breaks, so a file is read by one task: keep files of moderate size.
    """
    raw = (
        spark.read.schema(T.StructType([*schemas.SPECS_WIDE, RECORD]))
        .option("columnNameOfCorruptRecord", "_record").option("columnPruning", False)
        .option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
        .filter(F.col("specifications").isNotNull() | F.coalesce(_fields(F.col("_record")) >= 4, F.lit(True)))
    )
    record = F.coalesce("specifications", F.lit(""))
    inner = F.get_json_object(record, "$.specifications")

    def promoted(name: str) -> Column:
        own = F.when(inner.isNotNull(), F.get_json_object(record, f"$.{name}"))
        return F.coalesce(F.col(name), own)

    return raw.select(
        F.coalesce("device_url", F.lit("")).alias("device_url"), "name",
        F.coalesce("pictures", F.lit("[]")).alias("pictures"),
        F.coalesce(inner, record).alias("specifications"),
        *[promoted(c).alias(c) for c in schemas.SPECS_WIDE.names[4:-1]],
        _decoded_once(promoted("price_info")).alias("price_info"),
    )


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One row per JSON document: one a line, or one a file."""
    return spark.read.text(path, wholetext=not lines).filter(F.length(F.trim("value")) > 0)


def read_brand_snapshot(spark: SparkSession, path: str, lines: bool = False, parts: bool = False) -> DataFrame:
    """Brand snapshot documents -> one row per brand with the snapshot's time and count.

    With ``lines`` each line is a document; with ``parts`` the folder is one document of ``write_brand_snapshot``, read line by line.
    """
    if parts:
        text = spark.read.text(path)
        opening = text.filter(F.startswith("value", F.lit('{"timestamp"')))
        head = opening.agg(F.first(F.from_json(F.concat("value", F.lit("]}")), schemas.BRAND_SNAPSHOT))).scalar()
        rows = text.filter(F.startswith("value", F.lit('{"name"'))).select(F.from_json(F.rtrim("value", F.lit(",")), schemas.BRAND).alias("b"))
        told = rows.withColumn("d", head)
        return told.select(F.col("d.timestamp").try_cast("timestamp").alias("snapshot_ts"), F.col("d.brand_count").alias("brand_count"), "b.*")
    doc = _documents(spark, path, lines).select(F.from_json("value", schemas.BRAND_SNAPSHOT).alias("d"))
    return doc.select(
        F.col("d.timestamp").try_cast("timestamp").alias("snapshot_ts"),
        F.col("d.brand_count").alias("brand_count"),
        F.inline("d.brands"),
    )


def read_ledger(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Update ledger -> ``(device_url, last_updated, brand, model)``.

    Understands a map keyed by URL, and a plain list of devices. List entries
    carry no URL, only brand and model, and take the document's own date.
    """
    doc = _documents(spark, path, lines).select(
        F.get_json_object("value", "$.devices").alias("devices"),
        F.coalesce(F.get_json_object("value", "$.last_update"),
                   F.get_json_object("value", "$.last_full_update")).alias("doc_date"),
    )
    keyed = F.from_json("devices", f"map<string,{schemas.LEDGER_ENTRY}>")
    listed = F.from_json("devices", "array<struct<brand: string, model: string>>")
    shape = "array<struct<device_url: string, last_updated: string, brand: string, model: string>>"
    rows = F.concat(
        F.coalesce(F.transform(F.map_entries(keyed), lambda e: F.struct(
            e["key"].alias("device_url"), e["value"]["last_updated"].alias("last_updated"),
            e["value"]["brand"].alias("brand"), F.lit(None).cast("string").alias("model"))).cast(shape),
            F.array().cast(shape)),
        F.coalesce(F.transform(F.when(F.col("devices").startswith("["), listed), lambda d: F.struct(
            F.lit(None).cast("string").alias("device_url"), F.col("doc_date").alias("last_updated"),
            d["brand"].alias("brand"), d["model"].alias("model"))).cast(shape),
            F.array().cast(shape)),
    )
    return doc.select(F.inline(rows)).withColumn("last_updated", F.col("last_updated").try_cast("timestamp"))


def read_access_keys(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Access-key documents -> one row per key."""
    keys = _documents(spark, path, lines).select(
        F.explode(F.from_json(F.get_json_object("value", "$.keys"), f"map<string,{schemas.ACCESS_KEY}>"))
        .alias("access_key", "k"))
    return keys.select(
        "access_key", "k.name", "k.email", "k.tier",
        F.col("k.created_at").try_cast("timestamp").alias("created_at"),
        F.col("k.last_used").try_cast("timestamp").alias("last_used"),
        F.coalesce("k.usage_count", F.lit(0).cast("bigint")).alias("usage_count"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored raw pages ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")
