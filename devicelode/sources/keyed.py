"""Tables that change a little at a time: numbered commits, and rows replaced by key without rewriting the rest.

A commit is one small file, made only if no other writer has made the same number; it names the files that are the table from
then on. Data files are never changed, so readers keep the commit they began with, and a job lost half way leaves only files
that no commit names. The create-if-absent step is one call of Hadoop's file system, atomic on HDFS and on stores with conditional writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelode.session import unsent


class ConcurrentWrite(RuntimeError):
    """Another writer has published since this one looked; read again and repeat."""


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def latest_commit(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """(newest number, content of the newest whole commit); (0, None) before the first. A commit cut off while it was written is passed over."""
    names = [n for n in _names(spark, f"{path}/commits") if n.endswith(".json") and not n.startswith(".")]
    for name in reversed(names):
        text = spark.read.text(f"{path}/commits/{name}", wholetext=True).first()
        try:
            return int(names[-1][:-5]), json.loads(text[0])
        except (TypeError, ValueError):
            continue
    return (int(names[-1][:-5]) if names else 0), None


def publish(spark: SparkSession, path: str, number: int, content: dict) -> int:
    """Make commit ``number``, unless another writer was first (``ConcurrentWrite``)."""
    fs, where = _files(spark, f"{path}/commits/{number:020d}.json")
    try:
        out = fs.create(where, False)
    except Exception as error:
        if fs.exists(where):
            raise ConcurrentWrite(f"commit {number} of {path} is there already") from error
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return number


def new_version(number: int) -> str:
    """A folder name that no other writer uses."""
    return f"{number:020d}-{uuid.uuid4().hex}"


def batch_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a stream has written under ``path``."""
    return sorted(int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("batch_id="))


# ---- rows replaced by key -----------------------------------------------------------

def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, version: str, key: str, buckets: int) -> list[int]:
    """Rows by bucket of their key into a folder of their own; the buckets that got any. Rebalancing splits large buckets over tasks."""
    rows = df.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", "_bucket")
    rows.write.partitionBy("_bucket").mode("errorifexists").parquet(f"{path}/data/{version}")
    return [int(n.split("=")[1]) for n in _names(df.sparkSession, f"{path}/data/{version}") if n.startswith("_bucket=")]


def _read(spark: SparkSession, path: str, schema: T.StructType, parts: list[tuple[str, int]]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{v}/_bucket={b}" for v, b in parts])


def _merged(spark: SparkSession, path: str, content: dict, buckets: set[int] | None = None) -> DataFrame:
    """The rows of the base whose key no delta has, and of each key in the deltas the rows of the newest."""
    schema, key = T.StructType.fromJson(content["schema"]), content["key"]
    wanted = lambda b: buckets is None or b in buckets
    base = _read(spark, path, schema, [(v, int(b)) for b, v in content["base"].items() if wanted(int(b))])
    deltas = [_read(spark, path, schema, [(d["version"], b) for b in d["buckets"] if wanted(b)]).withColumn("_at", F.lit(i)) for i, d in enumerate(content["deltas"])]
    if not deltas:
        return base
    changes = deltas[0]
    for d in deltas[1:]:
        changes = changes.unionByName(d)
    newest = changes.groupBy(F.col(key).alias("_key")).agg(F.max("_at").alias("_newest"))
    last = changes.join(unsent(newest), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_newest")), "left_semi").drop("_at")
    return base.join(unsent(newest), base[key].eqNullSafe(newest["_key"]), "left_anti").unionByName(last)


def create_keyed(df: DataFrame, path: str, key: str = "device_url", buckets: int = 64) -> int:
    """Start a table whose rows are replaced by ``key``; choose ``buckets`` so that one of them is worth rewriting at once."""
    spark = df.sparkSession
    number, content = latest_commit(spark, path)
    if content is not None:
        raise ConcurrentWrite(f"{path} is a table already")
    version = new_version(number + 1)
    there = _write(df, path, version, key, buckets)
    return publish(spark, path, number + 1, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "base": {str(b): version for b in there}, "deltas": []})


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest commit: base and deltas merged by key."""
    content = latest_commit(spark, path)[1]
    if content is None:
        raise FileNotFoundError(f"no table at {path}")
    return _merged(spark, path, content)


def upsert_keyed(updates: DataFrame, path: str, order: str | None = None, seen: int | None = None, most_deltas: int = 8) -> int:
    """Replace the rows of the keys in ``updates`` and add unknown ones: one delta of just these rows.

    With ``order`` a key that is updated more than once takes its last row. ``seen``: the commit that ``updates`` were derived from, if it
    must still be the newest. After ``most_deltas`` deltas, the buckets that they touch, and no others, are written anew.
    """
    spark = updates.sparkSession
    number, content = latest_commit(spark, path)
    if content is None:
        raise FileNotFoundError(f"no table at {path}")
    if seen is not None and seen != number:
        raise ConcurrentWrite(f"{path} is at commit {number}, not {seen}")
    schema, key = T.StructType.fromJson(content["schema"]), content["key"]
    rows = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *([] if order is None or order in schema.names else [order]))
    if order is not None:
        rest = [c for c in schema.names if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in schema.names])
    version = new_version(number + 1)
    delta = {"version": version, "buckets": _write(rows, path, version, key, content["buckets"])}
    content = content | {"deltas": [*content["deltas"], delta] if delta["buckets"] else content["deltas"]}
    done = publish(spark, path, number + 1, content)
    return compact(spark, path, done) if len(content["deltas"]) > most_deltas else done


def compact(spark: SparkSession, path: str, seen: int | None = None) -> int:
    """Write the buckets that deltas touch anew, without them; all other buckets stay the files they are."""
    number, content = latest_commit(spark, path)
    if content is None or seen is not None and seen != number:
        raise ConcurrentWrite(f"{path} is at commit {number}, not {seen}")
    touched = {b for d in content["deltas"] for b in d["buckets"]}
    if not touched:
        return number
    version = new_version(number + 1)
    there = _write(_merged(spark, path, content, touched), path, version, content["key"], content["buckets"])
    base = {b: v for b, v in content["base"].items() if int(b) not in touched} | {str(b): version for b in there}
    return publish(spark, path, number + 1, content | {"base": base, "deltas": []})
