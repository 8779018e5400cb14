"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Scratch folders made for local sessions that name none.
_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("devicelode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Test tables are small but their rows are costly: do not merge them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="devicelode-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run, under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, its lineage cut; the shuffle files that it took go with the end of the write.

    After ``checkpointed`` they stay until the driver happens to collect its garbage, those of all steps of a query side by side.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """The table for a join that sends neither side to every executor.

    Spark sends tables round that it believes small by the size of their compressed files, and the driver holds each whole; a catalogue may be
    thirty times its files. Tables that grow with the input are marked; those counted or bounded are broadcast by name.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, when their files give fewer partitions than the session has tasks for.

    For small inputs ahead of costly work per row; a large input has partitions
    enough and passes as it is. Spark counts two cores as long as no executor has registered, so the shuffle partitions count too:
    work spread by the cores alone would stay in two tasks, however many executors come.
    """
    session = df.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
