"""Session, table and checkpoint helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: int = 8, app: str = "kinfold", memory: str = "12g") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def render(spark: SparkSession, sql: str, sf_dir: str, **frames: DataFrame) -> DataFrame:
    """Run ``sql`` where ``{lineitem}`` etc. stand for the parquet tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used, **frames)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, deleted when the application ends.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, because executors can be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = _local_folder()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder (a checkpoint would work it out twice)."""
    return written(df)[0]


def written(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder (a folder per value of ``by``), and its path for ``free``."""
    path = shared_path(df.sparkSession, "table")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free(spark: SparkSession, path: str) -> None:
    """Delete a written table whose last reader is done."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end; else those stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for an expensive projection over an input with few splits.

    A no-op when the input already has at least one split per core, which is
    always so for large tables.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt by hash to one task per core, or per ``rows`` rows if those are more tasks.

    For stored tables that pack well and are costly per row: their splits are few or hold no row
    group, so a task's work and memory would grow with the table.  Deal the table before the
    projection, since it is narrower, by ``keys`` that no large group of rows shares.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)
