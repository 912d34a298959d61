"""Extraction JSON and Markdown corpus scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinfold.operators.documents import LOOSE_ROW
from kinfold.plans.session import shared_path

# Files of a folder, all written by one task, and files that the driver lists at a time.
FOLDER, SCAN = 2_000, 32_000


def parse_extractions(df: DataFrame, text: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Flat rows of JSON texts ``{source: {"conditions"|"rows": [..]}}`` with ``source_chunks``.

    ``conditions`` wins over ``rows``; the position inside the list is ``row_pos``.
    """
    payload = T.StructType([
        T.StructField("conditions", T.ArrayType(LOOSE_ROW)),
        T.StructField("rows", T.ArrayType(LOOSE_ROW)),
    ])
    parsed = df.select(*keep, F.from_json(text, T.MapType(T.StringType(), payload)).alias("m"))
    per_source = parsed.select(*keep, F.explode("m").alias("source_chunks", "p"))
    return per_source.select(
        *keep, "source_chunks", F.posexplode(F.coalesce("p.conditions", "p.rows")).alias("row_pos", "r")
    ).select(*keep, "source_chunks", "row_pos", "r.*")


def read_extractions(spark: SparkSession, paths) -> DataFrame:
    return parse_extractions(spark.read.text(paths, wholetext=True), "value")


def read_markdown(spark: SparkSession, paths) -> DataFrame:
    """(source, text), one row per file."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )


def write_markdown(df: DataFrame, name: str, text: str, path: str) -> list[str]:
    """One file per row, its ``name`` (an integer column) in the front matter; returns the folders.

    A folder or a partition value per file would cost more than the file itself, so files are dealt by a hash of
    their names to folders of about ``FOLDER``, and the task that writes a folder moves it into place as a whole.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(8, tasks, -(-df.count() // FOLDER))
    folder = F.pmod(F.hash(name), F.lit(n)).alias("folder")  # the hash that repartition deals by
    lines = F.concat_ws("", F.lit(f"---\n{name}: "), F.col(name).cast("string"), F.lit("\n---\n"), F.col(text))
    df.repartition(n, name).select(folder, lines.alias("value")).write.mode("overwrite").partitionBy("folder").option(
        "lineSep", "\x00").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return [f"{path}/folder={r.folder}" for r in df.select(folder).distinct().orderBy("folder").collect()]


def read_folders(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """(name, text) of the files of ``write_markdown``, opened once and stored; the driver holds the names of about ``SCAN`` files."""
    out, step = shared_path(spark, "table"), max(1, SCAN // FOLDER)
    head = F.regexp_extract("text", rf"\A---\n{name}: (-?\d+)\n---\n", 0)
    body = F.expr("substring(text, length(head) + 1, length(text) - length(head) - 1)")  # without the separator at the end
    cores = spark.sparkContext.defaultParallelism
    for k in range(0, len(folders), step):
        # few tasks of many files: each file counts as megabytes where Spark cuts an input into tasks
        files = read_markdown(spark, folders[k:k + step]).select("text").coalesce(4 * cores)
        files.withColumn("head", head).select(
            F.regexp_extract("head", r"(-?\d+)\n", 1).cast("bigint").alias(name), body.alias("text")).write.mode("append").parquet(out)
    return spark.read.schema(f"{name} bigint, text string").parquet(out)
