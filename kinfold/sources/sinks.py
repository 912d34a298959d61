"""Result sinks: tables, summaries, reports, per-repeat predictions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.operators.combining import stack_results


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder (temporary if local)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_union_csv(frames: Sequence[DataFrame], path: str) -> DataFrame:
    """All rows under the sorted union of the columns; an error if there are none."""
    both = stack_results(frames)
    out = both.select(*sorted(both.columns))
    if out.isEmpty():
        raise ValueError("no rows to write")
    write_table(out, path, "csv")
    return out


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON text per row of a (one-row) summary; NULL fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_summary(df: DataFrame, path: str) -> None:
    summary_json(df).write.mode("overwrite").text(path)


def mean_std(m: str) -> Column:
    return F.format_string("%.3f +/- %.3f", F.col(f"{m}_mean"), F.col(f"{m}_std"))


def mean_interval_text(m: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", m, lo, hi)


def report_rows(df: DataFrame, name: str, cells: Sequence[Column]) -> DataFrame:
    """One Markdown table line per row."""
    bars = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name), *cells), F.lit(" |"))
    return df.select(name, bars.alias("line"))


def interval_report(
    df: DataFrame, name: str, metrics: Sequence[str], metric: str = "metric"
) -> DataFrame:
    """``mean [lo, hi]`` per metric from a long interval table, one line per name."""
    text = mean_interval_text(F.col("mean"), F.col("ci_low"), F.col("ci_high"))
    wide = df.withColumn("t", text).groupBy(name).pivot(metric, list(metrics)).agg(F.first("t"))
    return report_rows(wide, name, [F.coalesce(F.col(m), F.lit("n/a")) for m in metrics])


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_predictions(
    df: DataFrame, path: str, by: Sequence[str] = ("strategy", "repeat", "model")
) -> None:
    """One folder per (strategy, repeat, model), so a reader can prune."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_predictions(spark: SparkSession, path: str, only: Mapping[str, object] = {}) -> DataFrame:  # noqa: B006
    out = spark.read.parquet(path)
    for k, v in only.items():
        out = out.where(F.col(k) == v)
    return out
