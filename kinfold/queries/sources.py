"""Scans and sinks (S): each sink query writes the table and reads it back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kinfold.operators.profiling import summarise
from kinfold.plans.session import table
from kinfold.queries.base import LINES, frame, query, r, rounded
from kinfold.queries.parsing import NAMED
from kinfold.queries.profiling import FOLDS
from kinfold.sources import documents as docsrc
from kinfold.sources import sinks
from kinfold.sources import tables as tab

@query("s1_banner_csv", "SELECT CAST(p_partkey AS VARCHAR) AS \"Key\", CAST(p_retailprice AS VARCHAR) AS \"Price\", CASE WHEN p_size % 5 = 0 THEN 'café, \"' || p_name || '\"' ELSE p_name END AS \"Note\" FROM {part}")
def s1(spark, sf):
    # one-byte text whose every file starts with a banner line and a header line
    note = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit('café, "'), F.col("p_name"), F.lit('"'))).otherwise(F.col("p_name"))
    field = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", field(F.col("p_partkey").cast("string")), field(F.col("p_retailprice").cast("string")), field(note))
    rows = sinks.shared_folder(spark)
    def with_head(frames):
        yield pd.DataFrame({"line": ["Sample,Outcome per row,", "Key,Price,Note"]})
        yield from frames

    files = table(spark, sf, "part").select(line.alias("line")).repartition(4).mapInPandas(with_head, "line string")
    files.write.mode("overwrite").options(encoding="ISO-8859-1", quote="", sep="\x01", header=False).csv(rows)
    return tab.read_banner_csv(spark, rows)


@query("s2_normalise_header", """SELECT CAST(p_partkey AS VARCHAR) AS "key", p_name AS "name" FROM {part}""")
def s2(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias(" key "), F.col("p_name").alias("name"), F.lit(1).alias("Unnamed_3"),
        F.lit(None).cast("string").alias("empty"), F.col("p_brand").alias("name "))
    return tab.normalise_header(df)


@query("s3_two_level_header", """SELECT p_name AS "Info", p_brand AS "Info_2", CAST(p_size AS VARCHAR) AS "Size" FROM {part}""")
def s3(spark, sf):
    names = tab.flatten_two_level(["Info", "Info", "Dims"], ["Unnamed: 0", None, " Size "])
    return table(spark, sf, "part").select("p_name", "p_brand", F.col("p_size").cast("string")).toDF(*names)


@query("s4_resolve_columns", """SELECT 'k' || CAST(p_partkey AS VARCHAR) AS article, p_brand AS doi, p_name AS geometry, CAST(p_size AS VARCHAR) AS pressure FROM {part}""")
def s4(spark, sf):
    df = table(spark, sf, "part").select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("article "), F.col("p_brand").alias("DOI"),
        F.col("p_name").alias("Geometry of Sample (any)"), F.col("p_size").cast("string").alias("Pressure"))
    wanted = {k: tab.EXPERIMENT_COLUMNS[k] for k in ("article", "doi", "geometry", "pressure")}
    return tab.select_logical(df, wanted)


@query("s7_union_csv", """SELECT CAST(s_acctbal AS VARCHAR) AS bal, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, NULL::VARCHAR AS segment FROM {supplier}
 UNION ALL SELECT CAST(c_acctbal AS VARCHAR), CAST(c_custkey AS VARCHAR), NULL, c_mktsegment FROM {customer}""")
def s7(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    path = sinks.shared_folder(spark)
    sinks.write_union_csv([a, b], path)
    return spark.read.option("header", True).csv(path)


@query("s8_markdown_lines", "SELECT doc_id, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS n_lines, md5(text) AS digest FROM {documents}")
def s8(spark, sf):
    from kinfold.operators.documents import document_lines

    folders = docsrc.write_markdown(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", sinks.shared_folder(spark))
    back = docsrc.read_folders(spark, folders, "doc_id")
    n = document_lines(back, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return back.select("doc_id", F.md5("text").alias("digest")).join(n, "doc_id")


@query("s9_table_sink", f"WITH f AS ({FOLDS}) SELECT method, seed, fold, {r('roc_auc')} AS roc_auc FROM f")
def s9(spark, sf):
    path = sinks.shared_folder(spark)
    sinks.write_table(rounded(frame(spark, sf, FOLDS).select("method", "seed", "fold", "roc_auc")), path)
    return spark.read.parquet(path)


@query("s10_summary_json", f"WITH c AS ({LINES}) SELECT CAST(sum(y) AS BIGINT) AS n_pos, count(*) AS n, NULL::BIGINT AS missing FROM c")
def s10(spark, sf):
    path = sinks.shared_folder(spark)
    one = frame(spark, sf, LINES).agg(F.sum("y").alias("n_pos"), F.count("*").alias("n")).withColumn("missing", F.lit(None).cast("bigint"))
    sinks.write_summary(one, path)
    return spark.read.schema("n_pos bigint, n bigint, missing bigint").json(path)


@query("s11_report_rows", f"""WITH f AS ({FOLDS}) SELECT CAST(method AS VARCHAR) AS method, '| ' || method || ' | ' || printf('%.3f +/- %.3f', avg(roc_auc), stddev_samp(roc_auc)) || ' | '
 || printf('%.3f +/- %.3f', avg(mcc), stddev_samp(mcc)) || ' |' AS line FROM f GROUP BY method""")
def s11(spark, sf):
    s = summarise(frame(spark, sf, FOLDS), ["method"], ["roc_auc", "mcc"]).withColumn("method", F.col("method").cast("string"))
    return sinks.report_rows(s, "method", [sinks.mean_std("roc_auc"), sinks.mean_std("mcc")])


CELL = "printf('%.3f [%.3f, %.3f]', avg({0}), min({0}), max({0}))"


@query("s11_interval_report", f"""WITH f AS ({FOLDS}) SELECT '| ' || method || ' | ' || {CELL.format('roc_auc')} || ' | ' || {CELL.format('mcc')} || ' | n/a |' AS line
 FROM f GROUP BY method""")
def s11b(spark, sf):
    """Mean and range of each method's folds as report lines, written and read back; a metric that nobody has is n/a."""
    folds = frame(spark, sf, FOLDS).withColumn("method", F.col("method").cast("string"))
    long = folds.select("method", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("roc_auc", "mcc")])))
    spans = long.groupBy("method", "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("ci_low"), F.max("v").alias("ci_high"))
    path = sinks.shared_folder(spark)
    sinks.write_report(sinks.interval_report(spans, "method", ["roc_auc", "mcc", "brier"]), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s12_prediction_folders", "SELECT l_orderkey, l_partkey, l_linestatus AS strategy, CAST(l_linenumber AS INT) AS repeat, l_returnflag AS model FROM {lineitem} WHERE l_linestatus = 'O' AND l_linenumber = 2")
def s12(spark, sf):
    path = sinks.shared_folder(spark)
    pred = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linestatus").alias("strategy"),
                                               F.col("l_linenumber").alias("repeat"), F.col("l_returnflag").alias("model"))
    sinks.write_predictions(pred, path)
    return sinks.read_predictions(spark, path, {"strategy": "O", "repeat": 2})
