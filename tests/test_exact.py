"""Results that must not hang on the order of adding, and check SQL that states the query's whole rule."""

import html
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold.operators import profiling
from kinfold.queries import profiling as queries
from kinfold.queries.base import plain


def test_rank_correlation_keeps_rows_whose_values_change_when_worked_out_again(spark):
    shaky = F.udf(lambda i: i + random.random() / 4, "double").asNondeterministic()
    df = spark.range(300).select(shaky("id").alias("a"), (-F.col("id")).alias("b"))
    assert profiling.rank_correlation(df, "a", "b").first() == (300, -1.0)


def test_group_means_do_not_hang_on_the_order_of_adding(spark):
    prices = [0.1, 0.2, 0.3, 7.45, 1e6 + 0.01, 33.33, 2e6 + 0.07]
    taxes = [0.01, 0.07, 0.02, 0.06, 0.03, 0.05, 0.04, 0.0, 0.08] * 3
    rng, orders, lines = random.Random(1), [], []
    for g in range(40):
        orders += [(g, v) for v in rng.sample(prices, len(prices))]
        lines += [(4 * g + 1, v) for v in rng.sample(taxes, len(taxes))]
    con = duckdb.connect()
    tables = {"orders": (orders, "o_custkey long, o_totalprice double"), "lineitem": (lines, "l_suppkey long, l_tax double")}
    frames = {}
    for t, (rows, schema) in tables.items():
        frames[t] = spark.createDataFrame(rows, schema).repartition(7)
        names = [c.split()[0] for c in schema.split(", ")]
        con.register(t, pa.table(dict(zip(names, map(list, zip(*rows))))))
    for sql, t, column, want in (
        (queries.PER_GROUP, "orders", "mean_price", sum(round(p * 100) for p in prices) / 700), (queries.SCORED_GROUPS, "lineitem", "v", 0.48)):
        assert {r[column] for r in spark.sql(sql, **{t: frames[t]}).collect()} - {None} == {want}
        assert set(con.execute(f"SELECT DISTINCT {column} FROM ({plain(sql)}) WHERE {column} IS NOT NULL").fetchall()) == {(want,)}


def test_normalize_text_check_decodes_every_reference(spark, tmp_path):
    texts = ["a &amp b&amp", "&ampx; &lt &#169 &#x41;&copy1", "&eacute;t&eacute &nosuch; &", "&&amp;amp; &notit; &notin;", "&#150;&#0;&#1;&#xFFFFFFFFF;", "&#X1f525 x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(entry.oracle_sql()["x6_normalize_text"]).fetchall())
    got = {r.page_id: r.digest for r in entry.queries()["x6_normalize_text"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(got.values())) == len(texts)
    sql = entry.oracle_sql()["x6_normalize_text"].replace("md5(", "(", 1)
    plain_text = dict(con.execute(sql).fetchall())
    for i, t in enumerate(texts):
        if t is not None:
            assert plain_text[i].startswith(" ".join(html.unescape(t).split()))
