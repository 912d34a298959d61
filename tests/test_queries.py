"""Contract of the entry module, and a fast subset of the checked queries."""

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans.session import TABLES
from kinfold.queries import modelling
from tools.check_queries import rows_of

FAST = (
    "p4_pressure_kpa", "p10_lengths_mm", "n9_group_rare", "n14_resolve_aliases", "n25_clean_experiments",
    "a1_group_stats", "a6_stability", "w2_pareto", "r3_combined_weights", "k3_group_kfold",
    "k4_stratified_group_kfold", "e4_classification_battery", "e6_scored_groups", "e8_optimal_thresholds",
    "t2_pairwise_tests", "x8_render_excerpts", "j9_match_regions", "au1_leave_out_quantiles",
)


def test_every_check_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert not any("{" + t + "}" in sql for sql in o.values() for t in TABLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "roc_auc" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_query_matches_check(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name, operator", [
    ("e16_protocol_ladder", "protocol_ladder"), ("e17_leave_one_group_out", "leave_one_group_out_table")])
def test_one_group_of_a_protocol_is_one_source(spark, sf_dir, name, operator, monkeypatch):
    class Seen(Exception):
        pass

    def see(df, *args):
        raise Seen({r.group_id for r in df.select("group_id").distinct().collect()})

    monkeypatch.setattr(modelling.bench, operator, see)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, sf_dir)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.source for r in docs.join(labels, "doc_id").select("source").distinct().collect()}
    assert seen.value.args[0] == want and len(want) > 5
