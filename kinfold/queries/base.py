"""Registry of the checked queries and the SQL fragments both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinfold.plans.session import TABLES, render

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` with its check SQL (``{table}`` names a table)."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, None if oracle is None else plain(oracle))
        return fn

    return add


def plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return render(spark, sql, sf_dir)


def r(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0)"


def sql_hash(seed, *cols: str) -> str:
    """Check-side twin of ``kinfold.plans.ordered.hash_key``."""
    parts = " || '|' || ".join([f"CAST({seed} AS VARCHAR)", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT)"


# Line items as scored, labelled rows of a cluster (supplier); p has many ties.
LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_linestatus, l_returnflag, l_shipdate,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
       floor(l_extendedprice * (1 - l_discount) / 100) / 1100 AS p,
       l_extendedprice * (1 - l_discount) / 110000 AS q
FROM {lineitem}
"""
# Line items keyed by their unique order, one cluster per customer.
ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
FROM {orders}
"""
# Unit-laden text cells derived from the numbers of a line item.
CELLS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
  CASE CAST(l_partkey % 9 AS INT)
    WHEN 0 THEN CAST(l_quantity AS STRING) || ' MPa' WHEN 1 THEN CAST(l_quantity AS STRING) || ' atm'
    WHEN 2 THEN CAST(l_quantity AS STRING) || ' psia' WHEN 3 THEN CAST(l_quantity AS STRING) || ' psi'
    WHEN 4 THEN CAST(l_quantity AS STRING) || ' kPa' WHEN 5 THEN CAST(l_quantity AS STRING) || ' Pa'
    WHEN 6 THEN 'about ' || CAST(l_quantity AS STRING) WHEN 7 THEN 'n/a'
    ELSE NULL END AS pressure,
  CASE CAST(l_partkey % 7 AS INT)
    WHEN 0 THEN CAST(l_quantity AS STRING) || ' cm/s' WHEN 1 THEN '-' || CAST(l_quantity AS STRING) || ' mm/s'
    WHEN 2 THEN CAST(l_discount AS STRING) || ' m/s' WHEN 3 THEN '−' || CAST(l_quantity AS STRING) || ' mm/s'
    WHEN 4 THEN CAST(l_quantity AS STRING) WHEN 5 THEN 'quiescent' ELSE '0' END AS flow,
  CASE CAST(l_partkey % 8 AS INT)
    WHEN 0 THEN CAST(l_quantity AS STRING) || ' m/s2' WHEN 1 THEN CAST(l_quantity AS STRING) || ' cm/s²'
    WHEN 2 THEN CAST(l_quantity AS STRING) || ' mm/s^2' WHEN 3 THEN 'micro' WHEN 4 THEN 'µg'
    WHEN 5 THEN '1e-6' WHEN 6 THEN CAST(l_tax AS STRING) ELSE 'unknown' END AS gravity,
  CASE CAST(l_partkey % 6 AS INT)
    WHEN 0 THEN CAST(l_quantity AS STRING) || '%' WHEN 1 THEN CAST(l_discount AS STRING)
    WHEN 2 THEN '16-27%' WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ',5 %'
    WHEN 4 THEN 'air' ELSE NULL END AS oxygen,
  CASE CAST(l_partkey % 6 AS INT)
    WHEN 0 THEN CAST(l_quantity AS STRING) || ' W' WHEN 1 THEN '20 kW/m2'
    WHEN 2 THEN CAST(l_quantity AS STRING) || ' A' WHEN 3 THEN CAST(l_quantity AS STRING) || ' amp'
    WHEN 4 THEN CAST(l_quantity AS STRING) || ' w/cm2' ELSE CAST(l_quantity AS STRING) END AS power,
  CASE CAST(l_partkey % 7 AS INT)
    WHEN 0 THEN '0.5mm core; ' || CAST(l_quantity AS STRING) || ' mm outer'
    WHEN 1 THEN '6.4, 9.5, and ' || CAST(l_quantity AS STRING) || ' mm in diameter and 57.2 cm in length'
    WHEN 2 THEN CAST(l_quantity AS STRING) || 'mm × 40mm × 1,5mm'
    WHEN 3 THEN '650 µm' WHEN 4 THEN 'core of ' || CAST(l_quantity AS STRING) || ' um, outer 2 cm'
    WHEN 5 THEN '-' ELSE NULL END AS dims,
  CASE CAST(l_partkey % 8 AS INT)
    WHEN 0 THEN 'Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '0' WHEN 4 THEN 'maybe'
    WHEN 5 THEN 'N/A' WHEN 6 THEN 'TRUE' ELSE NULL END AS flag
FROM {lineitem}
"""
# A raw experiment-like table (18 text columns): one row per line item.
EXPERIMENTS = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
         CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS row_key,
  'Author' || CAST(l_suppkey % 40 AS STRING) || ', A., et al. "Spread study ' ||
    CAST(l_suppkey % 40 AS STRING) || '." Journal (' || CAST(1990 + l_suppkey % 30 AS STRING) || ').' AS article,
  'Author' || CAST(l_suppkey % 40 AS STRING) AS authors,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1
       THEN 'https://doi.org/10.1016/J.X.' || CAST(l_suppkey % 40 AS STRING)
       ELSE 'doi: 10.1016/j.x.' || CAST(l_suppkey % 40 AS STRING) || '.' END AS doi,
  CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'wire' WHEN 1 THEN 'Flat sheet' WHEN 2 THEN 'CYLINDRICAL rod'
       WHEN 3 THEN 'sphere-like spherical' WHEN 4 THEN 'n/a' ELSE 'block' END AS geometry,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN '0.5mm core; ' || CAST(l_linenumber AS STRING) || ' mm outer'
       WHEN 1 THEN CAST(l_linenumber AS STRING) || 'mm x 40mm x 1.5mm' ELSE '650 um' END AS dimensions,
  CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'LDPE on NiCr' WHEN 1 THEN 'black PMMA'
       WHEN 2 THEN 'Cu core; PE outer' WHEN 3 THEN 'cotton tissue' WHEN 4 THEN 'Nomex HT90-40'
       WHEN 5 THEN 'SS inner; HDPE' WHEN 6 THEN 'oak' WHEN 7 THEN '-'
       ELSE 'lot ' || CAST(l_orderkey AS STRING) END AS material,
  CAST(CAST(l_quantity AS INT) % 5 * 4 + 17 AS STRING) || '%' AS o2,
  CASE CAST(l_partkey % 2 AS INT) WHEN 0 THEN '1 atm' ELSE CAST(l_linenumber * 20 AS STRING) || ' kPa' END AS pressure,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN '-' || CAST(l_linenumber * 10 AS STRING) || ' mm/s'
       WHEN 1 THEN CAST(l_linenumber AS STRING) || ' cm/s' WHEN 2 THEN '0' ELSE NULL END AS flow,
  'Rig ' || CAST(l_suppkey % 5 AS STRING) AS rig,
  CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'rectangular' WHEN 1 THEN 'circular duct' ELSE NULL END AS internal_geom,
  CASE CAST(l_suppkey % 2 AS INT) WHEN 0 THEN '20 cm x 100mm' ELSE NULL END AS internal_dims,
  CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN '1e-6' WHEN 1 THEN '0.5' WHEN 2 THEN '9.81 m/s2' ELSE '2' END AS gravity,
  CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'Parabolic flight' WHEN 1 THEN 'drop tower' WHEN 2 THEN 'ISS'
       WHEN 3 THEN 'sounding rocket' ELSE 'drop tower with centrifuge' END AS facility,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'hot wire' WHEN 1 THEN 'pilot flame' WHEN 2 THEN 'radiative heater'
       ELSE 'spark discharge' END AS ig_method,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN CAST(CAST(l_quantity AS INT) % 4 * 30 AS STRING) || ' W'
       WHEN 1 THEN '20 kW/m2' ELSE NULL END AS ig_power,
  CAST(l_linenumber AS STRING) || ' s' AS ig_time,
  CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN 'no ' ELSE
       CASE WHEN l_linestatus = 'O' THEN 'n/a' ELSE 'Y' END END AS ignition
FROM {lineitem}
"""
