"""Text parsers (P), categories and identity (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import categories as cat
from kinfold.functions import identity as ident
from kinfold.functions import numeric as num
from kinfold.functions import text as txt
from kinfold.operators import identity as ids
from kinfold.operators import roles
from kinfold.plans import clean
from kinfold.plans.session import table
from kinfold.plans.texts import read_once
from kinfold.queries.base import CELLS, EXPERIMENTS, LINES, frame, query, r, rounded

NUM = num.NUMBER


def sql_number(e: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(translate({e}, ',−', '.-'), '{NUM}'), '') AS DOUBLE)"


def sql_clean(e: str) -> str:
    s = f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN lower({s}) IN ('', '-', 'n/a', 'na', 'nan', 'none') THEN NULL ELSE {s} END)"


def sql_pressure(e: str) -> str:
    v, s = sql_number(e), f"lower({e})"
    return (
        f"CASE WHEN {s} LIKE '%mpa%' THEN {v} * 1000.0 WHEN {s} LIKE '%atm%' THEN {v} * 101.325::DOUBLE "
        f"WHEN {s} LIKE '%psia%' OR regexp_matches({s}, '\\bpsi\\b') THEN {v} * 6.894757::DOUBLE "
        f"WHEN {s} LIKE '%kpa%' THEN {v} WHEN {s} LIKE '%pa%' THEN {v} / 1000.0 ELSE {v} END"
    )


def sql_flow(e: str) -> str:
    v, s = sql_number(e), f"lower({e})"
    return (
        f"CASE WHEN {s} LIKE '%cm/s%' THEN {v} * 10 "
        f"WHEN {s} LIKE '%m/s%' AND {s} NOT LIKE '%mm/s%' THEN {v} * 1000 ELSE {v} END"
    )


def sql_gravity(e: str) -> str:
    v, s = sql_number(e), f"replace(lower({e}), '²', '2')"
    has = lambda u: f"({s} LIKE '%{u}/s2%' OR {s} LIKE '%{u}/s^2%')"
    return (
        f"CASE WHEN {v} IS NULL THEN CASE WHEN {s} LIKE '%micro%' OR {s} LIKE '%µg%' "
        f"OR {s} LIKE '%μg%' THEN 1e-6 END WHEN {has('cm')} THEN {v} / 981.0 "
        f"WHEN {has('mm')} THEN {v} / 9810.0 WHEN {has('m')} THEN {v} / 9.81::DOUBLE ELSE {v} END"
    )


def sql_watts(e: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({e}), 'w/cm|kw/m|\\ba\\b|amp|current') THEN NULL "
        f"ELSE {sql_number(e)} END"
    )


def sql_unit(u: str) -> str:
    return (
        f"(CASE WHEN lower({u}) IN ('µm', 'μm', 'um') THEN 0.001::DOUBLE WHEN lower({u}) = 'cm' "
        f"THEN 10.0::DOUBLE WHEN lower({u}) = 'm' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END)"
    )


def sql_lengths(e: str) -> str:
    s = f"replace(replace(replace({e}, ',', '.'), '×', 'x'), 'Ø', 'diameter ')"
    tok = f"'(?i)({NUM})\\s*(µm|μm|um|mm|cm|m)?'"
    return (
        f"COALESCE(list_transform(list_zip(regexp_extract_all({s}, {tok}, 1), "
        f"regexp_extract_all({s}, {tok}, 2)), lambda z: CAST(z[1] AS DOUBLE) * {sql_unit('z[2]')}), "
        f"CAST([] AS DOUBLE[]))"
    )


def sql_near(e: str, words: str) -> str:
    s = f"lower(replace(replace({e}, ',', '.'), '×', 'x'))"
    n, u = r"[-+]?\d*\.?\d+", "µm|μm|um|mm|cm|m"
    before = f"'({n})\\s*({u})?\\s*(?:diameter\\s*)?(?:{words})'"
    after = f"'(?:{words})\\D{{0,20}}({n})\\s*({u})?'"
    pick = lambda p: (
        f"TRY_CAST(NULLIF(regexp_extract({s}, {p}, 1), '') AS DOUBLE) * "
        f"{sql_unit(f'regexp_extract({s}, {p}, 2)')}"
    )
    return f"COALESCE({pick(before)}, {pick(after)})"


def sql_yes_no(e: str) -> str:
    s = f"lower({sql_clean(e)})"
    return (
        f"CASE WHEN {s} IN ('yes', 'y', '1', 'true') THEN 1 "
        f"WHEN {s} IN ('no', 'n', '0', 'false') THEN 0 END"
    )


def like(s: str, *words: str) -> str:
    return "(" + " OR ".join(f"{s} LIKE '%{w}%'" for w in words) + ")"


def cells(spark, sf, col, fn, out, places=9):
    df = frame(spark, sf, CELLS)
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", col, fn(F.col(col)).alias(out)), places)


def cells_sql(col, expr, out, places=9):
    return (
        f"WITH c AS ({CELLS}) SELECT l_orderkey, l_linenumber, l_partkey, {col}, "
        f"{r(expr, places)} AS {out} FROM c"
    )


MESSY = """
SELECT doc_id, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '  ' || source || '   ' || lang || ' '
  WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN ' none ' WHEN 4 THEN '' WHEN 5 THEN NULL
  ELSE text END AS cell FROM {documents}
"""


@query("p1_clean_cell", f"WITH c AS ({MESSY}) SELECT doc_id, {sql_clean('cell')} AS cleaned FROM c")
def p1(spark, sf):
    return frame(spark, sf, MESSY).select("doc_id", txt.clean_cell(F.col("cell")).alias("cleaned"))


@query("p2_first_number", cells_sql("flow", sql_number("flow"), "number"))
def p2(spark, sf):
    return cells(spark, sf, "flow", num.first_number, "number")


@query("p3_oxygen_fraction", cells_sql(
    "oxygen", f"CASE WHEN {sql_number('oxygen')} > 1 THEN {sql_number('oxygen')} / 100 "
    f"ELSE {sql_number('oxygen')} END", "fraction"))
def p3(spark, sf):
    return cells(spark, sf, "oxygen", num.oxygen_fraction, "fraction")


@query("p4_pressure_kpa", cells_sql("pressure", sql_pressure("pressure"), "kpa"))
def p4(spark, sf):
    return cells(spark, sf, "pressure", num.pressure_kpa, "kpa")


@query("p5_flow_mm_s", cells_sql("flow", sql_flow("flow"), "mm_s"))
def p5(spark, sf):
    return cells(spark, sf, "flow", num.flow_mm_s, "mm_s")


@query("p6_gravity_g", cells_sql("gravity", sql_gravity("gravity"), "g"))
def p6(spark, sf):
    return cells(spark, sf, "gravity", num.gravity_g, "g")


@query("p7_watts", cells_sql("power", sql_watts("power"), "watts"))
def p7(spark, sf):
    return cells(spark, sf, "power", num.watts, "watts")


SECONDS = "SELECT o_orderkey, 'held for ' || CAST(o_orderkey % 97 AS STRING) || '.5 s' AS held FROM {orders}"


@query("p8_seconds", f"WITH c AS ({SECONDS}) SELECT o_orderkey, {r(sql_number('held'))} AS seconds FROM c")
def p8(spark, sf):
    df = frame(spark, sf, SECONDS)
    return rounded(df.select("o_orderkey", num.seconds(F.col("held")).alias("seconds")))


UNITS = """SELECT p_partkey, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'µm' WHEN 1 THEN 'UM'
 WHEN 2 THEN 'mm' WHEN 3 THEN 'Cm' WHEN 4 THEN 'm' WHEN 5 THEN '' ELSE NULL END AS unit FROM {part}"""


@query("p9_mm_per_unit", f"WITH c AS ({UNITS}) SELECT p_partkey, {sql_unit('unit')} AS factor FROM c")
def p9(spark, sf):
    return frame(spark, sf, UNITS).select("p_partkey", num.mm_per_unit(F.col("unit")).alias("factor"))


@query("p10_lengths_mm", f"""WITH c AS ({CELLS}), d AS (SELECT l_orderkey, l_linenumber, l_partkey, dims,
 {sql_lengths('dims')} AS a FROM c) SELECT l_orderkey, l_linenumber, l_partkey, dims, len(a) AS n_lengths,
 array_to_string(list_transform(a, lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ';') AS microns FROM d""")
def p10(spark, sf):
    df = frame(spark, sf, CELLS).withColumn("a", num.lengths_mm(F.col("dims")))
    microns = F.array_join(F.transform("a", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ";")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "dims",
                     F.size("a").cast("bigint").alias("n_lengths"), microns.alias("microns"))


@query("p11_core_outer_mm", f"""WITH c AS ({CELLS}), d AS (SELECT l_orderkey, l_linenumber, l_partkey, dims,
 {sql_near('dims', 'core|inner')} AS core, {sql_near('dims', 'outer|outside')} AS outer_d FROM c)
 SELECT l_orderkey, l_linenumber, l_partkey, dims, {r('core')} AS core, {r('outer_d')} AS outer_mm,
 {r('CASE WHEN outer_d >= core THEN (outer_d - core) / 2 END')} AS thickness FROM d""")
def p11(spark, sf):
    df = frame(spark, sf, CELLS).withColumn("w", num.core_outer_mm(F.col("dims")))
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "dims", F.col("w.core").alias("core"),
                             F.col("w.outer").alias("outer_mm"), F.col("w.thickness").alias("thickness")))


@query("p12_array_features", f"""WITH c AS ({CELLS}), d AS (SELECT l_orderkey, l_linenumber, l_partkey,
 {sql_lengths('dims')} AS a FROM c) SELECT l_orderkey, l_linenumber, l_partkey, {r('a[1]')} AS dim_1_mm,
 {r('a[2]')} AS dim_2_mm, {r('a[3]')} AS dim_3_mm, {r('list_min(a)')} AS dim_min_mm, {r('list_max(a)')} AS dim_max_mm,
 {r('list_avg(a)')} AS dim_mean_mm, CAST(len(a) AS DOUBLE) AS dim_count FROM d""")
def p12(spark, sf):
    df = frame(spark, sf, CELLS).withColumn("a", num.lengths_mm(F.col("dims")))
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", *num.array_features(F.col("a"), "dim")))


@query("p13_derived_numbers", f"""WITH c AS ({CELLS}), d AS (SELECT l_orderkey, l_linenumber, l_partkey,
 {sql_flow('flow')} AS f, {sql_gravity('gravity')} AS g, {sql_watts('power')} AS w FROM c)
 SELECT l_orderkey, l_linenumber, l_partkey, {r('abs(f)')} AS speed,
 {r('CASE WHEN g IS NOT NULL THEN log10(greatest(g, 1e-8)) END')} AS log_g, {r('w * l_linenumber')} AS energy FROM d""")
def p13(spark, sf):
    df = frame(spark, sf, CELLS).select("l_orderkey", "l_linenumber", "l_partkey", "flow", "gravity", "power")
    df = read_once(df, {"flow": num.flow_mm_s, "gravity": num.gravity_g, "power": num.watts})
    return rounded(df.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs("flow").alias("speed"),
        num.floored_log10(F.col("gravity")).alias("log_g"),
        (F.col("power") * F.col("l_linenumber")).alias("energy"),
    ))


@query("p14_yes_no", f"""WITH c AS ({CELLS}) SELECT flag, {sql_yes_no('flag')} AS value, count(*) AS n
 FROM c GROUP BY ALL""")
def p14(spark, sf):
    df = frame(spark, sf, CELLS).select("flag", num.yes_no(F.col("flag")).alias("value"))
    return df.groupBy("flag", "value").agg(F.count("*").alias("n"))


@query("p15_slug", """SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^0-9a-zA-Z]+', '_', 'g'),
 '^_+|_+$', '', 'g')) AS slug FROM {pages}""")
def p15(spark, sf):
    return table(spark, sf, "pages").select("page_id", txt.slug(F.col("url")).alias("slug"))


PROPS = """SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN CAST(value AS STRING)
 WHEN 1 THEN event_type WHEN 2 THEN CAST(user_id AS STRING) || ' s' ELSE CAST(user_id AS STRING) END AS raw FROM {events}"""


@query("p16_to_number", f"WITH c AS ({PROPS}) SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number FROM c")
def p16(spark, sf):
    return frame(spark, sf, PROPS).select("event_id", num.to_number(F.col("raw")).alias("number"))


def category_sql(col: str, cases: str, unknown: bool = True) -> str:
    s = f"lower({sql_clean(col)})" if unknown else f"lower(COALESCE({col}, ''))"
    head = "WHEN s IS NULL THEN 'Unknown' " if unknown else ""
    return (
        f"WITH c AS ({EXPERIMENTS}), d AS (SELECT {col} AS raw, {s} AS s FROM c), "
        f"e AS (SELECT raw, CASE {head}{cases} END AS category FROM d) "
        f"SELECT raw, category, count(*) AS n FROM e GROUP BY ALL"
    )


def category(spark, sf, col, fn):
    df = frame(spark, sf, EXPERIMENTS)
    return df.select(F.col(col).alias("raw"), fn(F.col(col)).alias("category")).groupBy(
        "raw", "category").agg(F.count("*").alias("n"))


GEOMETRY_CASES = """WHEN s LIKE '%wire%' THEN 'Wire' WHEN s LIKE '%flat%' THEN 'Flat'
 WHEN s LIKE '%cyl%' THEN 'Cylindrical' WHEN s LIKE '%spher%' THEN 'Spherical' WHEN s LIKE '%chunk%' THEN 'Chunk' ELSE 'Other'"""
INTERNAL_CASES = f"""WHEN s LIKE '%rect%' THEN 'Rectangular' WHEN {like('s', 'cyl', 'circular', 'annular')}
 THEN 'Cylindrical' ELSE 'Other'"""
FACILITY_CASES = f"""WHEN s LIKE '%parabolic%' THEN 'Parabolic Aircraft'
 WHEN s LIKE '%drop%' THEN CASE WHEN s LIKE '%centrifuge%' THEN 'Drop Tower + Centrifuge' ELSE 'Drop Tower' END
 WHEN {like('s', 'centrifuge', 'hypergravity')} THEN 'Centrifuge' WHEN {like('s', 'iss', 'spacecraft')} THEN 'Spacecraft / ISS'
 WHEN {like('s', 'sounding', 'rocket')} THEN 'Sounding Rocket' WHEN s LIKE '%ground%' THEN 'Ground' ELSE 'Other'"""
METHOD_CASES = f"""WHEN {like('s', 'open flame', 'pilot', 'match')} THEN 'Open Flame'
 WHEN {like('s', 'radiative', 'heater')} THEN 'Radiative Heater' WHEN {like('s', 'discharge', 'high-voltage')} THEN 'Discharge'
 WHEN {like('s', 'wire', 'coil', 'nicr', 'electric')} THEN 'Wire / Coil' ELSE 'Other'"""
MATERIAL_CASES = f"""WHEN {like('s', 'ldpe', 'low-density polyethylene')} THEN 'LDPE'
 WHEN {like('s', 'hdpe', 'high-density polyethylene')} THEN 'HDPE' WHEN s LIKE '%etfe%' THEN 'ETFE'
 WHEN {like('s', 'pmma', 'organic glass')} THEN 'PMMA' WHEN regexp_matches(s, '\\bpe\\b|polyethylene') THEN 'PE'
 WHEN {like('s', 'cellulos', 'kimwipe', 'tissue', 'paper', 'cotton')} THEN 'Cellulosic' WHEN s LIKE '%nomex%' THEN 'Nomex'
 WHEN s LIKE '%kapton%' THEN 'Kapton' WHEN s LIKE '%kevlar%' THEN 'Kevlar' WHEN s LIKE '%polycarbonate%' THEN 'Polycarbonate'
 WHEN s LIKE '%silicone%' THEN 'Silicone' WHEN s LIKE '%peek%' THEN 'PEEK' WHEN s LIKE '%ppsu%' THEN 'PPSU'
 WHEN s LIKE '%conex%' THEN 'Conex' WHEN s LIKE '%sibal%' THEN 'SIBAL' WHEN trim(s) IN ('', 'nan') THEN 'Unknown' ELSE 'Other'"""
CORE_CASES = """WHEN s LIKE '%nicr%' OR s LIKE '%nichrome%' THEN 'NiCr'
 WHEN regexp_matches(s, '\\bcu\\b|copper') THEN 'Copper'
 WHEN s LIKE '%stainless%' OR regexp_matches(s, '\\bss\\b') THEN 'Stainless steel' WHEN s LIKE '%steel%' THEN 'Steel'
 WHEN s LIKE '%iron%' OR regexp_matches(s, '\\bfe\\b') THEN 'Iron' ELSE 'None / NA'"""


@query("n1_geometry", category_sql("geometry", GEOMETRY_CASES))
def n1(spark, sf):
    return category(spark, sf, "geometry", cat.geometry)


@query("n2_internal_geometry", category_sql("internal_geom", INTERNAL_CASES))
def n2(spark, sf):
    return category(spark, sf, "internal_geom", cat.internal_geometry)


@query("n3_facility", category_sql("facility", FACILITY_CASES))
def n3(spark, sf):
    return category(spark, sf, "facility", cat.facility)


@query("n4_ignition_method", category_sql("ig_method", METHOD_CASES))
def n4(spark, sf):
    return category(spark, sf, "ig_method", cat.ignition_method)


@query("n5_material_family", category_sql("material", MATERIAL_CASES, False))
def n5(spark, sf):
    return category(spark, sf, "material", cat.material_family)


@query("n6_core_material", category_sql("material", CORE_CASES, False))
def n6(spark, sf):
    return category(spark, sf, "material", cat.core_material)


@query("n7_flow_direction", f"""WITH c AS ({CELLS}), d AS (SELECT {sql_flow('flow')} AS v FROM c)
 SELECT CASE WHEN v IS NULL THEN 'Unknown' WHEN v > 0 THEN 'Coflow' WHEN v < 0 THEN 'Counterflow'
 ELSE 'Quiescent' END AS direction, count(*) AS n FROM d GROUP BY 1""")
def n7(spark, sf):
    v = num.flow_mm_s(F.col("flow"))
    return frame(spark, sf, CELLS).groupBy(cat.flow_direction(v).alias("direction")).agg(F.count("*").alias("n"))


@query("n8_gravity_regime", f"""WITH c AS ({CELLS}), d AS (SELECT {sql_gravity('gravity')} AS g FROM c)
 SELECT CASE WHEN g IS NULL THEN 'Unknown' WHEN g < 1e-3 THEN 'Microgravity' WHEN g < 0.95 THEN 'Partial'
 WHEN g <= 1.05 THEN 'Earth' ELSE 'Hyper' END AS regime, count(*) AS n FROM d GROUP BY 1""")
def n8(spark, sf):
    g = num.gravity_g(F.col("gravity"))
    return frame(spark, sf, CELLS).groupBy(cat.gravity_regime(g).alias("regime")).agg(F.count("*").alias("n"))


RARE = "SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_brand || '/' || p_type END AS kind FROM {part}"


@query("n9_group_rare", f"""WITH c AS ({RARE}), k AS (SELECT kind, count(*) AS n FROM c GROUP BY kind)
 SELECT p_partkey, CASE WHEN n >= 14 THEN c.kind ELSE 'Other / Rare' END AS kind
 FROM c JOIN k ON c.kind IS NOT DISTINCT FROM k.kind""")
def n9(spark, sf):
    return ids.group_rare(frame(spark, sf, RARE), "kind", 14)


def sql_doi(e: str) -> str:
    s = f"lower({sql_clean(e)})"
    s = f"regexp_replace({s}, '^https?://(dx\\.)?doi\\.org/', '')"
    s = f"regexp_replace({s}, '^doi:\\s*', '')"
    return f"NULLIF(rtrim({s}, '/. '), '')"


def sql_citation(e: str) -> str:
    s = f"regexp_replace(lower({sql_clean(e)}), '[^a-z0-9 ]+', ' ', 'g')"
    return f"NULLIF(trim(regexp_replace({s}, '\\s+', ' ', 'g')), '')"


@query("n10_canonical_doi", f"""WITH c AS ({EXPERIMENTS}) SELECT doi, {sql_doi('doi')} AS canonical,
 count(*) AS n FROM c GROUP BY ALL""")
def n10(spark, sf):
    return frame(spark, sf, EXPERIMENTS).groupBy(
        "doi", ident.canonical_doi(F.col("doi")).alias("canonical")).agg(F.count("*").alias("n"))


@query("n11_canonical_citation", f"""WITH c AS ({EXPERIMENTS}) SELECT article, {sql_citation('article')} AS canonical,
 count(*) AS n FROM c GROUP BY ALL""")
def n11(spark, sf):
    return frame(spark, sf, EXPERIMENTS).groupBy(
        "article", ident.canonical_citation(F.col("article")).alias("canonical")).agg(F.count("*").alias("n"))


SQL_ENTITY = f"COALESCE({sql_doi('doi')}, 'article::' || COALESCE({sql_citation('article')}, 'nan'))"


@query("n12_entity_id", f"WITH c AS ({EXPERIMENTS}) SELECT {SQL_ENTITY} AS entity, count(*) AS n FROM c GROUP BY 1")
def n12(spark, sf):
    e = ident.entity_id(F.col("doi"), F.col("article"))
    return frame(spark, sf, EXPERIMENTS).groupBy(e.alias("entity")).agg(F.count("*").alias("n"))


def sql_label(cit: str, eid: str) -> str:
    c = f"COALESCE({cit}, {eid})"
    first = f"substr(trim(regexp_split_to_array({c}, '[,.]')[1]), 1, 18)"
    year = f"NULLIF(regexp_extract({c}, '\\((\\d{{4}})\\)|\\b(?:19|20)\\d{{2}}\\b'), '')"
    return (
        f"{first} || ' ' || COALESCE(regexp_replace({year}, '[()]', '', 'g'), '????') || ' [' || "
        f"right({eid}, 12) || ']'"
    )


@query("n13_short_label", f"""WITH c AS ({EXPERIMENTS}), d AS (SELECT article, {SQL_ENTITY} AS e FROM c)
 SELECT DISTINCT {sql_label('article', 'e')} AS label FROM d""")
def n13(spark, sf):
    e = ident.entity_id(F.col("doi"), F.col("article"))
    return frame(spark, sf, EXPERIMENTS).select(ident.short_label(F.col("article"), e).alias("label")).distinct()


ALIASES = f"""WITH c AS ({EXPERIMENTS}) SELECT row_key, COALESCE(doi, article) AS old_key, doi, article,
 CASE WHEN row_key LIKE '%7' THEN upper(article) ELSE article END AS shown FROM c"""


@query("n14_resolve_aliases", f"""WITH c AS ({ALIASES}),
 a AS (SELECT COALESCE(doi, shown) AS k, COALESCE({sql_citation('shown')}, 'none') AS art, row_key FROM c),
 d AS (SELECT *, {sql_doi('k')} AS dk FROM a),
 bk AS (SELECT k, arg_min(art, row_key) AS ka FROM d GROUP BY k),
 bd AS (SELECT dk, arg_min(art, row_key) AS da FROM d WHERE dk IS NOT NULL GROUP BY dk),
 m AS (SELECT old_key, COALESCE(da, ka, old_key) AS entity FROM (SELECT old_key, {sql_doi('old_key')} AS od FROM c) x
   LEFT JOIN bd ON x.od = bd.dk LEFT JOIN bk ON x.old_key = bk.k)
 SELECT old_key, entity, count(*) AS n FROM m GROUP BY ALL""")
def n14(spark, sf):
    df = frame(spark, sf, ALIASES)
    out = ids.resolve_aliases(df, "old_key", "doi", "shown", "row_key")
    return out.groupBy("old_key", "entity").agg(F.count("*").alias("n"))


NAMED = """SELECT CAST(l_extendedprice AS STRING) || ' mm/s' AS `FSR (mm/s)`,
  CASE WHEN l_partkey % 2 = 0 THEN 'see flame spread note' ELSE '12' END AS `Flame spread notes`,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'Article ' || CAST(l_suppkey AS STRING) END AS `Article`,
  CAST(l_orderkey AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS `Paper row id`,
  CASE WHEN l_partkey % 11 = 0 THEN 'maybe' WHEN l_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS `Ignition (Yes/No)`,
  'Author ' || CAST(l_suppkey AS STRING) AS `Authors`, l_returnflag AS `Smoke flag`,
  CAST(l_quantity AS STRING) || ' W' AS `Power`, CASE WHEN l_partkey % 2 = 0 THEN 'flat' ELSE '3 wires' END AS `Shape`,
  l_tax AS `Tax`, CAST(NULL AS STRING) AS `Blank` FROM {lineitem}"""
NAMED_SQL = NAMED.replace("`", '"')


@query("n15_target_candidates", f"""WITH c AS ({NAMED_SQL}), k AS (
 SELECT 'FSR (mm/s)' AS col, 0 AS pos, count("FSR (mm/s)") AS nn, count({sql_number('"FSR (mm/s)"')}) AS nu FROM c
 UNION ALL SELECT 'Flame spread notes', 1, count("Flame spread notes"), count({sql_number('"Flame spread notes"')}) FROM c)
 SELECT CAST(row_number() OVER (ORDER BY nu DESC, pos) AS INT) AS rank, col AS "column", nn AS n_non_null, nu AS n_numeric FROM k""")
def n15(spark, sf):
    return roles.target_candidates(frame(spark, sf, NAMED))


@query("n16_binary_targets", f"""WITH c AS ({NAMED_SQL}), k AS (SELECT 'Ignition (Yes/No)' AS col,
 count("Ignition (Yes/No)") AS nn, count({sql_yes_no('"Ignition (Yes/No)"')}) AS ny FROM c)
 SELECT 1 AS rank, col AS "column", nn AS n_non_null, {r('ny / nn')} AS yes_no_fraction FROM k WHERE ny / nn >= 0.8""")
def n16(spark, sf):
    named = lambda c: "ignition" in c.lower() and "yes" in c.lower()
    return rounded(roles.binary_target_candidates(frame(spark, sf, NAMED), named))


@query("n17_group_candidates", f"""WITH c AS ({NAMED_SQL}), k AS (
 SELECT 'Article' AS col, 0 AS kr, count("Article") / count(*) AS comp, count(DISTINCT "Article") AS d, count(*) AS n FROM c
 UNION ALL SELECT 'Authors', 7, count("Authors") / count(*), count(DISTINCT "Authors"), count(*) FROM c
 UNION ALL SELECT 'Paper row id', 1, count("Paper row id") / count(*), count(DISTINCT "Paper row id"), count(*) FROM c)
 SELECT CAST(row_number() OVER (ORDER BY kr, comp DESC, col) AS INT) AS rank, col AS "column", kr AS keyword_rank,
 {r('comp')} AS completeness FROM k WHERE d < greatest(2, 0.9 * n)""")
def n17(spark, sf):
    return rounded(roles.group_candidates(frame(spark, sf, NAMED)))


@query("n18_range_cut", """SELECT CASE WHEN v > -0.001 AND v <= 0.01 THEN 'Micro-g' WHEN v > 0.01 AND v <= 0.9 THEN 'Partial g'
 WHEN v > 0.9 AND v <= 1.1 THEN 'Normal g' WHEN v > 1.1 AND v <= 100 THEN 'Hyper-g' END AS cut, count(*) AS n
 FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_tax / 8 ELSE l_quantity / 20 END AS v FROM {lineitem}) GROUP BY 1""")
def n18(spark, sf):
    v = F.when(F.col("l_linenumber") == 1, F.col("l_tax") / 8).otherwise(F.col("l_quantity") / 20)
    c = cat.cut(v, cat.GRAVITY_CUT, cat.GRAVITY_CUT_LABELS)
    return table(spark, sf, "lineitem").groupBy(c.alias("cut")).agg(F.count("*").alias("n"))


@query("n19_drop_leakage", f"""WITH c AS ({NAMED_SQL}) SELECT "Shape" AS shape, "Power" AS power, count(*) AS n
 FROM c GROUP BY ALL""")
def n19(spark, sf):
    df = roles.drop_leakage(frame(spark, sf, NAMED), "FSR (mm/s)", "Article")
    kept = [c for c in df.columns if c not in ("FSR (mm/s)", "Article", "Tax", "Blank")]
    return df.groupBy(*kept).agg(F.count("*").alias("n")).withColumnsRenamed(
        {c: c.lower() for c in kept})


@query("n20_feature_types", f"""WITH c AS ({NAMED_SQL}) SELECT 'Power' AS "column", count("Power") AS n_non_null,
 count({sql_number('"Power"')}) AS n_numeric, 'numeric' AS kind FROM c UNION ALL
 SELECT 'Shape', count("Shape"), count({sql_number('"Shape"')}), 'categorical' FROM c UNION ALL
 SELECT 'Tax', count("Tax"), count("Tax"), 'numeric' FROM c UNION ALL SELECT 'Blank', 0, 0, 'empty' FROM c LIMIT 4""")
def n20(spark, sf):
    return roles.feature_types(frame(spark, sf, NAMED), ["Power", "Shape", "Tax", "Blank"])


@query("n21_role_projection", "SELECT l_suppkey, sum(l_quantity) AS physics_total FROM {lineitem} GROUP BY 1")
def n21(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    df = roles.with_roles(df, {"l_quantity": "physics", "l_discount": "apparatus"})
    phys = roles.select_role(df, "physics", keep=["l_suppkey"])
    cols = [c for c in phys.columns if c != "l_suppkey"]
    return phys.groupBy("l_suppkey").agg(F.sum(sum((F.col(c) for c in cols), F.lit(0.0))).alias("physics_total"))


@query("n22_label_filter", f"""WITH c AS ({CELLS}), d AS (SELECT {sql_yes_no('flag')} AS y FROM c)
 SELECT y, count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY 1""")
def n22(spark, sf):
    df = frame(spark, sf, CELLS).select(num.yes_no(F.col("flag")).alias("y"))
    return ids.keep_labelled(df, "y").groupBy("y").agg(F.count("*").alias("n"))


@query("n23_dedupe_in_group", """SELECT l_suppkey, l_linenumber, l_discount, l_returnflag,
 min(l_orderkey) AS l_orderkey FROM {lineitem} GROUP BY 1, 2, 3, 4""")
def n23(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_orderkey")
    return ids.drop_exact_duplicates(
        df, ["l_suppkey", "l_linenumber", "l_discount", "l_returnflag"], F.col("l_orderkey"))


HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS grp FROM {orders}"


@query("n24_fill_group", f"WITH c AS ({HOLES}) SELECT COALESCE(grp, 'UNKNOWN_PAPER') AS grp, count(*) AS n FROM c GROUP BY 1")
def n24(spark, sf):
    return ids.fill_group(frame(spark, sf, HOLES), "grp").groupBy("grp").agg(F.count("*").alias("n"))


def clean_sql() -> str:
    num_cols = [c for c in clean.NUMERIC_ROLES]
    cat_cols = [c for c in clean.CATEGORY_ROLES]
    keys = ", ".join([*num_cols, *cat_cols, "ignition_binary", "entity_id"])
    c = sql_clean
    sel = ", ".join(f"{c(k)} AS {k}" for k in (
        "article", "doi", "geometry", "dimensions", "material", "o2", "pressure", "flow", "rig", "internal_geom",
        "internal_dims", "gravity", "facility", "ig_method", "ig_power", "ig_time", "ignition"))
    case = lambda col, cases, unk=True: (
        "(SELECT CASE " + ("WHEN s IS NULL THEN 'Unknown' " if unk else "") + cases
        + f" END FROM (SELECT {'lower(' + col + ')' if unk else 'lower(COALESCE(' + col + chr(44) + chr(39) * 2 + '))'} AS s))")
    return f"""WITH raw AS ({EXPERIMENTS}), c AS (SELECT row_key, {sel} FROM raw),
 k AS (SELECT COALESCE(material, 'Unknown') AS m, count(*) AS n FROM c GROUP BY 1),
 g AS (SELECT c.*, CASE WHEN k.n >= 10 THEN k.m ELSE 'Other / Rare' END AS material_grouped,
   {sql_yes_no('ignition')} AS ignition_binary FROM c JOIN k ON COALESCE(c.material, 'Unknown') = k.m),
 l AS (SELECT *, {sql_number('o2')} AS ov, {sql_flow('flow')} AS flow_velocity_mm_s, {sql_gravity('gravity')} AS gravity_g,
   {sql_watts('ig_power')} AS ignition_power_w, {sql_number('ig_time')} AS ignition_time_s, {sql_lengths('dimensions')} AS dm,
   {sql_lengths('internal_dims')} AS im, {sql_near('dimensions', 'core|inner')} AS core_diameter_mm,
   {sql_near('dimensions', 'outer|outside')} AS outer_diameter_mm, {SQL_ENTITY} AS entity_id FROM g WHERE ignition_binary IS NOT NULL),
 f AS (SELECT row_key, ignition_binary, CASE WHEN ov > 1 THEN ov / 100 ELSE ov END AS oxygen_fraction,
   {sql_pressure('pressure')} AS pressure_kpa, flow_velocity_mm_s, abs(flow_velocity_mm_s) AS flow_speed_abs_mm_s, gravity_g,
   log10(greatest(gravity_g, 1e-8)) AS log10_gravity_g, ignition_power_w, ignition_time_s,
   ignition_power_w * ignition_time_s AS ignition_energy_j, dm[1] AS sample_dim_1_mm, dm[2] AS sample_dim_2_mm,
   dm[3] AS sample_dim_3_mm, list_min(dm) AS sample_dim_min_mm, list_max(dm) AS sample_dim_max_mm,
   list_avg(dm) AS sample_dim_mean_mm, CAST(len(dm) AS DOUBLE) AS sample_dim_count, core_diameter_mm, outer_diameter_mm,
   CASE WHEN outer_diameter_mm >= core_diameter_mm THEN (outer_diameter_mm - core_diameter_mm) / 2 END AS insulation_thickness_mm,
   im[1] AS internal_dim_1_mm, im[2] AS internal_dim_2_mm, im[3] AS internal_dim_3_mm, list_avg(im) AS internal_dim_mean_mm,
   {case('geometry', GEOMETRY_CASES)} AS geometry_cat, {case('internal_geom', INTERNAL_CASES)} AS internal_geom_cat,
   {case('facility', FACILITY_CASES)} AS facility_cat, {case('ig_method', METHOD_CASES)} AS ig_method_cat,
   {case('material', MATERIAL_CASES, False)} AS material_family, {case('material', CORE_CASES, False)} AS core_material,
   CASE WHEN flow_velocity_mm_s IS NULL THEN 'Unknown' WHEN flow_velocity_mm_s > 0 THEN 'Coflow'
     WHEN flow_velocity_mm_s < 0 THEN 'Counterflow' ELSE 'Quiescent' END AS flow_direction,
   CASE WHEN gravity_g IS NULL THEN 'Unknown' WHEN gravity_g < 1e-3 THEN 'Microgravity' WHEN gravity_g < 0.95 THEN 'Partial'
     WHEN gravity_g <= 1.05 THEN 'Earth' ELSE 'Hyper' END AS gravity_regime, material_grouped, entity_id,
   {sql_label('article', 'entity_id')} AS entity_label, rig AS rig_name FROM l)
 SELECT {', '.join(f'{r(x)} AS {x}' for x in num_cols)}, {', '.join(cat_cols)}, ignition_binary, entity_id,
   min(row_key) AS row_key, arg_min(entity_label, row_key) AS entity_label, arg_min(rig_name, row_key) AS rig_name
 FROM f GROUP BY {keys}"""


@query("n25_clean_experiments", clean_sql())
def n25(spark, sf):
    out = clean.clean_experiments(frame(spark, sf, EXPERIMENTS), keep=("row_key",))
    return rounded(out.drop("raw_citation"))


@query("n26_row_predicates", """SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty FROM {lineitem}
 WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_discount > 0 AND l_returnflag IN ('R', 'A') GROUP BY 1""")
def n26(spark, sf):
    df = table(spark, sf, "lineitem")
    both = F.col("l_discount").isNotNull() & F.col("l_tax").isNotNull()
    ok = df.where(both & (F.col("l_discount") > 0) & F.col("l_returnflag").isin("R", "A"))
    return ok.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
