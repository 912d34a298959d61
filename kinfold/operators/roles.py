"""Which column is target, group, leak, numeric: one aggregate per question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.functions.numeric import first_number, yes_no
from kinfold.functions.text import clean_cell

# Header keywords.
TARGET_WORDS = ("fsr", "flame spread", "spread rate", "spreadrate")
GROUP_WORDS = (
    "article", "paper", "mla", "citation", "doi", "publication", "reference", "author",
)
OUTCOME_WORDS = (
    "flame length", "hrr", "heat release", "smoke", "aerosol", "areosol", "ignition (yes",
    "burn", "extinction", "extinguish",
)
NOTE_WORDS = ("info", "note", "comment", "remark")
BINARY_FRACTION, NUMERIC_FRACTION, ID_LIKE_FRACTION = 0.8, 0.6, 0.9


def _named(col: str, words: Sequence[str]) -> bool:
    return any(w in col.lower() for w in words)


def _text(df: DataFrame, c: str):
    return F.col(f"`{c}`").cast("string")


def column_profile(df: DataFrame, group_words: Sequence[str] = GROUP_WORDS) -> DataFrame:
    """One pass over all columns: non-null, number-parsable, yes/no-parsable, distinct.

    Distinct counts are exact and taken only for columns named like a group, to
    reject those that are nearly unique per row.  One row per column comes back.
    """
    aggs = [F.count("*").alias("__n")]
    for i, c in enumerate(df.columns):
        s = _text(df, c)
        aggs += [
            F.count(s).alias(f"__nn{i}"),
            F.count(first_number(s)).alias(f"__num{i}"),
            F.count(yes_no(s)).alias(f"__yn{i}"),
            (F.count_distinct(s) if _named(c, group_words) else F.lit(0)).alias(
                f"__nd{i}"
            ),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.col(f"__nn{i}").alias("n_non_null"), F.col(f"__num{i}").alias("n_numeric"),
            F.col(f"__yn{i}").alias("n_yes_no"), F.col(f"__nd{i}").alias("n_distinct"),
        )
        for i, c in enumerate(df.columns)
    ])
    return one.select(F.col("__n").alias("n_rows"), F.inline(rows))


def target_candidates(df: DataFrame, words: Sequence[str] = TARGET_WORDS) -> DataFrame:
    """Columns named like the target, most number-parsable first (rank 1 wins)."""
    cols = [c for c in df.columns if _named(c, words)]
    if not cols:
        raise ValueError(f"no column named like {tuple(words)}")
    prof = column_profile(df.select(*[f"`{c}`" for c in cols]), ())
    order = [F.desc("n_numeric"), F.asc("position")]
    return _ranked(prof, order).select("rank", "column", "n_non_null", "n_numeric")


def detect_target(df: DataFrame, words: Sequence[str] = TARGET_WORDS) -> str:
    return target_candidates(df, words).where("rank = 1").first()["column"]


def binary_target_candidates(df: DataFrame, name_test=None) -> DataFrame:
    """Columns with at least 80 % yes/no values, cleanest first; any column if none is named so."""
    named = [c for c in df.columns if name_test and name_test(c)]
    prof = column_profile(df.select(*[f"`{c}`" for c in named or df.columns]), ())
    frac = F.try_divide(F.col("n_yes_no"), F.col("n_non_null"))
    ok = prof.withColumn("yes_no_fraction", frac).where(F.col("yes_no_fraction") >= BINARY_FRACTION)
    order = [F.desc("yes_no_fraction"), F.asc("position")]
    return _ranked(ok, order).select("rank", "column", "n_non_null", "yes_no_fraction")


def group_candidates(df: DataFrame, words: Sequence[str] = GROUP_WORDS) -> DataFrame:
    """Columns named like a cluster id: keyword order, then completeness; ids per row rejected."""
    prof = column_profile(
        df.select(*[f"`{c}`" for c in df.columns if _named(c, words)]), words
    )
    keyword = F.lit(len(words))
    for i in range(len(words) - 1, -1, -1):
        keyword = F.when(F.lower("column").contains(words[i]), F.lit(i)).otherwise(keyword)
    ok = prof.withColumn("keyword_rank", keyword).withColumn(
        "completeness", F.col("n_non_null") / F.greatest("n_rows", F.lit(1))
    ).where(F.col("n_distinct") < F.greatest(F.lit(2.0), ID_LIKE_FRACTION * F.col("n_rows")))
    order = [F.asc("keyword_rank"), F.desc("completeness"), F.asc("column")]
    return _ranked(ok, order).select("rank", "column", "keyword_rank", "completeness")


def _ranked(df: DataFrame, order) -> DataFrame:
    """Rank the one-row-per-column table (bounded by the width of the schema)."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def leakage_columns(columns: Sequence[str], target: str, group: str) -> dict[str, str]:
    """Column -> reason, for every column that must not be a feature."""
    reasons: dict[str, str] = {}
    for c in columns:
        if c in (target, group):
            continue
        for reason, words in (
            ("target copy", TARGET_WORDS), ("outcome", OUTCOME_WORDS), ("note", NOTE_WORDS),
            ("identity", GROUP_WORDS),
        ):
            if _named(c, words):
                reasons[c] = reason
                break
    return reasons


def drop_leakage(df: DataFrame, target: str, group: str) -> DataFrame:
    return df.drop(*leakage_columns(df.columns, target, group))


def feature_types(
    df: DataFrame, features: Sequence[str], threshold: float = NUMERIC_FRACTION
) -> DataFrame:
    """Column -> ``numeric`` / ``categorical`` / ``empty``, one row per feature."""
    prof = column_profile(df.select(*[f"`{c}`" for c in features]), ())
    native = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
    frac = F.try_divide(F.col("n_numeric"), F.col("n_non_null"))
    kind = (
        F.when(F.col("n_non_null") == 0, "empty")
        .when(F.col("column").isin(native) | (frac >= threshold), "numeric")
        .otherwise("categorical")
    )
    return prof.select("column", "n_non_null", "n_numeric", kind.alias("kind"))


def apply_feature_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Replace numeric text by its number, clean categorical text, drop empty columns."""
    out = []
    for c in df.columns:
        kind = kinds.get(c)
        if kind == "empty":
            continue
        if isinstance(df.schema[c].dataType, T.StringType) and kind:
            conv = first_number if kind == "numeric" else clean_cell
            out.append(conv(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Store each column's role in its metadata."""
    return df.select(*[
        F.col(c).alias(c, metadata={"role": roles[c]}) if c in roles else F.col(c)
        for c in df.columns
    ])


def select_role(df: DataFrame, role: str, keep: Sequence[str] = ()) -> DataFrame:
    """Projection by role: ``all`` or one role, plus the ``keep`` columns."""
    ok = [
        f.name for f in df.schema.fields
        if f.name in keep or (role == "all" and "role" in f.metadata) or f.metadata.get("role") == role
    ]
    return df.select(*ok)
