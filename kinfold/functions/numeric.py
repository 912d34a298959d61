"""Free text with units -> numbers, as Column expressions.

The first number of the text counts; a comma reads as a decimal point and a
hyphen before a digit as a sign, so ``16-27%`` is 16 and the second number of
``0.5-0.8 mm`` is -0.8.  The order of the unit tests is part of the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinfold.functions.text import MISSING_CELLS, clean_cell, contains_any, first_or_null, let

# Number and length-token patterns.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
PLAIN_NUMBER = r"[-+]?\d*\.?\d+"
LENGTH_UNIT = "µm|μm|um|mm|cm|m"
LENGTH_TOKEN = rf"(?i)({NUMBER})\s*({LENGTH_UNIT})?"
# Unit factors.
KPA_PER_MPA, KPA_PER_ATM, KPA_PER_PSI, PA_PER_KPA = 1000.0, 101.325, 6.894757, 1000.0
G_CM_S2, G_MM_S2, G_M_S2 = 981.0, 9810.0, 9.81
LOG_FLOOR = 1e-8
# yes/no vocabularies.
YES = ("yes", "y", "1", "true")
NO = ("no", "n", "0", "false")
YES_OUTCOME = ("yes", "y", "true", "1", "ignited", "extinction")
NO_OUTCOME = ("no", "n", "false", "0", "did not ignite")


def _dots(c: Column) -> Column:
    return F.translate(c, ",−", ".-")


def first_number(c: Column) -> Column:
    return first_or_null(_dots(c), NUMBER).try_cast("double")


def to_number(c: Column) -> Column:
    """The whole text as a number, NULL if it is not one."""
    return c.try_cast("double")


def oxygen_fraction(c: Column) -> Column:
    v = first_number(c)
    return F.when(v > 1, v / 100).otherwise(v)


def pressure_kpa(c: Column) -> Column:
    v, s = first_number(c), F.lower(c)
    return (
        F.when(s.contains("mpa"), v * KPA_PER_MPA)
        .when(s.contains("atm"), v * KPA_PER_ATM)
        .when(s.contains("psia") | s.rlike(r"\bpsi\b"), v * KPA_PER_PSI)
        .when(s.contains("kpa"), v)
        .when(s.contains("pa"), v / PA_PER_KPA)
        .otherwise(v)
    )


def flow_mm_s(c: Column) -> Column:
    v, s = first_number(c), F.lower(c)
    return (
        F.when(s.contains("cm/s"), v * 10)
        .when(s.contains("m/s") & ~s.contains("mm/s"), v * 1000)
        .otherwise(v)
    )


def gravity_g(c: Column) -> Column:
    v, s = first_number(c), F.replace(F.lower(c), F.lit("²"), F.lit("2"))
    has = lambda u: s.contains(f"{u}/s2") | s.contains(f"{u}/s^2")
    tiny = s.contains("micro") | s.contains("µg") | s.contains("μg")
    return (
        F.when(v.isNull(), F.when(tiny, F.lit(1e-6)))
        .when(has("cm"), v / G_CM_S2)
        .when(has("mm"), v / G_MM_S2)
        .when(has("m"), v / G_M_S2)
        .otherwise(v)
    )


def watts(c: Column) -> Column:
    """NULL when the text is a flux or a current, not a power."""
    return F.when(~F.lower(c).rlike(r"w/cm|kw/m|\ba\b|amp|current"), first_number(c))


def seconds(c: Column) -> Column:
    return first_number(c)


def mm_per_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return (
        F.when(u.isin("µm", "μm", "um"), F.lit(0.001))
        .when(u == "cm", F.lit(10.0))
        .when(u == "m", F.lit(1000.0))
        .otherwise(F.lit(1.0))
    )


def lengths_mm(c: Column, strict: bool = False) -> Column:
    """Array of all lengths of the text in mm; NULL text gives an empty array.

    A bare number counts as mm.  The default lets a unit be the first letter of
    the next word ("3 mice" is 3 m); ``strict`` asks for a word end after it.
    """
    s = F.replace(F.replace(_dots_comma(c), F.lit("×"), F.lit("x")), F.lit("Ø"), F.lit("diameter "))
    token = rf"(?i)({NUMBER})\s*((?:{LENGTH_UNIT})\b)?" if strict else LENGTH_TOKEN
    pairs = F.arrays_zip(
        F.regexp_extract_all(s, F.lit(token), 1).alias("n"),
        F.regexp_extract_all(s, F.lit(token), 2).alias("u"),
    )
    mm = F.transform(pairs, lambda p: p["n"].try_cast("double") * mm_per_unit(p["u"]))
    return F.coalesce(mm, F.array().cast("array<double>"))


def _dots_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def array_features(arr: Column, prefix: str, count: bool = True) -> list[Column]:
    """First three, min, max, mean (and size) of a length array."""
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    out = [F.try_element_at(arr, F.lit(i)).alias(f"{prefix}_{i}_mm") for i in (1, 2, 3)]
    out += [
        F.array_min(arr).alias(f"{prefix}_min_mm"),
        F.array_max(arr).alias(f"{prefix}_max_mm"),
        F.when(F.size(arr) > 0, total / F.size(arr)).alias(f"{prefix}_mean_mm"),
    ]
    if count:
        out.append(F.size(arr).cast("double").alias(f"{prefix}_count"))
    return out


def _near_word(s: Column, words: str) -> Column:
    """Length before the word, else the first length within 20 non-digits after it."""
    before = rf"({PLAIN_NUMBER})\s*({LENGTH_UNIT})?\s*(?:diameter\s*)?(?:{words})"
    after = rf"(?:{words})\D{{0,20}}({PLAIN_NUMBER})\s*({LENGTH_UNIT})?"
    pick = lambda p: (
        first_or_null(s, p, 1).try_cast("double") * mm_per_unit(F.regexp_extract(s, p, 2))
    )
    named = contains_any(s, words.split("|"))  # cheap test before four pattern searches
    return F.when(named, F.coalesce(pick(before), pick(after)))


def core_outer_mm(c: Column) -> Column:
    """Struct (core, outer, thickness) in mm from texts like "0.5mm core; 1.1 mm outer"."""
    def pair(s: Column) -> Column:
        return F.struct(
            _near_word(s, "core|inner").alias("c"), _near_word(s, "outer|outside").alias("o")
        )

    found = let(F.lower(F.replace(_dots_comma(c), F.lit("×"), F.lit("x"))), pair)
    return let(found, lambda w: F.struct(
        w["c"].alias("core"), w["o"].alias("outer"),
        F.when(w["o"] >= w["c"], (w["o"] - w["c"]) / 2).alias("thickness"),
    ))


def floored_log10(c: Column, floor: float = LOG_FLOOR) -> Column:
    """log10 with the value clipped from below; NULL stays NULL."""
    return F.when(c.isNotNull(), F.log10(F.greatest(c, F.lit(floor))))


def yes_no(c: Column, yes=YES, no=NO) -> Column:
    s = F.lower(clean_cell(c, MISSING_CELLS))
    return F.when(s.isin(*yes), F.lit(1)).when(s.isin(*no), F.lit(0))
