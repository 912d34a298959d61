"""Parsers and categories against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from kinfold.functions import categories as cat
from kinfold.functions import identity as ident
from kinfold.functions import numeric as num
from kinfold.functions import text as txt


def evaluate(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if isinstance(w, float):
            assert g == pytest.approx(w, rel=1e-12), (got, want)
        else:
            assert g == w, (got, want)


def test_clean_cell(spark):
    same(evaluate(spark, txt.clean_cell, ["  a \t b ", "N/A", "-", " none ", "", None, "x y"]),
         ["a b", None, None, None, None, None, "x y"])


def test_first_number(spark):
    same(evaluate(spark, num.first_number, ["16-27%", "−150 mm/s", "1,5", ".5e2 x", "none", None, "1e-6"]),
         [16.0, -150.0, 1.5, 50.0, None, None, 1e-6])


def test_units(spark):
    same(evaluate(spark, num.oxygen_fraction, ["21%", "0.21", "1"]), [0.21, 0.21, 1.0])
    same(evaluate(spark, num.pressure_kpa, ["101.3 kPa", "1 atm", "14.7 psia", "2 psi", "0.1 MPa", "101325 Pa", "30"]),
         [101.3, 101.325, 14.7 * 6.894757, 2 * 6.894757, 100.0, 101.325, 30.0])
    same(evaluate(spark, num.flow_mm_s, ["-60 mm/s", "0.12 m/s", "5 cm/s", "7"]), [-60.0, 120.0, 50.0, 7.0])
    same(evaluate(spark, num.gravity_g, ["1e-6", "µg", "9.81 m/s2", "981 cm/s²", "9810 mm/s^2", "x"]),
         [1e-6, 1e-6, 1.0, 1.0, 1.0, None])
    same(evaluate(spark, num.watts, ["92 W", "20 kW/m2", "2 A", "3 amp"]), [92.0, None, None, None])


def test_lengths(spark):
    same(evaluate(spark, num.lengths_mm, [
        "6.4, 9.5, and 12.7 mm in diameter and 57.2 mm in length", "20mm x 40mm x 1.5mm", "650 µm",
        "0.5-0.8 mm", None, "3 mice",
    ]), [[6.4, 9.5, 12.7, 57.2], [20.0, 40.0, 1.5], [0.65], [0.5, -0.8], [], [3000.0]])
    same(evaluate(spark, lambda c: num.lengths_mm(c, strict=True), ["3 mice", "3 m"]), [[3.0], [3000.0]])


def test_core_outer(spark):
    got = evaluate(spark, num.core_outer_mm, ["0.5mm core; 1.1 mm outer", "core of 50 um, outer 2 mm", "plain", None])
    assert got[0]["core"] == 0.5 and got[0]["outer"] == 1.1 and got[0]["thickness"] == pytest.approx(0.3)
    assert got[1]["core"] == pytest.approx(0.05) and got[1]["outer"] == 2.0
    assert got[2]["core"] is None and got[3]["outer"] is None


def test_yes_no_and_slug(spark):
    same(evaluate(spark, num.yes_no, ["Yes ", "no", "Y", "0", "maybe", None]), [1, 0, 1, 0, None, None])
    same(evaluate(spark, txt.slug, ["  Flow (mm/s)! "]), ["flow_mm_s"])


def test_categories(spark):
    same(evaluate(spark, cat.material_family, ["black PMMA", "LDPE", "pe film", "paper", "peek", None, "oak", " "]),
         ["PMMA", "LDPE", "PE", "Cellulosic", "PEEK", "Unknown", "Other", "Unknown"])
    same(evaluate(spark, cat.facility, ["Drop tower with centrifuge", "drop", "ISS", "n/a", "lab"]),
         ["Drop Tower + Centrifuge", "Drop Tower", "Spacecraft / ISS", "Unknown", "Other"])
    same(evaluate(spark, cat.core_material, ["Cu core", "SS inner", "iron", None]),
         ["Copper", "Stainless steel", "Iron", "None / NA"])


def test_identity(spark):
    same(evaluate(spark, ident.canonical_doi, ["https://doi.org/10.1/AB.", "doi: 10.1/ab", "-"]),
         ["10.1/ab", "10.1/ab", None])
    same(evaluate(spark, ident.canonical_citation, ["Öl, A. “Test” 2019."]), ["l a test 2019"])
    same(evaluate(spark, lambda c: ident.short_label(c, F.lit("10.1016/j.proci.2018")), ["Link, S. (2018)", None]),
         ["Link 2018 [j.proci.2018]", "10 2018 [j.proci.2018]"])


def test_digamma(spark):
    from kinfold.operators.audit import digamma

    got = spark.range(1).select(digamma(F.lit(1.0)), digamma(F.lit(10.0))).first()
    assert got[0] == pytest.approx(-0.5772156649, abs=1e-8)
    assert got[1] == pytest.approx(2.2517525890, abs=1e-8)


def test_t_distribution():
    import pandas as pd

    from kinfold.functions.special import student_t_two_sided

    # r = 0.5, n = 12: t = 1.8257 on 10 degrees
    p = student_t_two_sided(pd.Series([0.5, 0.0]), pd.Series([12.0, 12.0]))
    assert p[0] == pytest.approx(0.0979, abs=2e-4) and p[1] == pytest.approx(1.0)


def test_focal_gradient(spark):
    from kinfold.operators.models import focal_gradient

    def loss(m, y, g):
        q = 1 / (1 + math.exp(-m)) if y == 1 else 1 - 1 / (1 + math.exp(-m))
        return -((1 - q) ** g) * math.log(q)

    rows = [(y, m) for y in (0, 1) for m in (-2.0, -0.3, 0.0, 0.7, 3.0)]
    df = spark.createDataFrame(rows, "y int, m double")
    for gamma in (0.0, 1.0, 2.0):
        g, h = focal_gradient(F.col("y"), F.col("m"), gamma)
        for r in df.select("y", "m", g.alias("g"), h.alias("h")).collect():
            e = 1e-4
            up, mid, dn = (loss(r.m + d, r.y, gamma) for d in (e, 0, -e))
            assert r.g == pytest.approx((up - dn) / (2 * e), abs=1e-6)
            assert r.h == pytest.approx(max((up - 2 * mid + dn) / e**2, 1e-16), abs=1e-5)
        if gamma == 0:
            for r in df.select("y", "m", g.alias("g"), h.alias("h")).collect():
                p = 1 / (1 + math.exp(-r.m))
                assert r.g == pytest.approx(p - r.y) and r.h == pytest.approx(p * (1 - p))


def test_decode_entities_like_the_standard_library(spark):
    import html
    from html.entities import html5

    numbers = [0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 0xD7FF, 0xD800, 0xE000, 0xFDD0, 0xFFFE, 0x1F525, 0x1FFFF, 0x10FFFF, 0x110000]
    texts = [f"a&{n}b" for n in html5] + [f"&#{n};" for n in numbers] + [f"&#x{n:X}z" for n in numbers]
    texts += ["", "&", "&&amp;", "&amp;lt;", "&notit;", "&notin", "&#", "&#x;", "&#00065;", "&#99999999999999999999;", "&unknown; &am", "no", None, "& &lt"]
    same(evaluate(spark, txt.decode_entities, texts), [t if t is None else html.unescape(t) for t in texts])
