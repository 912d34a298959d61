"""Ordered keyword rules and numeric buckets -> category labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from kinfold.functions.text import clean_cell, contains_any, let


@dataclass(frozen=True)
class Rule:
    """A label with the substrings (any), substrings (all) or pattern that earn it."""

    label: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    pattern: str | None = None

    def holds(self, text: Column) -> Column:
        hit = contains_any(text, self.any_of)
        if self.all_of:
            every = F.lit(True)
            for w in self.all_of:
                every = every & text.contains(w)
            hit = hit | every
        return hit | text.rlike(self.pattern) if self.pattern else hit


def keyword_category(
    c: Column, rules: Sequence[Rule], default: str, unknown: str | None = None
) -> Column:
    """First rule that holds wins; ``unknown`` labels missing text."""
    def choose(s: Column) -> Column:
        out = F.when(s.isNull(), F.lit(unknown))
        for r in rules:
            out = out.when(r.holds(s), F.lit(r.label))
        return out.otherwise(F.lit(default))

    text = clean_cell(c) if unknown is not None else F.coalesce(c, F.lit(""))
    return let(F.lower(text), choose)


# Rule tables.  The order decides.
GEOMETRY = (
    Rule("Wire", ("wire",)),
    Rule("Flat", ("flat",)),
    Rule("Cylindrical", ("cyl",)),
    Rule("Spherical", ("spher",)),
    Rule("Chunk", ("chunk",)),
)
INTERNAL_GEOMETRY = (
    Rule("Rectangular", ("rect",)),
    Rule("Cylindrical", ("cyl", "circular", "annular")),
)
FACILITY = (
    Rule("Parabolic Aircraft", ("parabolic",)),
    Rule("Drop Tower + Centrifuge", all_of=("drop", "centrifuge")),
    Rule("Drop Tower", ("drop",)),
    Rule("Centrifuge", ("centrifuge", "hypergravity")),
    Rule("Spacecraft / ISS", ("iss", "spacecraft")),
    Rule("Sounding Rocket", ("sounding", "rocket")),
    Rule("Ground", ("ground",)),
)
IGNITION_METHOD = (
    Rule("Open Flame", ("open flame", "pilot", "match")),
    Rule("Radiative Heater", ("radiative", "heater")),
    Rule("Discharge", ("discharge", "high-voltage")),
    Rule("Wire / Coil", ("wire", "coil", "nicr", "electric")),
)
MATERIAL = (
    Rule("LDPE", ("ldpe", "low-density polyethylene")),
    Rule("HDPE", ("hdpe", "high-density polyethylene")),
    Rule("ETFE", ("etfe",)),
    Rule("PMMA", ("pmma", "organic glass")),
    Rule("PE", pattern=r"\bpe\b|polyethylene"),
    Rule("Cellulosic", ("cellulos", "kimwipe", "tissue", "paper", "cotton")),
    Rule("Nomex", ("nomex",)),
    Rule("Kapton", ("kapton",)),
    Rule("Kevlar", ("kevlar",)),
    Rule("Polycarbonate", ("polycarbonate",)),
    Rule("Silicone", ("silicone",)),
    Rule("PEEK", ("peek",)),
    Rule("PPSU", ("ppsu",)),
    Rule("Conex", ("conex",)),
    Rule("SIBAL", ("sibal",)),
    Rule("Unknown", pattern=r"^\s*(nan)?\s*$"),
)
CORE_MATERIAL = (
    Rule("NiCr", ("nicr", "nichrome")),
    Rule("Copper", ("copper",), pattern=r"\bcu\b"),
    Rule("Stainless steel", ("stainless",), pattern=r"\bss\b"),
    Rule("Steel", ("steel",)),
    Rule("Iron", ("iron",), pattern=r"\bfe\b"),
)
# Canonical names in extracted rows.
EXTRACTED_GEOMETRY = (
    ("wire", "wire"), ("cylindrical", "cylindrical"), ("cylinder", "cylindrical"),
    ("rod", "cylindrical"), ("flat", "flat"), ("sheet", "flat"), ("plate", "flat"),
)
EXTRACTED_GEOMETRY_TITLE = (
    ("wire", "Wire"), ("cylindrical", "Cylindrical"), ("cylinder", "Cylindrical"),
    ("rod", "Cylindrical"), ("flat", "Rectangle"), ("sheet", "Rectangle"), ("plate", "Rectangle"),
)
EXTRACTED_FACILITY = (
    ("parabolic", "Parabolic Aircraft"), ("drop tower", "Drop Tower"), ("iss", "Spacecraft"),
    ("spacecraft", "Spacecraft"), ("rocket", "Sounding Rocket"),
)
# Gravity limits (half-open regime and right-closed cut).
MICRO_BELOW, PARTIAL_BELOW, EARTH_UP_TO = 1e-3, 0.95, 1.05
GRAVITY_CUT = (-0.001, 0.01, 0.9, 1.1, 100.0)
GRAVITY_CUT_LABELS = ("Micro-g", "Partial g", "Normal g", "Hyper-g")


def geometry(c: Column) -> Column:
    return keyword_category(c, GEOMETRY, "Other", "Unknown")


def internal_geometry(c: Column) -> Column:
    return keyword_category(c, INTERNAL_GEOMETRY, "Other", "Unknown")


def facility(c: Column) -> Column:
    return keyword_category(c, FACILITY, "Other", "Unknown")


def ignition_method(c: Column) -> Column:
    return keyword_category(c, IGNITION_METHOD, "Other", "Unknown")


def material_family(c: Column) -> Column:
    return keyword_category(c, MATERIAL, "Other")


def core_material(c: Column) -> Column:
    return keyword_category(c, CORE_MATERIAL, "None / NA")


def flow_direction(v: Column) -> Column:
    return (
        F.when(v.isNull(), "Unknown").when(v > 0, "Coflow").when(v < 0, "Counterflow")
        .otherwise("Quiescent")
    )


def gravity_regime(g: Column) -> Column:
    return (
        F.when(g.isNull(), "Unknown").when(g < MICRO_BELOW, "Microgravity")
        .when(g < PARTIAL_BELOW, "Partial").when(g <= EARTH_UP_TO, "Earth").otherwise("Hyper")
    )


def cut(v: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (edge[i], edge[i+1]]; NULL outside all of them."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = (v > lo) & (v <= hi)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def canonical(c: Column, table: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """First key contained in the lower-cased text gives its canonical name."""
    s, out = F.lower(c), F.when(c.isNull(), F.lit(None).cast("string"))
    for key, name in table:
        out = out.when(s.contains(key), F.lit(name))
    return out.otherwise(otherwise)
