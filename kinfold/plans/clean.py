"""The full cleaning plan: raw text cells -> typed feature frame, one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.functions import categories as cat
from kinfold.functions import numeric as num
from kinfold.functions.identity import canonical_doi, cited_entity, label_head, label_with_tail
from kinfold.functions.text import clean_cell, let
from kinfold.operators.identity import drop_exact_duplicates, group_rare
from kinfold.plans.session import cut_lineage, spread
from kinfold.plans.texts import read_once

# Feature names and their roles.
NUMERIC_ROLES = {
    "oxygen_fraction": "physics", "pressure_kpa": "physics", "flow_velocity_mm_s": "physics",
    "flow_speed_abs_mm_s": "physics", "gravity_g": "physics", "log10_gravity_g": "physics",
    "ignition_power_w": "apparatus", "ignition_time_s": "apparatus",
    "ignition_energy_j": "apparatus",
    "sample_dim_1_mm": "physics", "sample_dim_2_mm": "physics", "sample_dim_3_mm": "physics",
    "sample_dim_min_mm": "physics", "sample_dim_max_mm": "physics",
    "sample_dim_mean_mm": "physics", "sample_dim_count": "apparatus",
    "core_diameter_mm": "physics", "outer_diameter_mm": "physics",
    "insulation_thickness_mm": "physics",
    "internal_dim_1_mm": "apparatus", "internal_dim_2_mm": "apparatus",
    "internal_dim_3_mm": "apparatus", "internal_dim_mean_mm": "apparatus",
}
CATEGORY_ROLES = {
    "geometry_cat": "physics", "internal_geom_cat": "apparatus", "facility_cat": "apparatus",
    "ig_method_cat": "apparatus", "material_family": "physics", "core_material": "physics",
    "flow_direction": "physics", "gravity_regime": "physics", "material_grouped": "apparatus",
}
# The text columns that features come from.
TEXTS = (
    "ignition", "o2", "pressure", "flow", "gravity", "ig_power", "ig_time", "dimensions", "internal_dims", "geometry",
    "internal_geom", "facility", "ig_method", "material", "doi", "article", "rig",
)
ROLES = {**NUMERIC_ROLES, **CATEGORY_ROLES}


def feature_names(role: str = "all") -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names: every role or one."""
    if role not in ("all", "physics", "apparatus"):
        raise ValueError(f"unknown feature set {role!r}")
    pick = lambda d: [k for k, v in d.items() if role in ("all", v)]
    return pick(NUMERIC_ROLES), pick(CATEGORY_ROLES)


def clean_experiments(raw: DataFrame, dedupe: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed features, 0/1 label and identity columns from the 18 logical text columns.

    A column's texts are read once each if they are few, else row by row; rows without a label
    go first.  The texts are stored, because several passes read them.  Materials are counted over
    all rows, by themselves; the parsed columns, not the texts, go through the join that marks
    rare ones.
    """
    raw = cut_lineage(spread(raw).select(*keep, *TEXTS))
    materials = raw.groupBy("material").agg(F.count("*").alias("n")).select(
        F.coalesce(clean_cell(F.col("material")), F.lit("Unknown")).alias("material_grouped"), "n")
    cell = lambda read: lambda c: read(clean_cell(c))
    lengths = lambda c, *a, **kw: let(num.lengths_mm(c), lambda v: F.struct(*num.array_features(v, *a, **kw)))
    cells = read_once(raw, {
        "ignition": cell(num.yes_no),
        "o2": cell(num.oxygen_fraction), "pressure": cell(num.pressure_kpa),
        "flow": cell(num.flow_mm_s), "gravity": cell(num.gravity_g),
        "ig_power": cell(num.watts), "ig_time": cell(num.seconds),
        "dimensions": lambda c: let(clean_cell(c), lambda s: F.struct(
            lengths(s, "sample_dim").alias("sample"), num.core_outer_mm(s).alias("wire"))),
        "internal_dims": cell(lambda s: lengths(s, "internal_dim", count=False)),
        "geometry": cell(cat.geometry), "internal_geom": cell(cat.internal_geometry),
        "facility": cell(cat.facility), "ig_method": cell(cat.ignition_method),
        "material": lambda c: let(clean_cell(c), lambda s: F.struct(
            cat.material_family(s).alias("family"), cat.core_material(s).alias("core"),
            F.coalesce(s, F.lit("Unknown")).alias("grouped"))),
        "doi": cell(canonical_doi),
        "article": lambda c: let(clean_cell(c), lambda s: F.struct(
            s.alias("raw"), cited_entity(s).alias("entity"), label_head(s).alias("head"))),
        "rig": clean_cell,
    }).where(F.col("ignition").isNotNull())
    power, time = F.col("ig_power"), F.col("ig_time")
    out = cells.select(
        *keep, F.col("ignition").alias("ignition_binary"),
        F.col("o2").alias("oxygen_fraction"), F.col("pressure").alias("pressure_kpa"),
        F.col("flow").alias("flow_velocity_mm_s"), F.abs("flow").alias("flow_speed_abs_mm_s"),
        F.col("gravity").alias("gravity_g"),
        num.floored_log10(F.col("gravity")).alias("log10_gravity_g"),
        power.alias("ignition_power_w"), time.alias("ignition_time_s"),
        (power * time).alias("ignition_energy_j"),
        F.col("dimensions.sample.*"),
        F.col("dimensions.wire.core").alias("core_diameter_mm"),
        F.col("dimensions.wire.outer").alias("outer_diameter_mm"),
        F.col("dimensions.wire.thickness").alias("insulation_thickness_mm"),
        F.col("internal_dims.*"),
        F.col("geometry").alias("geometry_cat"), F.col("internal_geom").alias("internal_geom_cat"),
        F.col("facility").alias("facility_cat"), F.col("ig_method").alias("ig_method_cat"),
        F.col("material.family").alias("material_family"),
        F.col("material.core").alias("core_material"),
        cat.flow_direction(F.col("flow")).alias("flow_direction"),
        cat.gravity_regime(F.col("gravity")).alias("gravity_regime"),
        F.col("material.grouped").alias("material_grouped"),
        F.coalesce("doi", "article.entity").alias("entity_id"), F.col("article.head").alias("__head"),
        F.col("article.raw").alias("raw_citation"), F.col("rig").alias("rig_name"),
    ).drop("internal_dim_min_mm", "internal_dim_max_mm")
    out = group_rare(out, "material_grouped", among=materials, weight="n")
    names = [c for c in out.columns if c != "__head"]
    names.insert(names.index("raw_citation"), "entity_label")
    if dedupe:
        keys = [*NUMERIC_ROLES, *CATEGORY_ROLES, "ignition_binary", "entity_id"]
        order = F.struct(*keep) if keep else F.struct("raw_citation", "rig_name")
        out = drop_exact_duplicates(out, keys, order)
    head = F.coalesce("__head", label_head(F.col("entity_id")))
    return out.withColumn("entity_label", label_with_tail(head, F.col("entity_id"))).select(*names)
