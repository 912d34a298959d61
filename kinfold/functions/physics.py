"""Derived physics columns of the documented feature table (SI unless named).

The document gives formulas and assumptions; property values are nominal
room-temperature handbook values for the material families of
``kinfold.functions.categories``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Assumptions of the feature document.
AIR_VISCOSITY_PA_S = 1.85e-5
GR_BETA_DT = 4.0
T_INITIAL_K = 293.0
T_FLAME_BASE_K, T_FLAME_SLOPE_K, O2_REFERENCE = 1400.0, 2500.0, 0.21
T_FLAME_MIN_K, T_FLAME_MAX_K = 1200.0, 3000.0
GRAVITY_M_S2 = 9.81
GAS_CONSTANT = 8.314462618

# Nominal fuel properties
# (family, density kg/m3, conductivity W/mK, heat capacity J/kgK, pyrolysis K, MJ/kg).
FUELS = (
    ("LDPE", 920.0, 0.33, 2300.0, 673.0, 43.3),
    ("HDPE", 955.0, 0.46, 2250.0, 690.0, 43.3),
    ("PE", 940.0, 0.40, 2280.0, 680.0, 43.3),
    ("ETFE", 1700.0, 0.24, 1950.0, 743.0, 12.6),
    ("PMMA", 1190.0, 0.19, 1420.0, 653.0, 24.9),
    ("Cellulosic", 500.0, 0.07, 1340.0, 603.0, 16.4),
    ("Nomex", 720.0, 0.13, 1200.0, 700.0, 28.0),
    ("Kapton", 1420.0, 0.16, 1090.0, 820.0, 26.0),
    ("Kevlar", 1440.0, 0.04, 1420.0, 760.0, 28.0),
    ("Polycarbonate", 1200.0, 0.20, 1250.0, 723.0, 29.7),
    ("Silicone", 1150.0, 0.20, 1460.0, 700.0, 15.5),
    ("PEEK", 1310.0, 0.25, 1340.0, 848.0, 31.0),
    ("PPSU", 1290.0, 0.30, 1100.0, 800.0, 27.0),
    ("Conex", 1380.0, 0.13, 1200.0, 700.0, 28.0),
    ("SIBAL", 570.0, 0.08, 1380.0, 603.0, 15.0),
)
# Wire cores (name, density, conductivity, heat capacity).
CORES = (
    ("NiCr", 8400.0, 11.3, 450.0),
    ("Copper", 8960.0, 401.0, 385.0),
    ("Stainless steel", 8000.0, 16.2, 500.0),
    ("Steel", 7850.0, 50.0, 490.0),
    ("Iron", 7870.0, 80.0, 449.0),
)
# Gases (name, g/mol, J/kgK, W/mK).
GASES = (
    ("O2", 32.0, 918.0, 0.0266),
    ("N2", 28.0, 1040.0, 0.0259),
    ("He", 4.0, 5193.0, 0.1513),
    ("Ar", 40.0, 520.0, 0.0177),
    ("CO2", 44.0, 844.0, 0.0166),
)
_FUEL_COLS = ("density", "k", "cp", "pyrolysis_k", "heat_mj_kg")
_CORE_COLS = ("core_density", "core_k", "core_cp")
_GAS_COLS = ("dil_molar", "dil_cp", "dil_k")


def _fixed_table(spark: SparkSession, key: str, cols, rows) -> DataFrame:
    schema = f"{key} string, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def add_material_properties(df: DataFrame, family: str, core: str | None = None) -> DataFrame:
    """Left join of the fixed property tables (15 and 5 rows, so broadcast)."""
    fuels = _fixed_table(df.sparkSession, family, _FUEL_COLS, FUELS)
    out = df.join(F.broadcast(fuels), family, "left")
    if core is not None:
        cores = _fixed_table(df.sparkSession, core, _CORE_COLS, CORES)
        out = out.join(F.broadcast(cores), core, "left")
    return out


def oxygen_partial_pressure(fraction: Column, pressure_kpa: Column) -> Column:
    return fraction * pressure_kpa


def add_gas_mixture(
    df: DataFrame, fraction: str, pressure_kpa: str, diluent: str,
    t_initial: Column | None = None,
) -> DataFrame:
    """Mole-weighted O2/diluent mixture: molar mass, cp, k, density, diffusivity, viscosity."""
    gases = _fixed_table(df.sparkSession, "__gas", _GAS_COLS, GASES)
    _, o2_m, o2_cp, o2_k = GASES[0]
    x = F.col(fraction)
    t = F.coalesce(t_initial, F.lit(T_INITIAL_K)) if t_initial is not None else F.lit(T_INITIAL_K)
    out = df.withColumn("__gas", F.coalesce(F.col(diluent), F.lit("N2"))).join(
        F.broadcast(gases), "__gas", "left"
    )
    molar = x * o2_m + (1 - x) * F.col("dil_molar")
    mass_cp = (x * o2_m * o2_cp + (1 - x) * F.col("dil_molar") * F.col("dil_cp")) / molar
    conductivity = x * o2_k + (1 - x) * F.col("dil_k")
    density = F.col(pressure_kpa) * 1000 * (molar / 1000) / (F.lit(GAS_CONSTANT) * t)
    return (
        out.withColumn("gas_molar_g", molar)
        .withColumn("gas_cp", mass_cp)
        .withColumn("gas_k", conductivity)
        .withColumn("gas_density", density)
        .withColumn("gas_alpha", F.try_divide(F.col("gas_k"), F.col("gas_density") * F.col("gas_cp")))
        .withColumn("gas_nu", F.try_divide(F.lit(AIR_VISCOSITY_PA_S), F.col("gas_density")))
        .drop("__gas", *_GAS_COLS)
    )


def buoyant_velocity_mm_s(g_ratio: Column, nu: Column) -> Column:
    return F.cbrt(g_ratio * GRAVITY_M_S2 * nu) * 1000


def effective_velocity_mm_s(flow_mm_s: Column, buoyant: Column) -> Column:
    return F.abs(F.coalesce(flow_mm_s, F.lit(0.0))) + buoyant


def flow_is_opposed(flow_mm_s: Column) -> Column:
    return F.when(flow_mm_s.isNotNull(), (flow_mm_s < 0).cast("int"))


def reynolds(flow_mm_s: Column, length_mm: Column, nu: Column) -> Column:
    return F.try_divide(F.abs(flow_mm_s) * length_mm / 1e6, nu)


def grashof(g_ratio: Column, length_mm: Column, nu: Column) -> Column:
    length = length_mm / 1000
    return F.try_divide(
        g_ratio * GRAVITY_M_S2 * GR_BETA_DT * length * length * length, nu * nu
    )


def mixed_convection(gr: Column, re: Column) -> Column:
    return F.try_divide(gr, re * re)


def thermal_inertia(k: Column, rho: Column, cp: Column) -> Column:
    return k * rho * cp


def solid_diffusivity(k: Column, rho: Column, cp: Column) -> Column:
    return F.try_divide(k, rho * cp)


def half_thickness_mm(geometry: Column, dim_min: Column, insulation: Column) -> Column:
    """Conduction depth: coating of a wire, radius of a rod, half of a sheet."""
    return F.when(geometry == "Wire", F.coalesce(insulation, dim_min / 2)).otherwise(dim_min / 2)


def areal_heat_capacity(rho: Column, cp: Column, half_mm: Column) -> Column:
    return rho * cp * half_mm / 1000


def thickness_ratio(half_mm: Column, gas_alpha: Column, velocity_mm_s: Column) -> Column:
    return F.try_divide(half_mm / 1000 * velocity_mm_s / 1000, gas_alpha)


def flame_temperature_k(fraction: Column) -> Column:
    t = F.lit(T_FLAME_BASE_K) + F.lit(T_FLAME_SLOPE_K) * (fraction - O2_REFERENCE)
    return F.when(
        fraction.isNotNull(), F.greatest(F.lit(T_FLAME_MIN_K), F.least(F.lit(T_FLAME_MAX_K), t))
    )


def thin_spread_rate_mm_s(
    gas_k: Column, t_flame: Column, t_pyrolysis: Column, areal_capacity: Column,
    t_initial: float = T_INITIAL_K,
) -> Column:
    """Closed-form spread rate of a thermally thin fuel."""
    rate = F.try_divide(
        F.lit(2.0**0.5) * gas_k * (t_flame - t_pyrolysis),
        areal_capacity * (t_pyrolysis - t_initial),
    )
    return rate * 1000


def core_heat_sink_ratio(
    core_rho: Column, core_cp: Column, core_mm: Column, rho: Column, cp: Column, outer_mm: Column
) -> Column:
    core_area, fuel_area = core_mm * core_mm, outer_mm * outer_mm - core_mm * core_mm
    return F.try_divide(core_rho * core_cp * core_area, rho * cp * fuel_area)


def core_conductance_ratio(core_k: Column, k: Column) -> Column:
    return F.try_divide(core_k, k)


def mine_notes(note: Column) -> list[Column]:
    """Diluent, radiant flux, initial temperature, orientation and direction from prose."""
    s = F.lower(note)
    gas = (
        F.when(s.rlike(r"\b(he|helium)\b"), "He")
        .when(s.rlike(r"\b(ar|argon)\b"), "Ar")
        .when(s.rlike(r"\bco2\b|carbon dioxide"), "CO2")
        .when(s.rlike(r"\bn2\b|nitrogen"), "N2")
    )
    flux = F.nullif(F.regexp_extract(s, r"(\d+(?:\.\d+)?)\s*kw/m", 1), F.lit(""))
    temperature = F.nullif(F.regexp_extract(s, r"(\d+(?:\.\d+)?)\s*k\b", 1), F.lit(""))
    orientation = F.when(s.contains("vertical"), "vertical").when(
        s.contains("horizontal"), "horizontal"
    )
    direction = (
        F.when(s.contains("opposed") | s.contains("downward"), "opposed")
        .when(s.contains("concurrent") | s.contains("upward"), "concurrent")
    )
    return [
        gas.alias("diluent"),
        flux.try_cast("double").alias("radiant_flux_kw_m2"),
        temperature.try_cast("double").alias("initial_temperature_k"),
        orientation.alias("orientation"),
        direction.alias("spread_direction"),
    ]


def log_scaled(c: Column) -> Column:
    """log1p of a skewed non-negative column, NULL below zero."""
    return F.when(c >= 0, F.log1p(c))
