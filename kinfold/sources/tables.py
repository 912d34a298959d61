"""CSV scan with a banner row, header repair and column resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Logical column -> physical header of the experiment table.
EXPERIMENT_COLUMNS = {
    "article": "Article (MLA)",
    "authors": "Authors",
    "doi": "DOI",
    "geometry": "Geometry of Sample (flat, wire, or Cylindrical)",
    "dimensions": (
        "Dimensions of sample (Wire is in diameter, Cylindrical is in length x radius x "
        "thickness, Rectangle is in length x width x height, Shperical)"
    ),
    "material": "Material of sample",
    "o2": "Oxygen Concentration",
    "pressure": "Pressure",
    "flow": "Flow Velocity (Co flow is + and counter flow is -)",
    "rig": "Rig Name",
    "internal_geom": "Internal geometry (Cylindrical , rectangular)",
    "internal_dims": "Internal Dimensions",
    "gravity": "Gravity (g/gearth)",
    "facility": (
        "Expireimental facility (Parabolic Aircraft, Drop Tower, Spacecraft, "
        "Sounding Rocket, Ground)"
    ),
    "ig_method": "Ignition method (Wire, open flame, or Radiative Heater",
    "ig_power": "Ignition power (W)",
    "ig_time": "Ignition time (s)",
    "ignition": "Ignition (Yes/No)",
}
EXPERIMENT_FALLBACKS = {"article": ("article (mla)", "article"), "authors": ("authors",)}
# the five bytes windows-1252 leaves undefined, and the others of the 0x80-0x9f block
_C1 = [chr(i) for i in range(0x80, 0xA0)]
_C1_MEANING = [c.encode("latin-1").decode("cp1252", errors="ignore") for c in _C1]
UNDEFINED_CP1252 = "[" + "".join(c for c, m in zip(_C1, _C1_MEANING) if not m) + "]"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8, else windows-1252, else latin-1; bytes are tested line by line on the executors."""
    raw = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="", header=False)
    line = F.col(raw.columns[0])
    test = raw.agg(
        F.bool_and(F.is_valid_utf8(F.encode(line, "ISO-8859-1"))).alias("utf8"),
        F.bool_or(line.rlike(UNDEFINED_CP1252)).alias("not_cp1252"),
    ).first()
    if test["utf8"] is None or test["utf8"]:
        return "UTF-8"
    return "ISO-8859-1" if test["not_cp1252"] else "windows-1252"


def read_banner_csv(
    spark: SparkSession, path: str, encoding: str | None = None, splittable: bool = False,
) -> DataFrame:
    """CSV whose first line is a banner and whose second line is the header; all text.

    Every file of ``path`` may repeat both lines.  Quoted cells may hold line breaks; a caller who
    knows that none does can ask for files to be read in splits.
    """
    encoding = encoding or detect_encoding(spark, path)
    # Spark reads no windows-1252: read one byte per character, then translate its own block
    western = encoding == "windows-1252"
    opts = dict(encoding="ISO-8859-1" if western else encoding, quote='"', escape='"', multiLine=not splittable)
    two = spark.read.options(**opts).csv(path, header=False).head(2)
    names = unique_names([str(v) if v is not None else None for v in two[1]])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = spark.read.options(**opts, enforceSchema=True).schema(schema).csv(path, header=True)
    first, header = names[0], two[1][0]
    rows = body.where(~F.col(f"`{first}`").eqNullSafe(F.lit(header)))
    if not western:
        return rows
    known = [(c, m) for c, m in zip(_C1, _C1_MEANING) if m]
    source, target = "".join(c for c, _ in known), "".join(m for _, m in known)
    return rows.select(*[F.translate(f"`{n}`", source, target).alias(n) for n in names])


def unique_names(names: Sequence[str | None]) -> list[str]:
    """Stripped names; empty ones ``Unnamed_i``, repeats get ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"Unnamed_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def flatten_two_level(top: Sequence[str | None], low: Sequence[str | None]) -> list[str]:
    """Field name if present, else the section banner above it, made unique."""
    ok = lambda s: bool(s and s.strip()) and not s.strip().lower().startswith("unnamed")
    return unique_names([b if ok(b) else (a if ok(a) else None) for a, b in zip(top, low)])


def normalise_header(df: DataFrame) -> DataFrame:
    """Strip names, drop ``Unnamed*``, repeated and all-null columns (one counting pass)."""
    stripped, seen, keep = [c.strip() for c in df.columns], set(), []
    for i, c in enumerate(stripped):
        if not c.startswith("Unnamed") and c not in seen:
            seen.add(c)
            keep.append(i)
    renamed = df.toDF(*[f"__{i}" for i in range(len(stripped))]).select(
        *[F.col(f"__{i}").alias(stripped[i]) for i in keep]
    )
    counts = renamed.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(renamed.columns)])
    filled = counts.first()
    return renamed.select(*[f"`{c}`" for i, c in enumerate(renamed.columns) if filled[i] > 0])


def resolve_columns(
    columns: Sequence[str], wanted: Mapping[str, str] = EXPERIMENT_COLUMNS,
    fallbacks: Mapping[str, Sequence[str]] = EXPERIMENT_FALLBACKS,
) -> dict[str, str]:
    """Logical key -> physical header: exact, fallback name, then unique prefix before ``(``."""
    by_lower = {c.lower().strip(): c for c in columns}
    found = {}
    for key, name in wanted.items():
        prefix = name.split("(")[0].strip().lower()
        hits = [c for c in columns if c.lower().startswith(prefix)]
        alias = next((by_lower[f] for f in fallbacks.get(key, ()) if f in by_lower), None)
        if name in columns:
            found[key] = name
        elif alias is not None:
            found[key] = alias
        elif len(hits) == 1:
            found[key] = hits[0]
        else:
            raise KeyError(f"cannot resolve column {key!r} (wanted {name!r})")
    return found


def select_logical(df: DataFrame, wanted: Mapping[str, str] = EXPERIMENT_COLUMNS) -> DataFrame:
    found = resolve_columns(df.columns, wanted)
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items()])
