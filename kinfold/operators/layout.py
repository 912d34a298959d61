"""Page-layout tables: block features, labels, reading order, region matching.

``blocks(doc, page, block_id, x0, y0, x1, y1, text)`` and
``regions(doc, page, region_id, label, score, x0, y0, x1, y1)`` in page units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinfold.functions.text import contains_any, drop_soft_hyphens
from kinfold.plans.ordered import dense_positions

# Patterns, word lists and limits of the block heuristics.
CAPTION = r"(?i)^(fig(?:ure)?|table|tab\.?)[\s.:\-]*\d*"
EQUATION_NUMBER = r"\(\s*\d+\s*\)$"
SECTION_WORD = (
    r"(?i)^(abstract|keywords?|introduction|conclusion(?:s)?|acknowledg(?:e)?ments?|references?)\b"
)
NUMBERED_SECTION = r"^\d+(?:\.\d+)*\.\s*\S+"
PAGE_NUMBER = r"^\d{1,4}$"
HEADER_WORDS = (
    "www.", "proceedings of the", "journal of", "elsevier", "sciencedirect", "vol.", "volume",
    "issue",
)
FOOTNOTE_WORDS = (
    "doi", "copyright", "all rights reserved", "e-mail", "email", "corresponding author",
    "received", "accepted", "available online",
)
FIGURE_WORDS = (
    "figure", "fig.", "diagram", "plot", "graph", "chart", "image", "picture", "schematic",
    "photo", "micrograph",
)
TABLE_WORDS = ("table", "tab.")
METADATA_WORDS = (
    "university", "department", "institute", "center", "centre", "laboratory", "school",
    "college", "nasa", "author", "corresponding",
)
HEADER_MARGIN, FOOTER_MARGIN, WIDE_BLOCK, TOP_BAND = 0.14, 0.15, 0.65, 0.25
MIN_IOU, MIN_OVERLAP = 0.02, 0.20
GRID = 16
BOX = ("x0", "y0", "x1", "y1")
# Up to so many blocks a page is matched without the grid.
PAGE_BLOCKS = 64


def _cells(df: DataFrame, width: float, height: float, p: str = "") -> DataFrame:
    """One row per grid cell a box (its columns begin with ``p``) touches."""
    at = lambda c, size: F.greatest(F.lit(0), F.least(
        F.lit(GRID - 1), F.floor(F.col(c) * GRID / size).cast("int")))
    return df.withColumn(
        "__cx", F.explode(F.sequence(at(f"{p}x0", width), at(f"{p}x1", width)))
    ).withColumn("__cy", F.explode(F.sequence(at(f"{p}y0", height), at(f"{p}y1", height))))


def match_regions(
    blocks: DataFrame, regions: DataFrame, width: float, height: float
) -> DataFrame:
    """Each block with its best region (IoU, then overlap share, then centre inside), if good enough.

    A page of few blocks (``PAGE_BLOCKS``) is matched as a whole, with one row per block and region.  On
    fuller pages the join key is (doc, page, cell) of a grid, because only boxes that share a cell can
    overlap; rows per cell outgrow every size estimate, so that join is told not to broadcast.
    """
    keys = ["doc", "page", "block_id"]
    b = blocks.select(*keys, "x0", "y0", "x1", "y1")
    r = regions.select(
        "doc", "page", "region_id", "label", "score", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    pages = b.groupBy("doc", "page").agg(F.count("*").alias("n"))
    full = pages.where(F.col("n") > PAGE_BLOCKS).drop("n")
    pair = b.join(pages.where(F.col("n") <= PAGE_BLOCKS).drop("n"), ["doc", "page"]).join(r.hint("merge"), ["doc", "page"])
    if not full.isEmpty():
        cell = ["doc", "page", "__cx", "__cy"]
        placed = _cells(r.join(full, ["doc", "page"], "left_semi"), width, height, "r")
        crowded = _cells(b.join(full, ["doc", "page"], "left_semi"), width, height)
        pair = pair.unionByName(crowded.join(placed.hint("merge"), cell).drop("__cx", "__cy"))
    return best_regions(blocks, pair)


def best_regions(blocks: DataFrame, pair: DataFrame) -> DataFrame:
    """Each block with the best of the regions that ``pair`` puts beside it (``rx0`` to ``ry1``), if good enough.

    Pairs of a block follow each other where they are made, so most are settled batch by batch and few are sorted.
    """
    keys = ["doc", "page", "block_id"]
    x, y = ([F.col(f"{c}0"), F.col(f"{c}1")] for c in "xy")
    # all that the JVM does for a pair: a longer test is a method that it doesn't compile
    near = (F.greatest(*x) >= F.col("rx0")) & (F.least(*x) <= F.col("rx1")) & (F.greatest(*y) >= F.col("ry0")) & (F.least(*y) <= F.col("ry1"))
    first = F.coalesce(-F.col("region_id").cast("long"), F.lit(-(1 << 63))).alias("first")
    touching = pair.where(near).select(*keys, *[F.col(p + c).cast("double").alias(p + c) for p in ("", "r") for c in BOX], first, "label", "score")
    kept = [f for f in touching.schema.fields if f.name.removeprefix("r") not in BOX]
    rank = [T.StructField("iou", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("inside", T.IntegerType())]
    best = touching.mapInArrow(_tops, T.StructType(kept + rank)).groupBy(*keys).agg(
        F.max(F.struct(F.struct("iou", "share", "inside", "first").alias("k"), F.col("label"), F.col("score"))).alias("m")
    ).where(
        (F.col("m.k.iou") >= MIN_IOU) | (F.col("m.k.share") >= MIN_OVERLAP)
        | (F.col("m.k.inside") == 1)
    )
    return blocks.join(best, keys, "left").select(
        *blocks.columns, F.col("m.label").alias("region_label"),
        F.col("m.score").alias("region_score"), F.col("m.k.iou").alias("iou"),
    )


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the highest rank (all, if equal) of each run of pairs of one block, with what they rank by."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x0, y0, x1, y1, u0, v0, u1, v1 = (batch.column(p + c).to_numpy() for p in ("", "r") for c in BOX)
        w, h = np.minimum(x1, u1) - np.maximum(x0, u0), np.minimum(y1, v1) - np.maximum(y0, v0)
        inter = np.where((w > 0) & (h > 0), w * h, 0.0)
        area, other = (np.maximum(0.0, b - a) * np.maximum(0.0, d - c) for a, b, c, d in ((x0, x1, y0, y1), (u0, u1, v0, v1)))
        iou, share = (np.divide(inter, x, out=np.zeros(n), where=x != 0) for x in (area + other - inter, area))
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        inside = (cx >= u0) & (cx <= u1) & (cy >= v0) & (cy <= v1)
        new = np.zeros(n, bool)
        new[0] = True
        for name in ("doc", "page", "block_id"):
            c = batch.column(name)
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        keep = (iou > 0) | (share > 0) | inside  # a pair that doesn't touch is below every limit and below every pair that does
        for v in (iou, share, inside.astype("int32"), batch.column("first").to_numpy()):
            v = np.where(keep, v, np.iinfo(v.dtype).min if v.dtype.kind == "i" else -np.inf)
            keep &= v == np.maximum.reduceat(v, starts)[run]
        kept = [name for name in batch.schema.names if name.removeprefix("r") not in BOX]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in kept], pa.array(iou), pa.array(share), pa.array(inside.astype("int32"))],
            names=[*kept, "iou", "share", "inside"]).filter(pa.array(keep))


def _words(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def _count(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def is_table_like(raw: Column) -> Column:
    t = drop_soft_hyphens(raw)
    lines = F.size(F.filter(F.split(raw, "\r\n|\r|\n"), lambda x: F.trim(x) != ""))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    cells = t.contains("|") | (_count(t, ";") >= 2)
    return contains_any(F.lower(t), TABLE_WORDS) | (
        (lines >= 2) & (digits >= 10) & cells & (F.length(t) < 500)
    )


def is_figure_like(raw: Column) -> Column:
    t = drop_soft_hyphens(raw)
    return t.rlike(CAPTION) | (contains_any(F.lower(t), FIGURE_WORDS) & (_words(t) < 80))


def has_equation_number(raw: Column) -> Column:
    return drop_soft_hyphens(raw).rlike(EQUATION_NUMBER)


def fallback_label(raw: Column, width: float, height: float) -> Column:
    """Struct (label, score, method) by the ordered block heuristics, NULL if none holds."""
    t = drop_soft_hyphens(raw)
    low, box_w = F.lower(t), F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))
    top, bottom = F.col("y0") / height, F.col("y1") / height
    header = (top <= HEADER_MARGIN) & (
        t.rlike(PAGE_NUMBER) | contains_any(low, HEADER_WORDS)
        | ((_words(t) <= 14) & (box_w >= 0.25 * width))
    )
    foot = contains_any(low, FOOTNOTE_WORDS) | (
        (bottom >= 1.0 - FOOTER_MARGIN) & (_words(t) <= 40)
    )
    names = F.filter(
        F.split(F.translate(t, "∗†", "  "), r"\s+"), lambda w: w != ""
    )
    capital = F.size(F.filter(names, lambda w: w.rlike(r"^\p{Lu}")))
    author = (
        (F.col("y0") <= 0.40 * height) & (box_w >= 0.45 * width)
        & ~contains_any(low, METADATA_WORDS) & F.size(names).between(6, 40)
        & (_count(t, ",") >= 2) & (capital >= 4)
    )
    section = low.rlike(SECTION_WORD) | t.rlike(NUMBERED_SECTION)
    meta = (F.col("y0") <= 0.42 * height) & contains_any(low, METADATA_WORDS)
    out = F.when(t == "", F.lit(None))
    for hit, label, score, method in (
        (t.rlike(CAPTION), "Caption", 0.9, "heuristic-caption"),
        (header, "Page-header", 0.8, "heuristic-header"),
        (foot, "Footnote", 0.78, "heuristic-footnote"),
        (author, "Text", 0.56, "heuristic-author"),
        (section, "Section-header", 0.75, "heuristic-section-header"),
        (meta, "Text", 0.58, "heuristic-metadata"),
        (is_table_like(t), "Text", 0.45, "heuristic-table-candidate"),
        (is_figure_like(t), "Text", 0.4, "heuristic-figure-candidate"),
    ):
        out = out.when(hit, F.struct(
            F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(method).alias("method")
        ))
    return out


def reading_order(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """0-based ``reading_pos``: top band row-wise, full-width blocks, then left and right column."""
    band = max(4.0, min(8.0, width * 0.012))
    top = F.col("y0") < height * TOP_BAND
    wide = (F.col("x1") - F.col("x0")) >= width * WIDE_BLOCK
    column = F.when((F.col("x0") + F.col("x1")) / 2 <= width / 2, 0).otherwise(1)
    keyed = blocks.select(
        "doc", "page", "block_id",
        F.when(top, 0).when(wide, 1).otherwise(2).alias("zone"),
        F.when(top, F.floor(F.col("y0") / band).cast("int")).when(wide, 0).otherwise(column).alias("k1"),
        F.when(top, F.col("x0")).otherwise(F.col("y0")).alias("k2"),
        F.when(top, F.col("y0")).otherwise(F.col("x0")).alias("k3"),
    )
    # coarse key that rises with (zone, k1, k2): a page is cut into these strips
    strip = F.col("zone") * 4096 + F.when(
        F.col("zone") == 0, F.greatest(F.lit(0), F.least(F.col("k1"), F.lit(1023)))
    ).otherwise(
        F.col("k1") * 1024 + F.greatest(F.lit(0), F.least(F.floor(F.col("k2") / 16), F.lit(1023)))
    )
    pos = dense_positions(keyed, ["zone", "k1", "k2", "k3", "block_id"], ["doc", "page"], strip)
    return blocks.join(
        pos.select("doc", "page", "block_id", F.col("pos").alias("reading_pos")),
        ["doc", "page", "block_id"],
    )


def merge_formula_blocks(blocks: DataFrame, width: float) -> DataFrame:
    """Join a formula block with the equation number that follows it in reading order.

    The merged text ends in a number, so it can never absorb another block: each
    merge is between exactly two neighbours, found by an equi-join on position.
    """
    gap = max(6.0, width * 0.015)
    cols = ["x0", "y0", "x1", "y1", "text", "region_label", "region_score"]
    nxt = blocks.select(
        "doc", "page", (F.col("reading_pos") - 1).alias("reading_pos"),
        *[F.col(c).alias(f"n_{c}") for c in cols],
    )
    prv = blocks.select(
        "doc", "page", (F.col("reading_pos") + 1).alias("reading_pos"),
        *[F.col(c).alias(f"p_{c}") for c in cols],
    )

    def joins(a: str, b: str) -> Column:
        shared = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(
            F.col(f"{a}x0"), F.col(f"{b}x0"))
        narrow = F.least(F.col(f"{a}x1") - F.col(f"{a}x0"), F.col(f"{b}x1") - F.col(f"{b}x0"))
        ok = (
            (F.col(f"{a}region_label") == "Formula") & (F.col(f"{b}region_label") == "Formula")
            & ~has_equation_number(F.col(f"{a}text")) & has_equation_number(F.col(f"{b}text"))
            & (narrow > 0) & (F.try_divide(F.greatest(F.lit(0.0), shared), narrow) >= 0.15)
            & (F.col(f"{b}y0") - F.col(f"{a}y1") <= gap)
        )
        return F.coalesce(ok, F.lit(False))

    keys = ["doc", "page", "reading_pos"]
    j = blocks.join(nxt, keys, "left").join(prv, keys, "left")
    j = j.withColumn("__take", joins("", "n_")).withColumn("__gone", joins("p_", ""))
    pick = lambda c, f: F.when(F.col("__take"), f(c, f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.where(~F.col("__gone")).select(
        "doc", "page", "block_id", "reading_pos",
        pick("x0", F.least), pick("y0", F.least), pick("x1", F.greatest), pick("y1", F.greatest),
        F.when(F.col("__take"), F.concat_ws("\n", "text", "n_text")).otherwise(F.col("text")).alias("text"),
        "region_label", pick("region_score", F.greatest), F.col("__take").alias("merged"),
    )


def block_features(spans: DataFrame) -> DataFrame:
    """Dominant font (first seen on a tie), mean size, bold and italic votes per block."""
    keys = ["doc", "page", "block_id"]
    s = spans.where(F.col("text") != "")
    font = F.lower("font")
    bold = font.contains("bold") | (F.col("flags").bitwiseAND(16) != 0)
    italic = font.contains("italic") | font.contains("oblique") | (F.col("flags").bitwiseAND(2) != 0)
    named = F.when(F.trim("font") != "", F.trim("font"))
    per_font = s.groupBy(*keys, named.alias("font")).agg(
        F.count("*").alias("n"), F.min("span_id").alias("first"), F.sum("size").alias("sz"),
        F.count("size").alias("n_sz"), F.sum(bold.cast("int")).alias("b"),
        F.sum(italic.cast("int")).alias("i"),
    )
    any_font = F.max(F.col("font").isNotNull().cast("int")) == 1
    return per_font.groupBy(*keys).agg(
        F.max_by("font", F.when(F.col("font").isNotNull(), F.struct(F.col("n"), -F.col("first")))).alias("font_name"),
        F.try_divide(F.sum("sz"), F.sum("n_sz")).alias("font_size"),
        F.when(any_font, F.sum("b") > 0).alias("is_bold"),
        F.when(any_font, F.sum("i") > 0).alias("is_italic"),
    )
