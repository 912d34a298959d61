"""Markdown corpus -> selected excerpts -> prompts, and model answers -> rows.

One document is one row of text; everything is a Column expression or a window
over the lines of a document (a line set is never larger than its text cell).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kinfold.functions.categories import EXTRACTED_FACILITY, EXTRACTED_GEOMETRY, canonical
from kinfold.functions.identity import doi_address
from kinfold.functions.numeric import NO_OUTCOME, YES_OUTCOME
from kinfold.functions.text import (
    MISSING_FIELDS, SPACE_CHARS, contains_any, count_hits, first_or_null, let, normalize_text, starts_with_any,
)

# Section, keyword and phrase lists of the excerpt selection.
SETUP_SECTIONS = (
    r"\bexperimental\b|\bmethods?\b|\bmaterials?\b|\bapparatus\b|\bsetup\b|\btest(s)?\b"
    r"|\bfacilit(y|ies)\b|\bmicrogravity\b|\bparabolic flight\b|\bdrop tower\b"
)
NON_SETUP_SECTIONS = (
    "nomenclature", "references", "acknowledgements", "acknowledgments", "conclusions",
    "conclusion", "numerical model", "modeling", "model development", "theory", "theoretical",
    "results", "discussion", "results and discussion",
)
SETUP_WORDS = (
    "pmma", "poly(methyl methacrylate)", "poly(methyl-methacrylate)", "ldpe",
    "low density polyethylene", "polyethylene", "etfe", "tefzel", "insulated wire", "insulation",
    "copper core", "nickel chromium", "nicr",
    "rod", "rods", "cylinder", "cylinders", "cylindrical", "wire", "wires", "cable", "cables",
    "sheet", "strip", "sample", "samples", "diameter", "radius", "length", "thickness", "mm", "cm",
    "m ",
    "microgravity", "normal gravity", "1 g", "1g", "reduced gravity", "parabolic flight",
    "drop tower", "iss", "international space station", "bass-ii", "msg", "spacecraft",
    "ventilation", "duct", "tunnel", "chamber", "pressure", "kpa", "pa",
    "opposed flow", "upward flow", "flow velocity", "velocity", "cm/s", "mm/s", "m/s", "flow rate",
    "oxidizer", "air flow", "oxygen", "o2", "x o2", "mole fraction",
    "radiant flux", "external radiation", "heat flux", "kw/m2", "kw m-2", "kW/m",
    "ignition", "igniter", "hot-wire", "methane flame", "ceramic heater", "halogen lamp",
    "experiment", "experiments", "tested", "under the same conditions",
)
CAPTION_STARTS = ("![figure", "![fig.", "fig. ", "figure ", "fig ")
MEASUREMENT = r"\b\d+(?:\.\d+)?\s*(?:%|kpa|pa|atm|mm|cm|m|mm/s|cm/s|m/s|w|kw|kw/m2|kw m-2|s)\b"
BACKGROUND_PHRASES = (
    "fire safety is a concern", "important concern", "future spacecraft",
    "insufficient knowledge", "has been studied", "in this paper",
)
CONDITION_WORDS = ("condition", "conditions", "under", "ranging", "varied")
OUTCOME_WORDS = ("ignition", "extinction", "flame spread", "fsr")
MAX_KEYWORD_SCORE, MAX_MEASURE_SCORE = 6, 3
SCORE_IN_SECTION, SCORE_ELSEWHERE = 3, 5
TRUNCATION_MARK = "\n\n[TRUNCATED]\n"
# Fields of an extracted row and of its duplicate key.
ROW_FIELDS = (
    "article_mla", "authors", "doi", "geometry_of_sample", "dimensions_of_sample",
    "material_of_sample", "oxygen_concentration", "pressure", "flow_velocity", "gravity_gearth",
    "experimental_facility", "ignition_method", "ignition_power", "ignition_time",
    "chamber_diameter", "ignition_extinction", "fsr", "hrr", "smoke_aerosols",
    "experiment_label", "notes",
)
ROW_KEY = (
    "geometry_of_sample", "dimensions_of_sample", "material_of_sample", "oxygen_concentration",
    "pressure", "flow_velocity", "gravity_gearth", "experimental_facility", "ignition_method",
    "ignition_power", "ignition_time", "chamber_diameter",
)
# all fields arrive as text (JSON scalars of any kind), typed afterwards
LOOSE_ROW = T.StructType([T.StructField(f, T.StringType()) for f in ROW_FIELDS])


def clean_markdown(c: Column) -> Column:
    """No NUL, ``\\n`` line ends, no trailing blanks, at most one empty line in a row."""
    s = F.regexp_replace(F.regexp_replace(c, "\x00", ""), "\r\n?", "\n")
    s = F.regexp_replace(s, r"[ \t\x0b\f ]+(?=\n|$)", "")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def with_provenance(markdown: Column, source: Column, stamp: Column | None = None) -> Column:
    when = F.current_timestamp() if stamp is None else stamp
    utc = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.concat(
        F.lit("# Parsed PDF Context\n\n- Source PDF: "), source, F.lit("\n- Parsed UTC: "), utc,
        F.lit("\n\n"), markdown,
    )


def truncate_context(c: Column, max_chars: int) -> Column:
    full = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(
        F.length(full) > max_chars, F.concat(F.substring(full, 1, max_chars), F.lit(TRUNCATION_MARK))
    ).otherwise(full)


def document_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line): 0-based lines of every document."""
    return df.select(doc, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("pos", "line"))


def heading(line: Column) -> Column:
    """Text of a level-2-or-deeper heading, else NULL."""
    return F.nullif(F.regexp_extract(line, r"^\s*##+\s+(.*?)\s*$", 1), F.lit(""))


def is_caption(line: Column) -> Column:
    return starts_with_any(F.lower(F.ltrim(line)), CAPTION_STARTS)


def is_non_setup_section(section: Column) -> Column:
    hit = starts_with_any(F.lower(F.trim(section)), NON_SETUP_SECTIONS)
    return F.coalesce(hit, F.lit(False))


def is_setup_paragraph(text: Column, section: Column) -> Column:
    """Score keyword, measurement and section evidence against the fixed limits."""
    boost = F.coalesce(F.lower(section).rlike(SETUP_SECTIONS), F.lit(False))

    def evidence(s: Column) -> Column:
        return F.struct(
            s.alias("s"), count_hits(s, SETUP_WORDS).alias("words"),
            F.size(F.regexp_extract_all(s, F.lit(MEASUREMENT), F.lit(0))).alias("measures"),
            contains_any(s, OUTCOME_WORDS).alias("outcome"), boost.alias("boost"),
        )

    def decide(e: Column) -> Column:
        s, words, measures = e["s"], e["words"], e["measures"]
        background = (measures == 0) & (words < 4) & contains_any(s, BACKGROUND_PHRASES)
        score = (
            F.least(words, F.lit(MAX_KEYWORD_SCORE)) + F.least(measures, F.lit(MAX_MEASURE_SCORE))
            + F.when(e["boost"], 2).otherwise(0) + contains_any(s, CONDITION_WORDS).cast("int")
            + e["outcome"].cast("int")
        )
        skipped = (
            s.startswith("references") | s.startswith("## references") | s.rlike(r"^\[\d+\]\s")
            | background
        )
        enough = F.when(e["boost"], score >= SCORE_IN_SECTION).otherwise(
            (score >= SCORE_ELSEWHERE) & ((measures > 0) | e["outcome"])
        )
        return ~skipped & enough & (s != "")

    return F.when(is_non_setup_section(section), F.lit(False)).otherwise(
        let(let(F.lower(text), evidence), decide)
    )


def paragraph_chunks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Paragraphs with their section and line span, classed and numbered by line.

    A blank line or a heading ends a paragraph; image markers are skipped without
    ending it; the section is the last heading above.  A document is cut inside its row, first at
    its headings, then at blank lines, so nothing is shuffled.
    """
    head = lambda x: heading(x["line"])
    image = lambda x: F.ltrim(x["line"]).startswith("<!-- image")
    blank = lambda x: (F.trim(F.regexp_replace(x["line"], r"(?U)\s", "")) == "") & ~image(x)
    numbered = F.transform(F.split(F.col(text), "\r\n|\r|\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))

    def between(array: str, stops: Column, end: Column) -> Column:
        """Rows (at, next, inside): what lies in ``array`` after each of ``stops`` up to the next one, first from before all."""
        edges = F.concat(F.array(F.get(array, F.lit(0))["pos"] - 1), stops, F.array(end))
        return let(edges, lambda e: F.transform(F.slice(e, 1, F.size(e) - 1), lambda at, i: F.struct(
            at.alias("at"), F.get(e, i + 1).alias("next"),
            F.slice(array, at - F.get(e, F.lit(0)) + 1, F.get(e, i + 1) - at - 1).alias("inside"))))

    stops_of = lambda rule: F.transform(F.filter("lines", rule), lambda x: x["pos"])
    docs = df.select(doc, numbered.alias("lines")).withColumn(
        "marks", stops_of(lambda x: head(x).isNotNull() & ~image(x)))
    parts = docs.select(doc, F.col("lines"), F.explode(between("lines", F.col("marks"), F.size("lines"))).alias("s")).select(
        doc, head(F.get("lines", F.greatest(F.col("s.at"), F.lit(0)))).alias("first"), "s.at", "s.next", F.col("s.inside").alias("lines"))
    parts = parts.where(F.size("lines") > 0).select(
        doc, F.when(F.col("at") >= 0, F.col("first")).alias("section"), "next", "lines",
        stops_of(blank).alias("marks"))
    paragraphs = parts.select(doc, "section", F.explode(between("lines", F.col("marks"), F.col("next"))).alias("p")).select(
        doc, "section", F.col("p.next").alias("line_end"), F.filter("p.inside", lambda x: ~image(x)).alias("body"))
    joined = F.array_join(F.transform("body", lambda b: b["line"]), "\n")
    chunks = paragraphs.where(F.size("body") > 0).select(
        doc, "section", (F.get("body", F.lit(0))["pos"] + 1).alias("line_start"), "line_end",
        normalize_text(joined).alias("text"), F.get("body", F.lit(0))["line"].alias("first_line"),
    ).where(F.col("text") != "")
    kind = (
        F.when(is_caption(F.col("first_line")), "caption_context")
        .when(is_setup_paragraph(F.col("text"), F.col("section")), "setup_paragraph")
        .otherwise("other_paragraph")
    )
    return chunks.select(doc, kind.alias("type"), "section", "line_start", "line_end", "text")


def unique_chunks(chunks: DataFrame, doc: str) -> DataFrame:
    """First chunk (by line) of every (type, section, text) in a document; copies combine early."""
    keys = [doc, "type", "section", "text"]
    return chunks.groupBy(*keys).agg(
        F.min(F.struct("line_start", "line_end")).alias("s")
    ).select(doc, "type", "section", F.col("s.line_start").alias("line_start"),
             F.col("s.line_end").alias("line_end"), "text")


def selected_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("type").isin("setup_paragraph", "caption_context"))


def render_excerpts(
    chunks: DataFrame, doc: str, sources: DataFrame, max_excerpts: int = 80
) -> DataFrame:
    """(doc, markdown): the first ``max_excerpts`` selected chunks of each document as text.

    The excerpt limit is the feature; ``sources`` has one row (doc, source) per
    document, so documents without any selected chunk render too.
    """
    nth = Window.partitionBy(doc).orderBy("line_start")
    top = selected_chunks(chunks).withColumn("i", F.row_number().over(nth)).where(
        F.col("i") <= max_excerpts
    )
    item = F.concat(
        F.lit("## Excerpt "), F.col("i").cast("string"), F.lit("\n\n- Type: "), F.col("type"),
        F.lit("\n- Section: "), F.coalesce("section", F.lit("N/A")), F.lit("\n- Lines: "),
        F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"),
        F.lit("\n\n"), F.col("text"), F.lit("\n"),
    )
    per = top.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("i", item.alias("md")))).alias("items")
    )
    n = F.coalesce(F.size("items"), F.lit(0))
    body = F.coalesce(F.array_join(F.transform("items", lambda x: x["md"]), "\n"), F.lit(""))
    md = F.concat(
        F.lit("# Extracted Experimental Context\n\nSource markdown: "), F.col("source"),
        F.lit("\nTotal selected excerpts: "), F.when(n > 0, n).otherwise(0).cast("string"),
        F.lit("\n\n"), body,
    )
    return sources.join(per, doc, "left").select(
        doc, F.concat(F.rtrim(F.regexp_replace(md, r"\s+$", "")), F.lit("\n")).alias("markdown")
    )


def assemble_prompt(context: Column, label: Column, template: tuple[str, str, str]) -> Column:
    """Prompt column: the template's three parts around the label and the context."""
    head, middle, tail = template
    return F.concat(F.lit(head), label, F.lit(middle), context, F.lit(tail))


def lenient_json(c: Column) -> Column:
    """The first reading that is valid JSON: whole text, fenced block, first ``{`` to last ``}``."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    fenced = first_or_null(s, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    span = first_or_null(s, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(s), valid(fenced), valid(span))


def sanitize_gravity(rows: Column) -> Column:
    """Payload rows with the gravity text replaced by its first number."""
    number = lambda t: first_or_null(t, r"-?\d+(?:\.\d+)?").try_cast("double")
    return F.transform(rows, lambda r: r.withField("gravity_gearth", number(r["gravity_gearth"])))


def field_text(c: Column) -> Column:
    """White space squeezed to single spaces; NULL if nothing or a placeholder is left."""
    blanks = "".join(x for x in SPACE_CHARS if x not in "\x1c\x1d\x1e\x1f")
    flat = F.trim(F.translate(c, blanks, " " * len(blanks)))
    one = F.when(flat.contains("  "), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    return let(one, lambda s: F.when(~F.lower(s).isin(*MISSING_FIELDS), s))


def outcome_word(c: Column) -> Column:
    s = F.lower(c)
    return F.when(s.isin(*YES_OUTCOME), "Yes").when(s.isin(*NO_OUTCOME), "No")


def normalize_rows(df: DataFrame, keep: Sequence[str], geometry=EXTRACTED_GEOMETRY) -> DataFrame:
    """Typed, canonical extracted rows from loosely typed ones (all fields text)."""
    # by themselves first: most fields are read several times below
    df = df.select(*keep, *[field_text(F.col(f)).alias(f) for f in ROW_FIELDS])
    cols = {f: F.col(f) for f in ROW_FIELDS}
    cols["geometry_of_sample"] = canonical(
        cols["geometry_of_sample"], geometry, cols["geometry_of_sample"]
    )
    cols["experimental_facility"] = canonical(
        cols["experimental_facility"], EXTRACTED_FACILITY,
        F.when(cols["experimental_facility"].isin(
            "Parabolic Aircraft", "Drop Tower", "Spacecraft", "Sounding Rocket"
        ), cols["experimental_facility"]),
    )
    cols["doi"] = doi_address(cols["doi"])
    cols["gravity_gearth"] = first_or_null(
        cols["gravity_gearth"], r"-?\d+(?:\.\d+)?"
    ).try_cast("double")
    for f in ("ignition_extinction", "smoke_aerosols"):
        cols[f] = outcome_word(cols[f])
    return df.select(*keep, *[c.alias(f) for f, c in cols.items()])


def unique_rows(df: DataFrame, source: str, order: str) -> DataFrame:
    """First row of each 12-field key per source; copies combine before the shuffle."""
    keys = [source, *ROW_KEY]
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return kept.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
