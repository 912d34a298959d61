"""Text cleaning as Column expressions (no Python runs per row)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# Cell contents that mean "missing".
MISSING_CELLS = ("", "-", "n/a", "na", "nan", "none")
# Placeholders in extracted rows.
MISSING_FIELDS = (
    "", "n/a", "na", "none", "null", "unknown", "not provided", "not available", "not stated",
    "...",
)
#: Every named character reference, from the standard library's table.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
#: Names that also count without a semicolon, the longest first.
BARE = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)
#: References to 128-159 mean the characters of Windows-1252 where it has one.
C1 = "".join(map(chr, range(128, 160)))
C1_MEANT = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c for c in C1)
# Every character that counts as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A Column used several times is copied into every use, and nested copies
    multiply; a one-element ``transform`` binds it to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """Every whitespace run (also NBSP) becomes one space; ends are trimmed.

    The regular expression only runs on the rare cells that hold a run.
    """
    return let(
        F.trim(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS))),
        lambda s: F.when(s.contains("  "), F.regexp_replace(s, " +", " ")).otherwise(s),
    )


def clean_cell(c: Column, missing: tuple[str, ...] = MISSING_CELLS) -> Column:
    return let(squeeze(c), lambda s: F.when(~F.lower(s).isin(*missing), s))


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))


def _character(code: Column) -> Column:
    """The character that a numeric reference means: '' for control codes and noncharacters."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    unknown = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    nothing = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when(unknown, F.lit("�")).when(nothing, F.lit(""))
        .otherwise(F.translate(char, C1, C1_MEANT))
    )


def _reference(p: Column) -> Column:
    """What the text ``p`` after an ampersand becomes; no reference keeps the ampersand."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # folded to one literal
    number = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"

    def code(digits: Column, base: int) -> Column:
        return F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
            F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint"))

    numeric = F.concat(
        _character_of(F.when(
            p.rlike("^#[0-9]"), code(F.regexp_extract(p, "^#0*([0-9]*)", 1), 10)
        ).otherwise(code(F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]*)", 1), 16))),
        F.regexp_replace(p, number, ""),
    )
    name = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]{0,31});", 1)
    bare = F.regexp_extract(p, f"^(?:{'|'.join(BARE)})", 0)
    full = F.concat(F.element_at(named, name), F.substring(p, F.length(name) + 2, F.length(p)))
    short = F.concat(F.element_at(named, bare), F.substring(p, F.length(bare) + 1, F.length(p)))
    return F.when(p.rlike(number), numeric).otherwise(
        F.coalesce(full, short, F.concat(F.lit("&"), p)))


def _character_of(code: Column) -> Column:
    return let(code, _character)


def decode_entities(c: Column) -> Column:
    """HTML character references, named and numeric, decoded in one pass as browsers do."""
    def decode(s: Column) -> Column:
        parts = F.split(s, "&", -1)
        later = F.transform(F.slice(parts, 2, F.size(parts)), _reference)
        return F.concat(F.element_at(parts, 1), F.array_join(later, ""))

    return let(c, lambda s: F.when(s.contains("&"), decode(s)).otherwise(s))


def normalize_text(c: Column) -> Column:
    return squeeze(decode_entities(c))


def drop_soft_hyphens(c: Column) -> Column:
    return squeeze(F.replace(c, F.lit("­"), F.lit("")))


def contains_any(c: Column, words) -> Column:
    """Substring test against a fixed word list, one generated disjunction."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def count_hits(c: Column, words) -> Column:
    """How many words of the list occur in the text."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.size(F.filter(listed, lambda w: F.contains(c, w)))


def starts_with_any(c: Column, prefixes) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def first_or_null(c: Column, pattern: str, group: int = 0) -> Column:
    """``regexp_extract`` that is NULL, not '', when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
