"""Canonical identifiers of a cluster (DOI, citation, short label)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinfold.functions.text import clean_cell, first_or_null, squeeze


def canonical_doi(c: Column) -> Column:
    """Bare lower-case DOI: resolver address, ``doi:`` and trailing ``/. `` removed."""
    s = F.lower(clean_cell(c))
    s = F.regexp_replace(s, r"^https?://(dx\.)?doi\.org/", "")
    s = F.regexp_replace(s, r"^doi:\s*", "")
    return F.nullif(F.rtrim(s, F.lit("/. ")), F.lit(""))


def doi_address(c: Column) -> Column:
    """DOI as a resolver address where the text is recognisably one, else unchanged."""
    bare = F.when(F.lower(c).startswith("doi:"), F.trim(F.substr(c, F.lit(5)))).otherwise(c)
    return (
        F.when(c.startswith("https://doi.org/"), c)
        .when(c.startswith("http://doi.org/"), F.concat(F.lit("https://"), F.substr(c, F.lit(8))))
        .when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.concat(F.lit("https://doi.org/"), bare))
        .otherwise(bare)
    )


def canonical_citation(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    s = F.regexp_replace(F.lower(clean_cell(c)), "[^a-z0-9 ]+", " ")
    return F.nullif(squeeze(s), F.lit(""))


def entity_id(doi: Column, citation: Column) -> Column:
    """Canonical DOI, else ``article::`` and the canonical citation.

    A row with neither gets ``article::nan``, so such rows form one cluster.
    """
    return F.coalesce(canonical_doi(doi), cited_entity(citation))


def cited_entity(citation: Column) -> Column:
    """The id of a row that has no DOI."""
    return F.concat(F.lit("article::"), F.coalesce(canonical_citation(citation), F.lit("nan")))


def label_head(c: Column) -> Column:
    """``Surname 2019`` of a citation."""
    first = F.substring(F.trim(F.element_at(F.split(c, "[,.]"), 1)), 1, 18)
    found = first_or_null(c, r"\((\d{4})\)|\b(?:19|20)\d{2}\b")
    year = F.coalesce(F.translate(found, "()", ""), F.lit("????"))
    return F.concat(first, F.lit(" "), year)


def label_with_tail(head: Column, entity: Column) -> Column:
    return F.concat(head, F.lit(" ["), F.right(entity, F.lit(12)), F.lit("]"))


def short_label(citation: Column, entity: Column) -> Column:
    """``Surname 2019 [tail of the id]`` for reports."""
    return label_with_tail(label_head(F.coalesce(citation, entity)), entity)


def numbered_label(code: Column, name: Column) -> Column:
    """``P07 Surname`` from a 1-based code and a citation."""
    first = F.substring(F.trim(F.element_at(F.split(name, ","), 1)), 1, 18)
    return F.concat(F.format_string("P%02d ", code), first)
