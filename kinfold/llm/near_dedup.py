"""Operator 1: near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U
from kinfold.llm.common import components, free_name, spread_join, stored, to_batch
from kinfold.llm.minhash import link, pack_set, superminhash, unpack_sets

SLOTS, BAND = 126, 3
PERCENT = 75
#: 4.4 standard errors of a 126-slot estimate below 0.75.
LEAST = 0.58
SIGNED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("sig", pa.binary())])
LOADED = pa.schema([("key", pa.int64()), ("payload", pa.binary())])


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the distinct word shingles of every row, sorted; elements have 48 bits.

    A row with fewer words than ``size`` has one element, its whole sequence.
    """
    starts, ends, rows = A.spans(data, off, A.NOT_SPACE)
    h = A.span_hash(A.prefix(data, A.VALUES_LOWER), starts, ends)
    n_words = np.bincount(rows, minlength=len(off) - 1)
    at, s = A.windows(h, rows, size)
    r = rows[at]
    first = np.cumsum(n_words) - n_words
    for n in range(1, size):
        short = np.flatnonzero(n_words == n)
        if len(short):
            pos = first[short]
            r = np.concatenate([r, short])
            x = h[pos] * A._STEP[0]
            for i in range(1, n):
                x += h[pos + i] * A._STEP[i]
            s = np.concatenate([s, A.mix(x + U(n))])
    packed = np.unique((r.astype(U) << U(48)) | (s >> U(16)))
    return (packed >> U(48)).astype(np.int64), packed << U(16)


def _set_keys(rows: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for every set: the mixed sum of its mixed elements and its size."""
    x = A.mix(elements + U(0x5851F42D4C957F2D))
    total = np.zeros(n + 1, U)
    edge = np.searchsorted(rows, np.arange(n + 1))
    c = np.concatenate([np.zeros(1, U), np.cumsum(x)])
    total = c[edge[1:]] - c[edge[:-1]]
    return A.mix(total + np.diff(edge).astype(U)).view(np.int64)


def _sign(size: int, batches):
    for batch in batches:
        ids, ties = batch.column(0), batch.column(1)
        for lo, hi, data, off in A.chunks(batch.column(2)):
            rows, el = shingles(data, off, size)
            n = hi - lo
            count = np.bincount(rows, minlength=n)
            sig = superminhash(rows, el, n, SLOTS)
            raw = [sig[i].tobytes() if count[i] else None for i in range(n)]
            yield to_batch(SIGNED, ids.slice(lo, n), ties.slice(lo, n), count, _set_keys(rows, el, n), raw)


def _load(size: int, batches):
    """(key, packed set), each set once for a task's batch."""
    for batch in batches:
        for lo, hi, data, off in A.chunks(batch.column(1)):
            rows, el = shingles(data, off, size)
            n = hi - lo
            keys = _set_keys(rows, el, n)
            edge = np.searchsorted(rows, np.arange(n + 1))
            once = [i for i in np.unique(keys, return_index=True)[1] if edge[i + 1] > edge[i]]
            yield to_batch(LOADED, keys[once], [pack_set(el[edge[i]:edge[i + 1]]) for i in once])


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, tie, n_shingles, comp, component_id) of every row; ``tie`` is a hash of the text, and
    ``comp`` is null where there is no shingle."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    signed = stored(rows.mapInArrow(
        partial(_sign, size), "doc_id long, tie long, n_shingles long, key long, sig binary"), "signed")
    sets = signed.where("n_shingles > 0")
    nodes = stored(sets.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "nodes")
    comp = link(nodes, rows.select("doc_id", "text").mapInArrow(partial(_load, size), "key long, payload binary"),
                unpack_sets, percent, BAND, LEAST)
    named = stored(nodes.select("key", "doc_id").join(comp, "key", "left").select(
        "key", "doc_id", F.coalesce("comp", "key").alias("comp")), "named")
    # an id that stands for several texts ties their components together
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    tied = sets.select("doc_id", "key").distinct().join(several, "doc_id").join(named.select("key", "comp"), "key").select(
        "doc_id", "comp").distinct()
    least = tied.groupBy("doc_id").agg(F.min("comp").alias("lo"))
    whole = components(tied.join(least, "doc_id").select("lo", "comp")).select(
        F.col("key").alias("comp"), F.col("comp").alias("whole"))
    named = named.join(whole, "comp", "left").select("key", "doc_id", F.coalesce("whole", "comp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp").select("key", "comp", "component_id")
    return sets.select("doc_id", "tie", "n_shingles", "key").join(named, "key").select(
        "doc_id", "tie", "n_shingles", "comp", "component_id").unionByName(signed.where("n_shingles = 0").select(
            "doc_id", "tie", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, ...).

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets;
    a component is named by its least doc_id.  Null, empty and blank texts have no set and no link.
    Rows with the same doc_id are one document with several texts: all that any of them is linked with is
    one component.  A row without doc_id takes its component's name, and is kept only if that has none.
    Repeated rows get a row each.  Texts count whole, however long (the longest one's set bounds a task's memory);
    an empty table gives no row.  Other columns of ``docs`` are not read.
    """
    named = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _labelled(docs, size, percent).select("doc_id", "n_shingles", "component_id", named.alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: of its least doc_id the text of the least hash, once.

    Rows without doc_id come last.  Null, empty and blank texts all stay; every column stays.
    """
    rows = stored(_labelled(docs, size, percent).where("comp is not null").groupBy("comp", "doc_id", "tie").agg(
        F.count("*").alias("n")), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    first = rows.groupBy("comp").agg(F.min(place).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    out, at = spread_join(rows, first, "comp").withColumn("out", place != F.col("first")), [
        free_name(docs, "own_id"), free_name(docs, "own_tie")]
    out = stored(out.where("out or n > 1").select("doc_id", "tie", "out"), "out").withColumnsRenamed(dict(zip(("doc_id", "tie"), at)))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(at[0])) & (F.xxhash64(docs["text"].cast("string")) == F.col(at[1]))
    kept = docs.join(out.where("out").drop("out"), same, "left_anti")
    again = out.where("not out").drop("out")  # rows that stand there several times: one of each
    id_, tie = F.col("doc_id").cast("long").alias(at[0]), F.xxhash64(F.col("text").cast("string")).alias(at[1])
    once = kept.join(again, same, "left_semi").select("*", id_, tie).dropDuplicates(at).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(once)
