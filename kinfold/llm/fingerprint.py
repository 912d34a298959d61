"""Operator 13: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's shingles, ascending.  The sketch of
a union is the ``k`` smallest of both sketches, so sketches of parts merge.  With fewer than ``k``
shingles it holds them all and every estimate is exact; else the standard error of a resemblance r is
the square root of r (1 - r) / k, at most 0.032 for 256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.llm.common import free_name, numbered

K = 256
SHINGLE = 5
#: Rows of a block in which each row meets the next one.
BLOCK = 64
#: Shares into which a group's hashes are cut before its smallest are taken.
SHARES = 64
SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body has it."""
    return F.transform(F.array(value), body)[0]


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Sketch of the lower-cased text's shingles of ``size`` words; fewer words are one shingle.

    Words lie between white space.  Null, empty and blank texts have an empty sketch.
    """
    def shingles(words: Column) -> Column:
        many = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]))
        few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<long>)"))
        return F.when(F.size(words) >= size, many).otherwise(few)

    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")
    return smallest(let(F.transform(words, lambda w: F.xxhash64(w)), shingles), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection / union; 1 if both are empty."""
    def share(u: Column) -> Column:
        both = F.array_intersect(F.array_intersect(a, b), u)
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(u))

    return let(merged(a, b, k), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below ``k``."""
    place = F.element_at(a, k) / F.lit(2.0 ** 64) + F.lit(0.5)  # of the k-th hash among all, from 0 to 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, near: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has, from their resemblance; 1 if a is empty."""
    m, n = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), near * (m + n) / ((1 + near) * m)))


def fingerprint(a: Column) -> Column:
    """16 hexadecimal digits for each hash of a sketch."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_groups(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """(*by, column) with the merged sketch of each group of equal ``by`` (null is a group).

    Repeated hashes combine before the shuffle, and a group's hashes are cut down to ``k`` in shares
    before they meet, so a task never takes more than ``SHARES`` * ``k`` of one group.  Groups whose
    sketches are all empty, or null, get an empty one.
    """
    h, share, nth = (free_name(sketches, x) for x in ("hash", "share", "nth"))
    rows = sketches.select(*by, F.explode_outer(column).alias(h)).distinct().withColumn(share, F.pmod(F.col(h), F.lit(SHARES)))
    for keys in ([*by, share], by):
        order = Window.partitionBy(*keys).orderBy(F.col(h).asc_nulls_last())
        rows = rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= k).drop(nth)
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(h)).alias(column))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, own, block, at): every row of ``docs`` beside the next one by doc_id.

    A null doc_id comes first; rows with one doc_id follow each other by the hash of their text;
    the first row is next to the last.  Rows meet in blocks of consecutive places, to which the
    first row of the next block comes along (not ``own``).  A null text is empty.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = numbered(text.withColumn("tie", F.xxhash64("text")), [], ["doc_id", "tie"])
    end = F.when(F.col("pos") == 0, F.col("group_n")).otherwise(F.col("pos"))
    places = F.array(
        F.struct(F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").alias("at"), F.lit(True).alias("own")),
        F.when(F.col("pos") % BLOCK == 0, F.struct(
            F.floor((end - 1) / BLOCK).alias("block"), end.alias("at"), F.lit(False).alias("own"))))
    rows = rows.select("doc_id", "text", F.explode(F.array_compact(places)).alias("p")).select("doc_id", "text", "p.*")
    return rows.withColumn("next_text", F.lead("text").over(Window.partitionBy("block").orderBy("at")))


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and how alike they look.

    In the edited text the last half of the code points is replaced by as many of the next row's
    first ones.  Whole texts count, however long (a row's shingles are in memory at once).  Null and
    empty texts have an empty fingerprint, alike to each other; repeated rows get a row each; an
    empty table gives none.  Other columns aren't read.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.when(F.col("own"), F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))))
    rows = rows.select(
        "doc_id", "own", "block", "at", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("sketch"), F.when(F.col("own"), sketch(F.col("edited"), k)).alias("edited"))
    rows = rows.withColumn("after", F.lead("sketch").over(Window.partitionBy("block").orderBy("at"))).where("own")
    rows = rows.withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited"), k)).withColumn(
        "near_next", resemblance(F.col("sketch"), F.col("after"), k))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next",
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited"), F.col("near_edited"), k).alias("in_edited"),
        containment(F.col("sketch"), F.col("after"), F.col("near_next"), k).alias("in_next"))
