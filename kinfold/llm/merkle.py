"""Operator 12: a Merkle manifest of a dataset, with the proofs of all rows by pointer jumping.

Rows are leaves.  The leaves of each ``lang`` form a tree of runs of eight, and the trees' subroots
form the top tree.  A *node* is one run (tree, level, idx); level 1 runs hold the leaves.  Every node
points to its parent with one segment, its siblings there; a round joins the pointers with
themselves, which doubles the distance to the ancestor and appends the ancestor's segments, until
all point to the root.  The leaves of a run share what lies above it, so only runs jump.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.common import numbered, stored

FAN = 8
#: Rows under an ancestor for which it gets one more copy in a jump, and the most copies of one.
SPREAD, MOST_COPIES = 4096, 4096
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_of(**changed: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value, or a dash if null."""
    def field(name: str) -> Column:
        s = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(F.concat(*[field(f) for f in FIELDS]))


def _run(kids: Column) -> Column:
    return digest(F.array_join(F.transform(kids, lambda k: k["h"]), ""))


def _others(kids: Column, at: Column) -> Column:
    h = F.transform(kids, lambda k: k["h"])
    return F.concat(F.slice(h, 1, at), F.slice(h, at + 2, FAN))


def _grow(nodes: DataFrame, tree: Column, first: int, levels: int) -> list[DataFrame]:
    """Stored runs (tree, level, idx, n, kids, h, w) over ``nodes`` (id, at, n, h, w), from level ``first`` up.

    ``at`` is a node's place among the ``n`` of its tree's level; ``w`` counts the rows below it.
    """
    out = []
    for level in range(first, first + levels):
        runs = nodes.where("n > 1").groupBy(
            tree.alias("tree"), F.floor(F.col("at") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"),
        ).agg(F.array_sort(F.collect_list(F.struct("at", "h", "w", "id"))).alias("kids"))
        runs = runs.withColumn("h", _run(F.col("kids"))).withColumn(
            "w", F.aggregate("kids", F.lit(0).cast("long"), lambda s, k: s + k["w"]))
        out.append(stored(runs.withColumn("level", F.lit(level)), "level"))
        nodes, tree = out[-1].select("tree", _id(), F.col("idx").alias("at"), "n", "h", "w"), F.col("tree")
    return out


def _id() -> Column:
    return F.struct("tree", "level", "idx").alias("id")


def _height(n: int) -> int:
    """Times that ``n`` nodes become an eighth until one remains."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, run, at, alone, path) of every row of ``docs``.

    ``run`` holds the leaves of the row's run, ``at`` its place there, ``alone`` whether its tree has no
    other leaf (then no run is hashed), and ``path`` the runs above as (at, others), bottom up.  ``tampered`` is another leaf to
    be carried along.  A null lang is a tree of its own and comes first; a null doc_id comes before
    all others.  Rows that share lang and doc_id are leaves ordered by their digests, repeated rows
    as often as they stand there.  Texts of any length are hashed whole; an empty table gives no
    row.  Columns other than the five of a leaf aren't read.
    """
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        leaf_of().alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    leaves = numbered(stored(leaves, "leaves"), ["lang"], ["doc_id", "leaf"])
    bottom = leaves.groupBy(
        F.col("group_no").alias("tree"), F.floor(F.col("pos") / FAN).alias("idx"), F.col("group_n").alias("leaves"), F.lit(1).alias("level"),
    ).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("leaf").alias("h"), "tampered", "doc_id"))).alias("run"))
    bottom = stored(bottom.withColumn("h", F.when(F.col("leaves") == 1, F.col("run")[0]["h"]).otherwise(_run(F.col("run")))), "runs")
    size, trees = bottom.agg(F.max("leaves"), F.coalesce(F.max("tree"), F.lit(-1)) + 1).first()
    nodes = bottom.select(
        "tree", _id(), F.col("idx").alias("at"), F.ceil(F.col("leaves") / FAN).alias("n"), "h", F.size("run").cast("long").alias("w"))
    levels = _grow(nodes, F.col("tree"), 2, _height(-(-(size or 0) // FAN)))
    subroots = reduce(DataFrame.unionByName, [x.where("n = 1").select(_id(), "h", "w") for x in levels],
                      nodes.where("n = 1").select("id", "h", "w"))
    subroots = stored(subroots, "subroots")
    top = _grow(subroots.select("id", F.col("id.tree").alias("at"), F.lit(trees).cast("long").alias("n"), "h", "w"),
                F.lit(TOP).cast("long"), 1, _height(trees))
    root = (top[-1] if top else subroots).select("h").first()
    path = _jumped(levels, top)
    above = bottom.withColumn("id", _id())
    if path is not None:
        above = above.join(path.select("id", "path", "sub"), "id", "left")
    else:
        above = above.withColumn("path", F.expr(f"cast(array() as {PATH})")).withColumn("sub", F.col("h"))
    whole = above.select(
        "run", "leaves", F.coalesce("sub", "h").alias("subroot"),
        F.coalesce("path", F.expr(f"cast(array() as {PATH})")).alias("path"), F.posexplode("run").alias("at", "own"))
    return whole.select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.h").alias("leaf"), F.col("own.tampered").alias("tampered"),
        "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        F.transform("run", lambda r: r["h"]).alias("run"), "at", (F.col("leaves") == 1).alias("alone"), "path")


PATH = "array<struct<at: int, others: array<string>>>"


def _jumped(levels: list[DataFrame], top: list[DataFrame]) -> DataFrame | None:
    """(id, path, sub) of every node under the root: its segments up to there and its tree's subroot."""
    if not levels and not top:
        return None

    def pointers(runs: DataFrame, sub: Column) -> DataFrame:
        return runs.select(
            _id().alias("up"), F.col("w").alias("up_w"), "n",
            F.col("h").alias("up_h"), "kids", F.posexplode("kids").alias("at", "kid"),
        ).select(
            "kid.id", "kid.w", "up", "up_w", sub.alias("sub"),
            F.array(F.struct("at", _others(F.col("kids"), F.col("at")).alias("others"))).alias("path"))

    rows = [pointers(x, F.when(F.col("n") == 1, F.col("up_h"))) for x in levels]
    rows += [pointers(x, F.when(F.col("up.level") == 1, F.col("kid.h"))) for x in top]
    now, distance = stored(reduce(DataFrame.unionByName, rows), "pointers"), 1
    copies = lambda w: F.least(F.ceil(F.col(w) / SPREAD), F.lit(MOST_COPIES)).cast("int")
    while distance < len(levels) + len(top):
        # an ancestor of many rows comes in as many copies as its rows need
        there = now.select(
            F.col("id").alias("up"), F.col("up").alias("far"), F.col("up_w").alias("far_w"), F.col("sub").alias("far_sub"),
            F.col("path").alias("rest"), F.explode(F.sequence(F.lit(0), copies("w") - 1)).alias("copy"))
        here = now.withColumn("copy", F.pmod(F.xxhash64("id"), copies("up_w")).cast("int"))
        now = stored(here.join(there, ["up", "copy"], "left").select(
            "id", "w", F.coalesce("far", "up").alias("up"), F.coalesce("far_w", "up_w").alias("up_w"),
            F.coalesce("sub", "far_sub").alias("sub"),
            F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path")), "pointers")
        distance *= 2
    return now.select("id", "path", "sub")


def fold(leaf: Column, run: Column, at: Column, alone: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings of its proof."""
    own = digest(F.array_join(F.concat(F.slice(run, 1, at), F.array(leaf), F.slice(run, at + 2, FAN)), ""))
    return F.aggregate(path, F.when(alone, leaf).otherwise(own), lambda acc, s: digest(F.array_join(
        F.concat(F.slice(s["others"], 1, s["at"]), F.array(acc), F.slice(s["others"], s["at"] + 1, FAN)), "")))


def report(docs: DataFrame) -> DataFrame:
    """Digests of every row's proof; where 3 divides the CRC of its doc_id, the proof is folded over a
    leaf whose text was lower-cased, and is verified only if that changed nothing.  Rows without
    doc_id aren't tampered with; ``proofs`` states the other cases.
    """
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    changed = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = proofs(docs, F.when(hit, leaf_of(text=changed)))
    siblings = F.concat(
        F.concat(F.slice("run", 1, F.col("at")), F.slice("run", F.col("at") + 2, FAN)),
        F.flatten(F.transform("path", lambda s: s["others"])))
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings, "")).alias("proof_sha256"),
        F.size(siblings).alias("n_siblings"),
        fold(F.coalesce("tampered", "leaf"), F.col("run"), F.col("at"), F.col("alone"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
