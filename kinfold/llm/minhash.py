"""SuperMinHash signatures, banding and verified links between the nodes of a signature table.

A *node* is one distinct set (a 64-bit ``key``), so exact copies never meet each other here.  Band
buckets are cut down to one member per map task before they are shuffled, and a bucket gives the
links of a star, not of all its pairs.  What a star can miss is found by a second, exact search:
components that are joined by likely but unproven links form a cluster, and inside each cluster a
prefix-filter join (in cells of bounded size) finds every similar pair of different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U, mix
from kinfold.llm.common import components, stored, to_batch

PACKED = pa.schema([("part", pa.int32()), ("rows", pa.binary())])
#: Parts of the buckets that a shuffle partition takes one after the other.
PARTS_PER_TASK = 16
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_GOLD = U(0x9E3779B97F4A7C15)
#: Bytes of one element in a packed set.
ELEMENT = 5
#: Members of a cluster that are compared with as many others in one cell.
BLOCK = 1024
#: Payload bytes that a task works on at a time (one cell or pair at least).
PART_BYTES = 1 << 19
#: Buckets (as a power of two) in which a batch counts how often elements occur.
RARITY_BITS = 18
#: How far under ``least`` a likely link still joins components to a cluster.
WEAKER = 0.2
#: (offsets, elements) of the distinct elements of every payload of a column.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def superminhash(rows: np.ndarray, elements: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures (``n_rows`` x ``slots`` 16-bit values) of many sets at once.

    Step j gives every element the value j + r at the j-th place of its own random permutation;
    a slot keeps the least.  A set stops when no slot is above j, since later steps only give more.
    All elements of the sets still open take each step together; big sets end after the first.
    """
    low = U(0xFFFFFFFF)
    best = np.full(n_rows * slots, 0xFFFFFFFF, np.uint32)

    def draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(e + U((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        at = (((x & low) * U(slots - j)) >> U(32)).astype(np.int64) + j
        return at, ((U(j) << U(25)) | (x >> U(39))).astype(np.uint32)

    if not len(rows):
        return best.reshape(n_rows, slots).astype(np.uint16)
    at, value = draw(elements, 0)
    np.minimum.at(best, rows * slots + at, value)
    open_rows = best.reshape(n_rows, slots).max(axis=1) >= (1 << 25)
    sizes = np.bincount(rows, minlength=n_rows)
    sel = np.flatnonzero(open_rows[rows])
    for lo in range(0, len(sel), 40_000):  # whole elements; a set may lie in two parts, minima agree
        part = sel[lo:lo + 40_000]
        r, e, first = rows[part], elements[part], at[part]
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(part), 1))
        i = np.arange(len(part))
        perm[i, 0], perm[i, first] = first.astype(np.uint8), 0
        grid = best.reshape(n_rows, slots)
        for j in range(1, slots):
            live = (grid.max(axis=1) >= (j << 25)) & (sizes > 0)
            keep = live[r]
            if not keep.any():
                break
            if keep.mean() < 0.7:
                r, e, perm = r[keep], e[keep], perm[keep]
                i = np.arange(len(r))
            k, value = draw(e, j)
            slot = perm[i, k]
            perm[i, k] = perm[i, j]
            perm[i, j] = slot
            np.minimum.at(best, r * slots + slot, value)
    x = mix(best.astype(U) + U(1))
    return (x >> U(48)).astype(np.uint16).reshape(n_rows, slots)


def pack_set(elements: np.ndarray) -> bytes:
    """Distinct 64-bit elements as 40-bit numbers."""
    return np.ascontiguousarray(elements).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpack_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, elements) of the packed sets of a binary column."""
    data, off = A.buffers(column)
    raw = data[off[0]:off[-1]].reshape(-1, ELEMENT)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :ELEMENT] = raw
    return (off - off[0]) // ELEMENT, wide.view(U).ravel()


def overlaps(off: np.ndarray, elements: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of the sets ``x[i]`` and ``y[i]`` (40-bit elements), for all i."""
    out = np.zeros(len(x), np.int64)
    size = np.diff(off)
    cost = np.cumsum(size[x] + size[y])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + 500_000, "right")))
        both = np.concatenate([x[lo:hi], y[lo:hi]])
        n = size[both]
        at = np.repeat(off[both] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(np.tile(np.arange(hi - lo), 2), n)
        key = np.sort((pair.astype(U) << U(40)) | elements[at])
        twice = key[1:][key[1:] == key[:-1]] >> U(40)
        out[lo:hi] = np.bincount(twice.astype(np.int64), minlength=hi - lo)
        lo = hi
    return out


def signatures(batch: pa.RecordBatch, column: str = "sig") -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(column))
    raw = b"".join(c.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(len(c), -1) if len(c) else np.zeros((0, 1), np.uint16)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One bucket number for each band of ``rows`` slots (48 bits of slots, mixed with the band)."""
    bands = sig.shape[1] // rows
    s = sig[:, :bands * rows].reshape(len(sig), bands, rows).astype(U)
    x = np.zeros((len(sig), bands), U)
    for i in range(rows):
        x = mix(x * U(0x100000001B3) + s[:, :, i] + U(1))
    return mix(x + np.arange(1, bands + 1, dtype=U) * _GOLD).view(np.int64)


def _bucket_rows(rows: int, n_parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key) pairs of (key, sig), many to a row: one row for each part of the buckets.

    A bucket that several nodes of the task share sends only its least node on; the others form
    buckets of two with that node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal size
        b = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
        k = np.concatenate([x for _, x in held]) if held else b
        held.clear()
        size = 0
        if len(b):
            order = np.argsort(b)
            b, k = b[order], k[order]
            first = np.ones(len(b), bool)
            first[1:] = b[1:] != b[:-1]
            start = np.flatnonzero(first)
            least = np.minimum.reduceat(k, start)
            lead = np.repeat(least, np.diff(np.append(start, len(b))))
            other = lead != k
            b = b[start]
            if other.any():
                pairs = np.unique(np.stack([lead[other], k[other]], axis=1), axis=0)
                own = mix(mix(pairs[:, 0].view(U)) + pairs[:, 1].view(U)).view(np.int64)
                b, k = np.concatenate([b, own, own]), np.concatenate([least, pairs[:, 0], pairs[:, 1]])
            else:
                k = least
        if len(b):
            part = (b.view(U) % U(n_parts)).astype(np.int32)
            order = np.argsort(part)
            pairs = np.stack([b[order], k[order]], axis=1)
            names, start = np.unique(part[order], return_index=True)
            yield to_batch(PACKED, names, [pairs[i:j].tobytes() for i, j in zip(start, np.append(start[1:], len(b)))])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        x = band_keys(signatures(batch), rows)
        held.append((x.ravel(), np.repeat(keys, x.shape[1])))
        size += x.size
        if size > 500_000:
            yield from flush()
    yield from flush()


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted input regrouped so that rows with equal leading keys stay together."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        keys = [t.column(i).to_numpy() for i in range(n_keys)]
        same = np.ones(len(t), bool)
        for k in keys:
            same &= k == k[-1]
        cut = len(t) if not len(t) else int(len(t) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut).combine_chunks().to_batches()[0]
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks().to_batches()[0]
    A.trim()


def parts(batch: pa.RecordBatch, n_keys: int, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut between groups of equal leading keys, at about ``PART_BYTES`` of a column."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for c in range(n_keys):
        k = batch.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    edges = np.append(np.flatnonzero(new), n)
    off = A.buffers(batch.column(column))[1]
    lo = 0
    while lo < n:
        far = edges[edges > lo]
        hi = int(far[max(0, int(np.searchsorted(off[far] - off[lo], PART_BYTES, "right")) - 1)])
        yield batch.slice(lo, hi - lo)
        lo = hi


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from the least node of every bucket to its others; rows of a part stand together."""
    def links(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        b, k = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2).T
        order = np.argsort(b)
        b, k = b[order], k[order]
        start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        lead = np.repeat(np.minimum.reduceat(k, start), np.diff(np.append(start, len(b))))
        keep = lead != k
        if keep.any():
            yield to_batch(PAIRS, lead[keep], k[keep])

    part, held = None, []
    for batch in batches:
        for p, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != part:
                if held:
                    yield from links(held)
                part, held = p, []
            held.append(rows)
    if held:
        yield from links(held)


SCORED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("strong", pa.bool_())])


def _likely(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, x, y) with nearly ``least`` equal slots or more; strong if ``least`` or more."""
    for batch in batches:
        if batch.num_rows:
            share = (signatures(batch, "x") == signatures(batch, "y")).mean(axis=1)
            keep = share >= least - WEAKER
            if keep.any():
                yield to_batch(SCORED, batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep], share[keep] >= least)


def _verify(sets: Sets, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose two sets are similar; rows (a, b, key, payload) sorted by these keys."""
    for batch in (p for b in whole_groups(batches, 2) for p in parts(b, 2, 3)):
        a, b, k = (batch.column(i).to_numpy() for i in range(3))
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        other = np.append(False, ~new[1:] & (k[1:] != k[:-1]))  # a node's repeated rows are equal
        y = np.flatnonzero(other)
        x = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))[y]
        off, elements = sets(batch.column(3))
        size, both = np.diff(off), overlaps(off, elements, x, y)
        hits = y[100 * both >= percent * (size[x] + size[y] - both)]
        if len(hits):
            yield to_batch(PAIRS, a[hits], b[hits])


def _across(sets: Sets, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components inside each cell, at most one for each pair joined.

    Rows (cluster, i, j, side, comp, key, payload) sorted by the first three.  Two similar sets share
    an element among the rarest ``(100 - percent) %`` of each (by count in the cell), so only such
    pairs are compared, and each component that a link joins to another isn't tried again.
    """
    for batch in (p for b in whole_groups(batches, 3) for p in parts(b, 3, 6)):
        cluster, i, j = (batch.column(c).to_numpy() for c in range(3))
        side, comp, key = (batch.column(c).to_numpy() for c in (3, 4, 5))
        off, elements = sets(batch.column(6))
        size = np.diff(off)
        new = np.append(True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        cell = np.cumsum(new) - 1
        own = np.repeat(np.arange(len(key)), size)
        # an element's rarity in its cell, by its bucket's count: any one order serves a prefix filter
        bucket = (A.mix(elements + cell[own].astype(U) * _GOLD) >> U(64 - RARITY_BITS)).astype(np.int64)
        count = np.bincount(bucket, minlength=1 << RARITY_BITS)[bucket]
        rank = np.arange(len(own)) - np.repeat(off[:-1], size)
        first = np.sort((own.astype(U) << U(48)) | (np.minimum(count, 255).astype(U) << U(40)) | elements)
        several = (first >> U(40)) & U(255) > U(1)
        first = first[several & (rank < np.repeat(size - -(-percent * size // 100) + 1, size))]
        first = np.sort((first & U((1 << 40) - 1)) << U(16) | (first >> U(48)))  # rows of a cell stand together
        doc = (first & U(0xFFFF)).astype(np.int64)
        group = np.cumsum(np.append(0, (np.diff(first >> U(16)) != 0) | (np.diff(cell[doc]) != 0))) if len(doc) else doc
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        found = []
        names, root = np.unique(comp, return_inverse=True)  # component numbers of the batch
        seen = np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def check() -> None:
            nonlocal seen, root
            pairs = np.setdiff1d(np.concatenate(held), seen) if held else np.zeros(0, np.int64)
            held.clear()
            seen = np.concatenate([seen, pairs])
            x, y = pairs >> 20, pairs & 0xFFFFF
            both = overlaps(off, elements, x, y)
            good = 100 * both >= percent * (size[x] + size[y] - both)
            for p, q in zip(x[good].tolist(), y[good].tolist()):
                c, d = find(int(root[p])), find(int(root[q]))
                if c != d:
                    parent[max(c, d)] = min(c, d)
                    found.append((min(int(key[p]), int(key[q])), max(int(key[p]), int(key[q]))))
            if parent:
                root = np.array([find(c) for c in range(len(names))])[root]

        waiting = 0
        if len(doc):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            r = root[doc]
            mixed = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
            stay = np.repeat(mixed, np.diff(np.append(first, len(doc))))
            doc, group = doc[stay], group[stay]
        at, step = np.arange(len(doc)), 1
        while len(at := at[at + step < len(doc)]) and len(at := at[group[at + step] == group[at]]):
            x, y = doc[at], doc[at + step]  # members of an element's group that are ``step`` apart
            good = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            good &= (i[x] == j[x]) | (side[x] != side[y])
            x, y = x[good], y[good]
            held.append(np.unique(np.minimum(x, y) << 20 | np.maximum(x, y)))
            waiting += len(held[-1])
            if waiting > 100_000:
                check()
                waiting = 0
            step += 1
        check()
        if found:
            yield to_batch(PAIRS, *zip(*found))


def _sorted(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).sortWithinPartitions(*order)


def _similar(pairs: DataFrame, met: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) of ``met`` nodes whose sets are similar."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    loaded = ends.join(met.select("key", "payload"), "key").select("a", "b", "key", "payload")
    return _sorted(loaded, ["a", "b"], ["a", "b", "key"]).mapInArrow(partial(_verify, sets, percent), "a long, b long")


def _relabel(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between the components of the pairs' ends (nodes without one are their own)."""
    x = comp.select(F.col("key").alias("a"), F.col("comp").alias("x"))
    y = comp.select(F.col("key").alias("b"), F.col("comp").alias("y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select(
        F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()


def link(
    nodes: DataFrame, payload: DataFrame | Callable[[DataFrame], DataFrame], sets: Sets, percent: int, rows: int, least: float
) -> DataFrame:
    """(key, comp) of every node with a link, for nodes (key, sig) and (key, payload) rows, which may
    repeat a key.  ``payload`` may be a function of the table of keys (key) that need one; it may give others too.

    ``sets`` gives the sets of a payload column; two are linked if 100 * intersection >= ``percent``
    * union.  ``rows`` is the number of slots of a band, ``least`` the share of equal slots below
    which a star pair isn't verified (several standard errors under the similarity asked for).
    """
    parts = PARTS_PER_TASK * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = nodes.select("key", "sig").mapInArrow(partial(_bucket_rows, rows, parts), "part int, rows binary")
    stars = _sorted(buckets, ["part"], ["part"]).mapInArrow(_stars, "a long, b long").distinct()
    stars = stored(stars, "stars")
    ends = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # joins that move texts or signatures are the same at every size: no table is small enough to
    # switch; the wanted keys are the side that is hashed, so the other isn't sorted
    sig = stored(nodes.select("key", "sig").join(ends.hint("shuffle_hash"), "key").dropDuplicates(["key"]), "met")
    x = sig.select(F.col("key").alias("a"), F.col("sig").alias("x"))
    y = sig.select(F.col("key").alias("b"), F.col("sig").alias("y"))
    likely = stored(stars.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        partial(_likely, least), "a long, b long, strong boolean"), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    if callable(payload):
        ends = stored(ends, "ends")
        payload = payload(ends)
    # one row per node: repeats of a frequent one would come along with each of its pairs
    met = stored(payload.join(ends.hint("shuffle_hash"), "key").dropDuplicates(["key"]), "payload")
    comp = stored(components(_similar(likely.where("strong").select("a", "b"), met, sets, percent)), "comp")
    # second search: clusters of components that likely links join
    clusters = components(_relabel(likely.select("a", "b"), comp)).select(
        F.col("key").alias("comp"), F.col("comp").alias("cluster"))
    clusters = stored(clusters, "clusters")
    member = ends.join(comp, "key", "left").select("key", F.coalesce("comp", "key").alias("comp")).join(clusters, "comp")
    member = stored(member, "members")
    blocks = member.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # each block of a cluster meets every block of the same cluster, itself included, once
    cells = member.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).select(
        "cluster", "comp", "key", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"), "own",
    ).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "comp", "key",
    ).join(met, "key").select("cluster", "i", "j", "side", "comp", "key", "payload")
    across = stored(_sorted(cells, ["cluster", "i", "j"], ["cluster", "i", "j"]).mapInArrow(
        partial(_across, sets, percent), "a long, b long"), "across")
    joined = components(_relabel(across, comp)).select(F.col("key").alias("comp"), F.col("comp").alias("least"))
    old = comp.unionByName(across.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(
        comp, "key", "left_anti").withColumn("comp", F.col("key")))
    return old.join(joined, "comp", "left").select("key", F.coalesce("least", "comp").alias("comp"))
