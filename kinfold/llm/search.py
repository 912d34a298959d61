"""Operator 11: ranked lexical search over an inverted index, by Block-Max MaxScore.

*Index*: every task turns its documents into shards, each with the postings of all its terms, so
postings are never shuffled.  A term's postings lie in blocks of 128, packed as byte-wise variable
length numbers; a block's last document and largest weightless score stand beside it.

*Search*: the queries (in blocks of bounded size) go to every partition of shards, with the lists of
their own terms only.  Global bounds split an item's lists: as long as the non-essential ones can't
reach the threshold together, only documents of the essential ones are candidates.  Block maxima of the
non-essential lists reject most of them before a block is unpacked.  Each partition hands over
the best of its shards, and these heaps are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.common import free_name, stored, to_batch
from kinfold.llm.minhash import _sorted

BLOCK = 128
#: Postings of a shard (one document more at most), and documents scored at a time.
SHARD_POSTINGS, STRETCH = 1_000_000, 2048
#: Distinct terms, over all items, of a block of queries.
QUERY_TERMS = 200_000
#: Copies of a term's request, so that the lists of a frequent one are found by several tasks.
SALT = 16
TOP = 20
NO_ID = -(1 << 63)

COUNTS = pa.schema([("row", pa.int64()), ("term", pa.int64()), ("tf", pa.int64())])
INDEX = "part long, shard long, term long, n int, top int, head binary, data binary"
_INDEX = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("term", pa.int64()), ("n", pa.int32()),
                    ("top", pa.int32()), ("head", pa.binary()), ("data", pa.binary())])
FOUND = "item long, doc long, score long"
_FOUND = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])


def term_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the distinct terms of every row, rows ascending, and each row's length."""
    start, end, rows = A.spans(data, off, A.ALNUM)
    term = A.span_hash(A.prefix(data, A.VALUES_LOWER), start, end)
    _, first, times = np.unique(A.mix(term + rows.astype(A.U) * A._BASE), return_index=True, return_counts=True)
    order = np.argsort(first)
    first = first[order]
    return rows[first], term[first], times[order], np.bincount(rows, minlength=len(off) - 1)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with a term, terms) of every batch."""
    for batch in batches:
        for _, _, data, off in A.chunks(batch.column(0)):
            n = np.bincount(A.spans(data, off, A.ALNUM)[2], minlength=len(off) - 1)
            yield pa.RecordBatch.from_pydict({"n": [int((n > 0).sum())], "l": [int(n.sum())]})


def weightless(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits each, low ones first; and where each number starts (one more)."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[at[has] + k] = (values[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, at


def unpack(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    end = np.flatnonzero(last)
    start = np.concatenate([[0], end[:-1] + 1])
    out, size = np.zeros(len(end), np.int64), end - start
    for k in range(int(size.max()) + 1):
        has = np.flatnonzero(size >= k)
        out[has] |= (raw[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _slices(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values between consecutive ``edges`` (byte offsets from the first)."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[edges[0]:edges[-1]]))])


def _shard(part: int, shard: int, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
    """Rows of a shard: its documents, then a row for each term.  ``doc`` ascends."""
    yield to_batch(_INDEX, [part], [shard], pa.nulls(1, pa.int64()), [len(ids)], [0], [ids.tobytes()], [m.tobytes()])
    order = np.argsort(term, kind="stable")
    doc, term, tf = doc[order].astype(np.int64), term[order], tf[order].astype(np.int64)
    score = weightless(tf, m[doc])
    lists = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    n = np.diff(np.append(lists, len(doc)))
    place = np.arange(len(doc)) - np.repeat(lists, n)
    blocks = np.flatnonzero(place % BLOCK == 0)
    width = np.diff(np.append(blocks, len(doc)))
    delta = doc.copy()
    delta[1:] -= doc[:-1]
    delta[blocks] = doc[blocks]
    values = np.empty(2 * len(doc), np.int64)
    at = np.arange(len(doc)) + np.repeat(blocks, width)  # a block's documents stand before its counts
    values[at], values[at + np.repeat(width, width)] = delta, tf
    data, byte = pack(values)
    first = np.searchsorted(blocks, lists)  # each list's first block
    per = np.diff(np.append(first, len(blocks)))
    head = np.empty((len(blocks), 3), np.int32)
    head[:, 0], head[:, 1] = doc[blocks + width - 1], np.maximum.reduceat(score, blocks)
    head[:, 2] = byte[2 * (blocks + width)] - np.repeat(byte[2 * lists], per)
    top, raw = np.maximum.reduceat(score, lists), head.view(np.uint8).ravel()
    head_edge, data_edge = np.append(first, len(blocks)) * 12, np.append(byte[2 * lists], len(data))
    for lo in range(0, len(lists), 50_000):
        hi = min(lo + 50_000, len(lists))
        yield to_batch(_INDEX, np.full(hi - lo, part), np.full(hi - lo, shard), term[lists[lo:hi]].view(np.int64), n[lo:hi],
                       top[lo:hi], _slices(raw, head_edge[lo:hi + 1]), _slices(data, data_edge[lo:hi + 1]))


def _build(n_docs: int, n_terms: int, shard_postings: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, shard, size, docs = TaskContext.get().partitionId(), 0, 0, 0
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        nonlocal shard, size, docs
        ids, length, doc, term, tf = (np.concatenate(x) for x in zip(*held))
        held.clear()
        m = 75 + (25 * length * n_docs) // max(n_terms, 1)
        yield from _shard(part, shard, ids, m, doc, term, tf)
        shard, size, docs = shard + 1, 0, 0
        A.trim()

    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        for lo, hi, data, off in A.chunks(batch.column(1)):
            rows, term, times, length = term_counts(data, off)
            some = np.flatnonzero(length)
            if not len(some):
                continue
            held.append((ids[lo:hi][some], length[some], (np.searchsorted(some, rows) + docs).astype(np.int32), term, times.astype(np.int32)))
            size, docs = size + len(rows), docs + len(some)
            if size >= shard_postings:
                yield from flush()
    if held:
        yield from flush()
    A.trim()


def build_index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> tuple[DataFrame, int]:
    """Stored index of all rows of ``docs`` (doc_id, text, ...), and the number of documents with a term.

    Rows (part, shard, term, n, top, head, data); one with a null term holds a shard's documents.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, length = text.select("text").mapInArrow(_lengths, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return stored(text.mapInArrow(partial(_build, n or 0, length or 0, shard_postings), INDEX), "index"), n or 0


class Postings:
    """A term's list in one shard; blocks are unpacked when they are first needed."""

    def __init__(self, n: int, top: int, head: bytes, data: bytes, m: np.ndarray):
        self.n, self.top, self.data, self.m = n, top, data, m
        h = np.frombuffer(head, np.int32).reshape(-1, 3)
        self.last, self.most, self.end = (np.ascontiguousarray(h[:, i]).astype(np.int64) for i in range(3))
        self.open = np.zeros(len(h), bool)
        self.doc, self.score = np.empty(n, np.int64), np.empty(n, np.int64)

    def need(self, lo: int, hi: int) -> None:
        """Unpack the blocks from ``lo`` to ``hi`` (exclusive)."""
        while lo < hi:
            if self.open[lo]:
                lo += 1
                continue
            to = lo + 1
            while to < hi and not self.open[to]:
                to += 1
            raw = np.frombuffer(self.data, np.uint8)[self.end[lo - 1] if lo else 0:self.end[to - 1]]
            values, a, b = unpack(raw), lo * BLOCK, min(to * BLOCK, self.n)
            full = (b - a) // BLOCK
            grid = values[:2 * full * BLOCK].reshape(full, 2, BLOCK)
            mid = a + full * BLOCK
            self.doc[a:mid] = np.cumsum(grid[:, 0], axis=1).ravel()
            tf = np.empty(b - a, np.int64)
            tf[:mid - a] = grid[:, 1].ravel()
            rest = values[2 * full * BLOCK:]
            self.doc[mid:b], tf[mid - a:] = np.cumsum(rest[:b - mid]), rest[b - mid:]
            self.score[a:b] = weightless(tf, self.m[self.doc[a:b]])
            self.open[lo:to] = True
            lo = to

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``lo`` to ``hi`` (exclusive) and their scores."""
        first, to = np.searchsorted(self.last, lo), min(int(np.searchsorted(self.last, hi - 1)) + 1, len(self.last))
        self.need(int(first), to)
        d = self.doc[first * BLOCK:to * BLOCK]
        a, b = np.searchsorted(d, (lo, hi))
        return d[a:b], self.score[first * BLOCK:to * BLOCK][a:b]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which each document would lie, and its largest score (0 beyond the last)."""
        block = np.searchsorted(self.last, docs)
        return block, np.append(self.most, 0)[block]

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Scores of the documents, whose blocks are known; 0 without the term."""
        out, inside = np.zeros(len(docs), np.int64), np.flatnonzero(block < len(self.last))
        if len(inside):
            held = np.unique(block[inside])
            for b in held[~self.open[held]].tolist():
                self.need(b, b + 1)
            # places in the list: unopened blocks are passed over by searching each block by itself
            lo, hi = block[inside] * BLOCK, np.minimum((block[inside] + 1) * BLOCK, self.n)
            d = docs[inside]
            for _ in range(BLOCK.bit_length()):
                mid = (lo + hi) // 2
                low = (lo < hi) & (self.doc[np.minimum(mid, self.n - 1)] < d)
                lo, hi = np.where(low, mid + 1, lo), np.where(low, hi, np.maximum(mid, lo))
            at = np.minimum(lo, self.n - 1)
            hit = self.doc[at] == d
            out[inside[hit]] = self.score[at[hit]]
        return out


class Best:
    """The ``k`` best (score, doc) so far; equal scores by document."""

    def __init__(self, k: int):
        self.k, self.doc, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Score under which nothing enters any more."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score))[:self.k]
        self.doc, self.score = doc[order], score[order]


def max_score(lists: list[tuple[int, Postings]], ids: np.ndarray, best: Best, stretch: int = STRETCH) -> None:
    """Add a shard's best documents for weighted lists to ``best``; ``ids`` are the shard's documents."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    reach = np.cumsum([c * p.top for c, p in lists])
    for lo in range(0, len(ids), stretch):
        hi = min(lo + stretch, len(ids))
        split = int(np.searchsorted(reach, best.least))  # lists before it can't reach the threshold together
        if split == len(lists):
            return
        total = np.zeros(hi - lo, np.int64)
        for c, p in lists[split:]:
            doc, score = p.between(lo, hi)
            total[doc - lo] += c * score
        doc = np.flatnonzero(total)
        if not len(doc):
            continue
        score, doc = total[doc], doc + lo
        rest = [(c, p, *p.bounds(doc)) for c, p in reversed(lists[:split])]
        bound = score + sum((c * most for c, _, _, most in rest), np.zeros(len(doc), np.int64))
        keep = np.flatnonzero(bound >= best.least)
        for c, p, block, most in rest:
            if not len(keep):
                break
            more = c * p.of(doc[keep], block[keep])
            score[keep] += more
            bound[keep] += more - c * most[keep]
            keep = keep[bound[keep] >= best.least]
        if len(keep):
            best.add(ids[doc[keep]], score[keep])


def _search(k: int, stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best documents of every item over the shards of each (block, part); rows sorted by block, part,
    shard (requests first, as -1), documents before lists."""
    at: tuple | None = None
    shard, items, ids, m = -1, {}, None, None
    lists: dict[int, Postings] = {}

    def run():
        if ids is not None:
            for terms, weights, best in items.values():
                own = [(c, lists[t]) for t, c in zip(terms, weights) if t in lists]
                if own:
                    max_score(own, ids, best, stretch)
        lists.clear()

    def results():
        run()
        done = [(i, b) for i, (_, _, b) in items.items() if len(b.doc)]
        items.clear()
        if done:
            yield to_batch(_FOUND, np.repeat([i for i, _ in done], [len(b.doc) for _, b in done]),
                           np.concatenate([b.doc for _, b in done]), np.concatenate([b.score for _, b in done]))

    for batch in batches:
        for r in batch.to_pylist():
            if at != (r["block"], r["part"]):
                yield from results()
                at, shard, ids = (r["block"], r["part"]), -1, None
            if r["shard"] != shard:
                run()
                shard, ids = r["shard"], None
            if shard < 0:
                items[r["item"]] = (r["terms"], r["weights"], Best(k))
            elif r["term"] is None:
                ids, m = np.frombuffer(r["head"], np.int64), np.frombuffer(r["data"], np.int64)
            else:
                lists[r["term"]] = Postings(r["n"], r["top"], r["head"], r["data"], m)
    yield from results()
    A.trim()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in A.chunks(batch.column(1)):
            rows, term, times, _ = term_counts(data, off)
            yield to_batch(COUNTS, batch.column(0).to_numpy()[lo:hi][rows], term.view(np.int64), times)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_postings: int = SHARD_POSTINGS, stretch: int = STRETCH) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best rows of ``docs`` (doc_id, text, ...) for each item.

    ``items`` has item_id and text.  Repeated rows of it count once; texts that differ under one item_id,
    or under none, are ranked apart.  Rows of ``docs`` that repeat are documents of their own; those without
    doc_id come first among equals.  Null, blank and empty texts have no term: such a document isn't
    counted and such an item finds nothing, as does an empty table.  Texts count whole, whatever their
    length; the longest one bounds a task's memory.  Other columns aren't read.
    """
    index, n_docs = build_index(docs, shard_postings)
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asked = stored(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = stored(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"), "terms")
    blocks = max(1, -(-terms.count() // QUERY_TERMS))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    wanted = terms.select("block", F.col("term").alias("asked")).distinct().withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    there = index.where("term is not null").withColumn("salt", F.pmod(F.xxhash64("part", "shard"), F.lit(SALT)).cast("int"))
    lists = stored(there.join(wanted, (there["term"] == wanted["asked"]) & (there["salt"] == wanted["salt"])).select(
        "block", "part", "shard", "term", "n", "top", "head", "data"), "lists")
    held = lists.groupBy("block", "term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    requests = terms.join(held, ["block", "term"]).withColumn("weight", F.col("times") * weight).where("weight > 0").groupBy(
        "block", "item").agg(F.collect_list(F.struct("term", "weight")).alias("own"))
    shards = index.where("term is null")
    parts = shards.agg(F.coalesce(F.max("part"), F.lit(-1)) + 1).first()[0]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    columns = ["block", "part", "shard", "term", "n", "top", "head", "data"]
    no_request = [none("long", "item"), none("array<long>", "terms"), none("array<long>", "weights")]
    rows = lists.select(*columns, *no_request).unionByName(
        shards.withColumn("block", every(blocks)).select(*columns, *no_request))
    if parts:
        rows = rows.unionByName(requests.select(
            "block", every(parts).alias("part"), F.lit(-1).cast("long").alias("shard"),
            *[none(t, c) for t, c in (("long", "term"), ("int", "n"), ("int", "top"), ("binary", "head"), ("binary", "data"))],
            "item", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights")))
    found = _sorted(rows, ["block", "part"], ["block", "part", "shard", "term"]).mapInArrow(partial(_search, k, stretch), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select(
        "item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
