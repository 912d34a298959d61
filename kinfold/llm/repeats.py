"""Operator 7: repeated byte strings by longest-previous-factor arrays, first occurrence kept.

Every string of ``WINDOW`` bytes holds an *anchor*: its least ``GRAM``-byte gram by hash, the
leftmost of equals.  Equal strings have equal anchors at equal places, so a string can only repeat
where its anchor repeats.  The strings that share one anchor occurrence are a run of starts; the
bytes they cover are its *context*.

1. Equal contexts (by hash) are found by a shuffle on the anchor, after each task has cut its own
   copies down to the first: all but the first occurrence go whole.
2. Anchors with different contexts are settled on their bytes: the windows of all contexts of a
   bounded batch are put in suffix order, previous and next smaller positions give each start its
   longest previous factor, and a start with a factor of a whole window goes.
3. An anchor with very many different contexts is dealt out window by window instead, so that no
   task has to hold it; equal windows meet by hash as in 1.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U
from kinfold.llm.common import stored, to_batch
from kinfold.llm.minhash import whole_groups

WINDOW, GRAM = 100, 24
#: Bits of a position inside a chunk; the rest of an order key is the gram's hash.
POSITION_BITS = 28
#: Contexts of one anchor that are compared in one batch; more go window by window.
HOT = 2000
BATCH_BYTES = 1 << 20
FLUSH = 1_500_000
NO_ID = -(1 << 63)

MARKED = "kind int, anchor long, print long, doc long, tie long, pos long"
_MARKED = pa.schema([
    ("kind", pa.int32()), ("anchor", pa.int64()), ("print", pa.int64()), ("doc", pa.int64()),
    ("tie", pa.int64()), ("pos", pa.int64()),
])
ROW, GONE, ASK = 0, 1, 2


def pack_pos(at, lo, hi):
    """Anchor place and the first and last start of its run in one number."""
    return at << 14 | (at - lo) << 7 | (at - hi)


def unpack_pos(pos):
    at = pos >> 14
    return at, at - (pos >> 7 & 127), at - (pos & 127)


def pack_span(lo, hi):
    return lo << 31 | hi


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(row, anchor place, first start, last start, anchor hash, context hash) of every run; places
    count from the start of ``data``."""
    n = len(data)
    size = np.diff(off)
    rows = np.flatnonzero(size >= window)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, none, none, none
    p = A.prefix(data, A.VALUES)
    g = A.mix((p[gram:] - p[:-gram]) * A.powers(A._INVERSE, n - gram + 1))
    low = U((1 << POSITION_BITS) - 1)
    m = (g & ~low) | np.arange(len(g), dtype=U)
    span, width = 1, window - gram + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    count = size[rows] - window + 1
    edge = np.cumsum(count)
    starts = np.arange(int(edge[-1])) + np.repeat(off[rows] - (edge - count), count)
    at = (m[starts] & low).astype(np.int64)
    new = np.append(True, at[1:] != at[:-1])
    new[(edge - count)] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], at[first]
    owner = np.repeat(rows, count)[first]
    context = A.mix(A.span_hash(p, lo, hi + window) + (at - lo).astype(U) * A._STEP[0])
    return owner, at, lo, hi, g[at].view(np.int64), context.view(np.int64)


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Union of the spans of each row (sorted by row, then start)."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    reach = np.maximum.accumulate(hi + doc * (1 << 31)) - doc * (1 << 31) if len(doc) else hi
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] if len(doc) else hi


class FirstOnly:
    """Rows of one task; of those with equal (anchor, print) only the first in text order goes on."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self):
        if not self.size:
            return
        anchor, mark, doc, tie, pos = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        at, lo, hi = unpack_pos(pos)
        text = np.lexsort((lo, tie, doc))
        rank = np.empty(len(text), np.int64)
        rank[text] = np.arange(len(text))
        key = A.mix(anchor.view(U) + A.mix(mark.view(U)))
        order = np.lexsort((rank, key))
        first = np.append(True, key[order][1:] != key[order][:-1])
        keep, gone = order[first], order[~first]
        for s in range(0, len(keep), 200_000):
            k = keep[s:s + 200_000]
            yield to_batch(_MARKED, np.full(len(k), ROW), anchor[k], mark[k], doc[k], tie[k], pos[k])
        if len(gone):
            names, own = np.unique(np.stack([doc[gone], tie[gone]]), axis=1, return_inverse=True)
            own, s, e = _merged(own.ravel(), lo[gone], hi[gone] + self.width)
            d, t = names[0][own], names[1][own]
            spread = A.mix(d.view(U) + t.view(U)).view(np.int64)
            yield to_batch(_MARKED, np.full(len(d), GONE), spread, np.zeros(len(d), np.int64), d, t, pack_span(s, e))


def _anchor_rows(batches):
    """Anchor runs of (doc, tie, text)."""
    held = FirstOnly(WINDOW)
    for batch in batches:
        doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, data, off in A.chunks(batch.column(2)):
            row, at, s, e, anchor, context = anchors(data, off)
            base = off[row]
            held.add(anchor, context, doc[lo + row], tie[lo + row], pack_pos(at - base, s - base, e - base))
            if held.size > FLUSH:
                yield from held.flush()
    yield from held.flush()


def _settle(width: int, batches):
    """Rows sorted by (anchor, print, doc, tie, pos): all but the first of a print are gone; the
    firsts of an anchor with several prints are asked about.  Streams; no anchor is gathered."""
    last_anchor = last_print = None
    waiting = None  # first row of the current anchor while it has one print only
    for batch in batches:
        kind, anchor, mark, doc, tie, pos = (c.to_numpy() for c in batch.columns)
        done = kind == GONE
        if done.any():
            yield batch.filter(pa.array(done))
            anchor, mark, doc, tie, pos = (c[~done] for c in (anchor, mark, doc, tie, pos))
        if not len(anchor):
            continue
        same_anchor = np.append(last_anchor is not None and anchor[0] == last_anchor, anchor[1:] == anchor[:-1])
        same = same_anchor & np.append(last_print is not None and mark[0] == last_print, mark[1:] == mark[:-1])
        if same.any():
            at, lo, hi = unpack_pos(pos[same])
            names, own = np.unique(np.stack([doc[same], tie[same]]), axis=1, return_inverse=True)
            own, s, e = _merged(own.ravel(), lo, hi + width)
            n = len(own)
            yield to_batch(_MARKED, np.full(n, GONE), np.zeros(n, np.int64), np.zeros(n, np.int64),
                           names[0][own], names[1][own], pack_span(s, e))
        f = np.flatnonzero(~same)
        if len(f):
            a = anchor[f]
            joins = np.append(same_anchor[f[0]], a[1:] == a[:-1])  # another print of the anchor came before
            ask = joins.copy()
            ask[:-1] |= joins[1:]
            if joins[0] and waiting is not None:
                yield to_batch(_MARKED, *([x] for x in waiting))
            k = f[ask]
            if len(k):
                yield to_batch(_MARKED, np.full(len(k), ASK), anchor[k], mark[k], doc[k], tie[k], pos[k])
            z = f[-1]
            waiting = None if ask[-1] else (ASK, anchor[z], mark[z], doc[z], tie[z], pos[z])
        last_anchor, last_print = anchor[-1], mark[-1]


CONTEXTS = "hot boolean, anchor long, doc long, tie long, lo int, bytes binary"
_CONTEXTS = pa.schema([
    ("hot", pa.bool_()), ("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("lo", pa.int32()),
    ("bytes", pa.binary()),
])


def _contexts(batches):
    """Bytes of the contexts asked about: rows (doc, tie, text, asks)."""
    for batch in batches:
        out = []
        for doc, tie, text, asks in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            for ask in asks:
                _, lo, hi = unpack_pos(ask["pos"])
                out.append((ask["hot"], ask["anchor"], doc, tie, lo, raw[lo:hi + WINDOW]))
        if out:
            yield to_batch(_CONTEXTS, *zip(*out))


def smaller(pos: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry that is smaller, -1 if none (pointer doubling)."""
    near = np.arange(len(pos)) - 1
    live = np.arange(len(pos))
    while len(live):
        c = near[live]
        live = live[(c >= 0) & (pos[c] > pos[live])]
        near[live] = near[near[live]]
    return near


def longest_previous(strings: np.ndarray) -> np.ndarray:
    """For fixed-width strings in text order: the longest prefix each shares with an earlier one.

    The rows of ``strings`` (n x width bytes) are suffixes cut at the width; among all earlier ones
    the previous and the next smaller position in suffix order share the longest prefix.
    """
    n, width = strings.shape
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{width}").ravel(), kind="stable")
    before = smaller(order)
    after = n - 1 - smaller(order[::-1])[::-1]
    best = np.zeros(n, np.int64)
    for near, good in ((before, before >= 0), (after, after < n)):
        i, j = order[good], order[near[good]]
        differ = strings[i] != strings[j]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        best[i] = np.maximum(best[i], common)
    return best


def _factors(batches):
    """Spans of the starts whose longest previous factor is a whole window (rows sorted by anchor)."""
    held, size = [], 0

    def flush():
        t = pa.concat_tables(held).combine_chunks()
        doc, tie, lo = (t.column(c).to_numpy() for c in ("doc", "tie", "lo"))
        order = np.lexsort((lo, tie, doc))
        raw = t.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        width = np.array([len(raw[i]) for i in order], np.int64)
        begin = np.cumsum(width) - width
        count = width - WINDOW + 1
        own = np.repeat(np.arange(len(order)), count)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = begin[own] + inner
        again = longest_previous(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]) >= WINDOW
        own, start = own[again], inner[again] + lo[order][own[again]]
        if len(own):
            names, who = np.unique(np.stack([doc[order], tie[order]]), axis=1, return_inverse=True)
            who, s, e = _merged(who.ravel()[own], start, start + WINDOW)
            n = len(who)
            yield to_batch(_MARKED, np.full(n, GONE), np.zeros(n, np.int64), np.zeros(n, np.int64),
                           names[0][who], names[1][who], pack_span(s, e))

    for batch in whole_groups(batches, 1):
        t = pa.Table.from_batches([batch])
        # cut at group edges so that a flush never splits an anchor
        anchor = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        total = np.append(0, np.cumsum([len(x) for x in batch.column(batch.schema.get_field_index("bytes")).to_pylist()]))
        lo = 0
        for a, b in zip(edges[:-1], edges[1:]):
            if size + total[b] - total[lo] > BATCH_BYTES and b > lo:
                held.append(t.slice(lo, b - lo))
                yield from flush()
                held.clear()
                size, lo = 0, b
        if lo < len(anchor):
            held.append(t.slice(lo))
            size += int(total[-1] - total[lo])
    if held:
        yield from flush()


def _window_rows(batches):
    """Every window of hot contexts as a row of its own, keyed by its hash."""
    held = FirstOnly(WINDOW)
    for batch in batches:
        doc, tie, lo = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "tie", "lo"))
        for a, _, data, off in A.chunks(batch.column(batch.schema.get_field_index("bytes")), 1 << 18):
            count = np.diff(off) - WINDOW + 1
            own = np.repeat(np.arange(len(count)), count)
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = off[own] + inner
            h = A.span_hash(A.prefix(data, A.VALUES), at, at + WINDOW).view(np.int64)
            start = lo[a + own].astype(np.int64) + inner
            held.add(h, np.zeros(len(h), np.int64), doc[a + own], tie[a + own], pack_pos(start, start, start))
            if held.size > FLUSH:
                yield from held.flush()
    yield from held.flush()


CLEANED = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
           "removed array<struct<start: int, end: int>>")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_CLEANED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("removed", pa.list_(_SPAN)),
])


def _clean(batches):
    """Result rows of (doc_id, text, spans)."""
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw, kept, gone, last, removed = (text or "").encode(), hashlib.sha256(), 0, 0, []
            for v in sorted(spans or ()):
                s, e = v >> 31, v & (1 << 31) - 1
                if removed and s <= removed[-1]["end"]:
                    removed[-1]["end"] = max(removed[-1]["end"], e)
                else:
                    removed.append({"start": s, "end": e})
            for r in removed:
                kept.update(raw[last:r["start"]])
                last = r["end"]
                gone += r["end"] - r["start"]
            kept.update(raw[last:])
            out.append((doc_id, len(raw), gone, len(removed), kept.hexdigest(), removed))
        if out:
            yield to_batch(_CLEANED, *zip(*out))


def _by_print(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "anchor").sortWithinPartitions("anchor", "print", "doc", "tie", "pos")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Counts, digest and removed byte spans of every row of ``docs`` (doc_id, text, ...).

    A byte goes if some ``WINDOW``-byte string covers it that starts earlier too, in a smaller
    doc_id or earlier in the same text, judged on the input.  Null texts count as empty; texts
    shorter than a window lose nothing.  A null doc_id comes before all others.  Texts that share a
    doc_id are ordered by a hash of the text; rows equal in both are one document in this order and
    get the same result.  Other columns aren't read.
    """
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.col("text").cast("string").alias("text"))
    tied = text.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    text = text.withColumn("tie", F.xxhash64("text") if tied else F.lit(0).cast("long"))
    # repeated rows are one document: searched once, and what it loses goes back to each of them
    once = text.select("doc", "tie", "text")
    once = once.dropDuplicates(["doc", "tie"]) if tied else once
    rows = once.mapInArrow(_anchor_rows, MARKED)
    marks = stored(_by_print(rows).mapInArrow(partial(_settle, WINDOW), MARKED), "marks")
    asks = marks.where(F.col("kind") == ASK)
    hot = asks.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    asks = asks.join(hot, "anchor", "left").groupBy("doc", "tie").agg(
        F.collect_list(F.struct(F.coalesce("hot", F.lit(False)).alias("hot"), "anchor", "pos")).alias("asks"))
    found = once.join(asks, ["doc", "tie"]).select("doc", "tie", "text", "asks")
    contexts = stored(found.mapInArrow(_contexts, CONTEXTS), "contexts")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = contexts.where("not hot").select("anchor", "doc", "tie", "lo", "bytes")
    cold = cold.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_factors, MARKED)
    windows = _by_print(contexts.where("hot").mapInArrow(_window_rows, MARKED)).mapInArrow(partial(_settle, WINDOW), MARKED)
    gone = marks.where(F.col("kind") == GONE).unionByName(cold).unionByName(windows)
    spans = gone.groupBy("doc", "tie").agg(F.collect_list("pos").alias("spans"))
    out = text.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_clean, CLEANED)
