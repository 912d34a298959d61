"""Operator 5: bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.bpe import text_chunks, vocabulary
from kinfold.llm.common import stored, to_batch
from kinfold.llm.tokens import VOCABULARY, vocabulary_path

CAPACITY, EOS = 1024, 2
#: Open bins of a task.
OPEN_BINS = 512
#: Tasks whose open bins are packed together at the end (at most OPEN_BINS x TASKS rows in one task).
TASKS = 32


class BestFit:
    """Online best fit with a fixed number of open bins.

    Bit f of ``free`` is set if some open bin has f places left, so the tightest bin for n places is
    the lowest set bit from n on.  When all bins are open, the fullest closes first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.n_open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _pop(self, f: int) -> int:
        b = self.bins[f].pop()
        if not self.bins[f]:
            self.free &= ~(1 << f)
        self.n_open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for ``n`` places."""
        fits = self.free >> n
        if fits and n:
            f = n + (fits & -fits).bit_length() - 1
            b = self._pop(f)
        else:
            f, b = self.capacity, self.made
            self.made += 1
            if self.n_open == self.open_bins and n < self.capacity:
                self._pop((self.free & -self.free).bit_length() - 1)
        left = f - n
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.capacity - f

    def left_open(self) -> list[tuple[int, int]]:
        """(bin, places used) of the open bins, the fullest first."""
        return [(b, self.capacity - f) for f in range(1, self.capacity + 1) for b in self.bins[f]]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("ids", pa.binary()),
])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pack(name: str, capacity: int, eos: int, open_bins: int, keep_ids: bool, batches):
    vocab, task = vocabulary(vocabulary_path(name)), TaskContext.get().partitionId()
    packer = BestFit(capacity, open_bins)
    for batch in batches:
        texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for lo, hi in text_chunks(texts):
            ids, off = vocab.encode(texts[lo:hi])
            rows = []
            for i in range(hi - lo):
                own = np.append(ids[off[i]:off[i + 1]], eos).astype("<u4")
                for p, (s, n) in enumerate(cuts(len(own), capacity)):
                    raw = own[s:s + n].tobytes()
                    b, at = packer.place(n)
                    rows.append((doc_ids[lo + i], p, s, n, zlib.crc32(raw), task << 32 | b, at, raw if keep_ids else None))
            yield to_batch(_PIECES, *zip(*rows))
    open_now = packer.left_open()
    if open_now:  # piece -1: an open bin and how full it is
        b, used = zip(*open_now)
        n = len(b)
        none = [None] * n
        yield to_batch(_PIECES, none, [-1] * n, none, list(used), none, [task << 32 | x for x in b], none, none)


MOVED = pa.schema([("sequence_id", pa.int64()), ("into", pa.int64()), ("base", pa.int64())])


def _merge(capacity: int, open_bins: int, batches):
    """Open bins of a group of tasks, packed as they are: (sequence_id, into, base)."""
    packers: dict[int, BestFit] = {}
    names: dict[tuple[int, int], int] = {}
    for batch in batches:
        out = []
        for group, seq, used in zip(*(c.to_pylist() for c in batch.columns)):
            packer = packers.setdefault(group, BestFit(capacity, open_bins))
            b, at = packer.place(used)
            out.append((seq, names.setdefault((group, b), seq), at))
        if out:
            yield to_batch(MOVED, *zip(*out))


def pack(
    docs: DataFrame, name: str = VOCABULARY, capacity: int = CAPACITY, eos: int = EOS,
    open_bins: int = OPEN_BINS, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents and their place in sequences of at most ``capacity`` tokens.

    Every task packs its own documents online; what it leaves open is then packed with the open
    bins of up to ``TASKS`` tasks.  A null or empty text is its end id alone.  Rows are independent:
    null, tied or repeated doc_ids give pieces of their own.  ``keep_ids`` adds the ids of each
    piece as little-endian unsigned 32-bit numbers (column ``ids``).  Other columns aren't read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(text.mapInArrow(partial(_pack, name, capacity, eos, open_bins, keep_ids), PIECES + ", ids binary"), "pieces")
    left = rows.where("piece = -1").select(
        F.floor(F.shiftright("sequence_id", 32) / TASKS).alias("group"), "sequence_id", F.col("length").alias("used"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = left.repartition(n, "group").sortWithinPartitions("group", F.desc("used"), "sequence_id").mapInArrow(
        partial(_merge, capacity, open_bins), "sequence_id long, into long, base long")
    out = rows.where("piece >= 0").join(moved, "sequence_id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), "ids")
    return out if keep_ids else out.drop("ids")
