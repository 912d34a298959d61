"""Operator 8: packed token-id matrices with segment lengths and positions, as binary columns."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.bpe import text_chunks, vocabulary
from kinfold.llm.common import to_batch
from kinfold.llm.tokens import VOCABULARY, vocabulary_path

CAPACITY, EOS, PAD = 1024, 50256, 50256
#: Ids held by a task at a time; each such group is packed by itself.
GROUP_IDS = 8 << 20


class FreeTree:
    """Segment tree over free capacities: how many bins have f places left, for each f."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, f: int, step: int) -> None:
        i = f + self.size
        while i:
            self.count[i] += step
            i >>= 1

    def tightest(self, n: int) -> int:
        """Least f >= n of any bin, or -1."""
        i = n + self.size
        if self.count[i]:
            return n
        while i > 1:  # up until a right neighbour holds a bin, then down to its first leaf
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i *= 2
                    if not self.count[i]:
                        i += 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the tightest bin."""
    tree, bins, free = FreeTree(capacity), [], [[] for _ in range(capacity + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        f = tree.tightest(n)
        if f < 0:
            bins.append([])
            b, f = len(bins) - 1, capacity
        else:
            b = free[f].pop()
            tree.add(f, -1)
        bins[b].append(i)
        if f > n:
            free[f - n].append(b)
            tree.add(f - n, 1)
    return bins


MATRIX = ("sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, "
          "cu_seqlens array<int>, input_ids binary, position_ids binary")
_MATRIX = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
    ("input_ids", pa.binary()), ("position_ids", pa.binary()),
])


def _matrix(name: str, capacity: int, eos: int, pad: int, batches):
    vocab, task, made = vocabulary(vocabulary_path(name)), TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, int, int, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal made
        place = np.arange(capacity, dtype="<u4")
        rows = []
        for items in best_fit_decreasing(np.array([len(h[3]) for h in held], np.int64), capacity):
            own = [held[i] for i in items]
            edge = np.concatenate([[0], np.cumsum([len(h[3]) for h in own])]).astype(np.int32)
            n = int(edge[-1])
            ids = np.full(capacity, pad, "<u4")
            ids[:n] = np.concatenate([h[3] for h in own])
            position = np.zeros(capacity, "<u4")
            for a, b in zip(edge[:-1], edge[1:]):
                position[a:b] = place[:b - a]
            rows.append((task << 32 | made, n, [h[0] for h in own], [h[1] for h in own], [h[2] for h in own],
                         edge.tolist(), ids.tobytes(), position.tobytes()))
            made += 1
            if len(rows) == 1000:
                yield to_batch(_MATRIX, *zip(*rows))
                rows = []
        if rows:
            yield to_batch(_MATRIX, *zip(*rows))
        held.clear()

    for batch in batches:
        texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for lo, hi in text_chunks(texts):
            ids, off = vocab.encode(texts[lo:hi])
            for i in range(hi - lo):
                own = np.append(ids[off[i]:off[i + 1]], eos).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    held.append((doc_ids[lo + i], p, s, own[s:s + capacity]))
                size += len(own)
            if size > GROUP_IDS:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def packed_matrices(
    docs: DataFrame, name: str = VOCABULARY, capacity: int = CAPACITY, eos: int = EOS, pad: int = PAD,
) -> DataFrame:
    """One row per packed sequence: which pieces it holds and its binary columns.

    ``input_ids`` and ``position_ids`` are ``capacity`` little-endian unsigned 32-bit numbers each
    (padding has id ``pad`` and position 0); positions start at 0 in every segment, and
    ``cu_seqlens`` has the segment edges.  Documents longer than ``capacity`` are split without
    loss.  Packing is best-fit-decreasing inside groups of about ``GROUP_IDS`` ids of a task.  A
    null or empty text is its end id alone; null, tied and repeated doc_ids are rows of their own;
    other columns aren't read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(partial(_matrix, name, capacity, eos, pad), MATRIX)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """Packed matrices as Parquet at ``path`` (any store Spark can write to)."""
    packed_matrices(docs, **options).write.parquet(path)
