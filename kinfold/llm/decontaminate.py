"""Operator 6: benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U
from kinfold.llm.common import to_batch

WINDOW = 10
#: Bytes of benchmark text that one broadcast may come from; a larger benchmark takes several passes.
BLOCK_BYTES = 8_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FILTER_BITS = 22


def normal(raw: bytes) -> bytes:
    """Lower-cased words of a span, joined by spaces."""
    return b" ".join(_WORD.findall(raw.lower()))


class Windows:
    """The distinct windows of a block of benchmark items: hashes by length, words, and their items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        hashes, words, item, length = [], [], [], []
        for lo, _, data, off in A.chunks(column):
            s, e, rows = A.spans(data, off, A.ALNUM)
            h = A.span_hash(A.prefix(data, A.VALUES_LOWER), s, e)
            n_words = np.bincount(rows, minlength=len(off) - 1)
            for n in range(1, size + 1):
                at, x = A.windows(h, rows, n)
                if n < size:
                    own = n_words[rows[at]] == n
                    at, x = at[own], x[own]
                hashes.append(x)
                item.append(rows[at] + lo)
                length.append(np.full(len(at), n))
                words += [normal(data[s[i]:e[i + n - 1]].tobytes()) for i in at]
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        length = np.concatenate(length) if length else item
        order = np.argsort(h, kind="stable")
        self.hash, first, n = np.unique(h[order], return_index=True, return_counts=True)
        self.items, self.edge = item[order], np.append(first, len(h))
        self.words = [words[order[i]] for i in first]
        self.sizes = sorted(set(length.tolist()))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.hash >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``h``, window) of every hash that is in the set."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        good = self.hash[at] == h[maybe]
        return maybe[good], at[good]


def blocks(benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """Window sets of ``benchmark`` (item_id, text), each from about ``block_bytes`` of text at most.

    Items are dealt by hash, so an item lies in one block whole; null and wordless texts give nothing.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    items = items.distinct()  # repeated rows give the same windows and would lie in one block
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield Windows([tuple(r) for r in part.collect()], size)


NEW = ("__hit_words", "__hit_items", "__n_words", "__n_hit", "__hit_spans")


def _scan(shared, at: int, first: bool, batches):
    wanted: Windows = shared.value
    for batch in batches:
        n_old = batch.num_columns - (0 if first else len(NEW))
        text = batch.column(at)
        old_runs = None if first else batch.column(n_old).to_pylist()
        old_items = None if first else batch.column(n_old + 1).to_pylist()
        runs_out, items_out, words_out, hit_out, spans_out = [], [], [], [], []
        known: dict[bytes, bytes] = {}
        for lo, hi, data, off in A.chunks(text):
            s, e, rows = A.spans(data, off, A.ALNUM)
            h = A.span_hash(A.prefix(data, A.VALUES_LOWER), s, e)
            n_words = np.bincount(rows, minlength=hi - lo)
            hit, found = np.zeros(len(s), bool), []
            for n in wanted.sizes:
                start, x = A.windows(h, rows, n)
                i, w = wanted.find(x)
                for p, k in zip(start[i].tolist(), w.tolist()):
                    raw = data[s[p]:e[p + n - 1]].tobytes()
                    words = known.get(raw)
                    if words is None:
                        words = known[raw] = normal(raw)
                    if words == wanted.words[k]:
                        hit[p:p + n] = True
                        found.append((int(rows[p]), k))
            names: dict[int, set] = {}
            for row, k in set(found):
                names.setdefault(row, set()).update(wanted.items[wanted.edge[k]:wanted.edge[k + 1]].tolist())
            edge = np.searchsorted(s, off)
            touched = np.zeros(hi - lo, bool)
            touched[rows[hit]] = True
            for r in range(hi - lo):
                a, b = edge[r], edge[r + 1]
                before = [] if first else old_runs[lo + r]
                if not touched[r] and not before:
                    runs_out.append([]), spans_out.append([]), items_out.append([])
                    hit_out.append(0)
                    continue
                flags = np.zeros(b - a + 2, bool)
                flags[1:-1] = hit[a:b]
                for x, y in zip(before[::2], before[1::2]):
                    flags[x + 1:y + 1] = True
                turn = np.flatnonzero(flags[1:] != flags[:-1])
                runs_out.append(turn.tolist())
                hit_out.append(int(flags.sum()))
                spans_out.append([
                    {"start": int(s[a + x] - off[r]), "end": int(e[a + y - 1] - off[r])}
                    for x, y in zip(turn[::2], turn[1::2])
                ])
                own = {wanted.ids[i] for i in names.get(r, ())} - {None}
                items_out.append(sorted(own | set([] if first else old_items[lo + r])))
            words_out.append(n_words)
        n_words = np.concatenate(words_out) if words_out else np.zeros(0, np.int64)
        columns = [batch.column(i) for i in range(n_old)] + [
            pa.array(runs_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string())),
            pa.array(n_words, pa.int64()), pa.array(hit_out, pa.int64()),
            pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n_old] + list(NEW))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with its hits: word runs, item ids, word counts and byte spans (columns ``NEW``).

    A window is ``size`` consecutive words of an item, or all words of a shorter one; a hash hit
    counts only if the words are equal.  Null texts have no word.  Repeated rows are scanned alike;
    items that share an id count as one, items without an id mark words but name nothing.
    """
    at, old = docs.columns.index("text"), docs.schema.fields
    schema = T.StructType(old + T._parse_datatype_string(
        "__hit_words array<int>, __hit_items array<string>, __n_words long, __n_hit long, "
        "__hit_spans array<struct<start: int, end: int>>").fields)
    out, first = docs, True
    for block in blocks(benchmark, size, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(partial(_scan, shared, at, first), schema)
        first = False
    return out


def _cut(at: int, n_columns: int, batches):
    for batch in batches:
        text, spans = batch.column(at).to_pylist(), batch.column(n_columns + 4).to_pylist()
        for i, cut in enumerate(spans):
            if cut:
                raw, kept, last = text[i].encode(), [], 0
                for span in cut:
                    kept.append(raw[last:span["start"]])
                    last = span["end"]
                text[i] = b"".join([*kept, raw[last:]]).decode()
        columns = [batch.column(i) for i in range(n_columns)]
        columns[at] = pa.array(text, batch.column(at).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n_columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW) -> DataFrame:
    """``docs`` without its benchmark passages: whole documents or only the hit spans go."""
    # other columns may have any names, also those of the hits
    plain = docs.toDF(*["text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    found = scan(plain, benchmark, size)
    if mode == "documents":
        return found.where("__n_hit = 0").drop(*NEW).toDF(*docs.columns)
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents or spans")
    return found.mapInArrow(partial(_cut, docs.columns.index("text"), len(docs.columns)), docs.schema)


REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
])


def _report(batches):
    for batch in batches:
        items = batch.column(1).to_pylist()
        digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        hit = batch.column(3).to_numpy()
        yield to_batch(REPORT, batch.column(0), batch.column(2), hit, [len(i) for i in items], digest, hit > 0)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and their digest."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scan(text, benchmark).select("doc_id", "__hit_items", "__n_words", "__n_hit")
    return found.mapInArrow(
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
