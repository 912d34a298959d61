"""Texts as byte arrays: words, lines and spans of a whole Arrow batch, hashed without a row loop."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (in place on a fresh array)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        p = np.full(max(n, CHUNK_BYTES + 1024), base, dtype=U)
        p[0] = U(1)
        held = _POWERS[int(base)] = np.cumprod(p)
    return held[:n]


def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z share those of a-z if ``lower``."""
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if lower:
        v[65:91] = v[97:123]
    return v


def word_class(pattern_out: str) -> np.ndarray:
    """Bytes that belong to a word: all but the characters of ``pattern_out``."""
    t = np.ones(256, dtype=bool)
    t[[ord(c) for c in pattern_out]] = False
    return t


#: Word characters of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = word_class(" \t\n\x0b\x0c\r")
#: Word characters of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = word_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
VALUES, VALUES_LOWER = byte_values(False), byte_values(True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (one long text is a range of its own)."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 60_000)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
    trim()


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``inside`` bytes; runs never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    edges = off[(off > 0) & (off < n)]
    before[edges] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, rows_of(starts, off)


def rows_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row of each of the sorted positions."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def prefix(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    p = np.empty(len(data) + 1, U)
    p[0] = 0
    v = values[data]
    v *= powers(_BASE, len(data))
    np.cumsum(v, out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((p[ends] - p[starts]) * powers(_INVERSE, len(p))[starts])


_STEP = [U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB),
         U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F), U(0xEB44ACCAB455D165),
         U(0xD6E8FEB86659FD93), U(0xCA9B0C7EBA1DA115)]


def windows(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every window of ``size`` words inside one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    h = words[at] * _STEP[0]
    for i in range(1, size):
        h += words[at + i] * _STEP[i % 10]
    return at, mix(h + U(size))


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)
