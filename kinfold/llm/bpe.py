"""Byte-level BPE on ragged arrays: whole batches are cut into pre-tokens and merged together.

Pre-tokens follow the pattern of byte-level vocabularies (contractions, letters, numbers, other
characters, white space).  Each distinct pre-token of a batch is merged once; all of them take
every step at the same time, each applying its own lowest-ranked pair wherever it occurs.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Pre-tokens a worker remembers before it starts afresh.
CACHE = 300_000
CHUNK_CHARS = 1 << 20
_NONE = np.int32(1 << 30)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point by its general category; 0 where this Python knows no character."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    table = np.array([0 if k == "Cn" else kinds.get(k[0], OTHER) for k in names], np.uint8)
    table[[c for c in range(0x3001) if chr(c).isspace() and not 28 <= c <= 31]] = SPACE
    return table


def kinds_of(cp: np.ndarray) -> np.ndarray:
    """Classes of code points.  Those that are newer than this Python's character table are classed
    once by how the tokenizer library itself cuts them."""
    table = classes()
    kind = table[cp]
    if not kind.all():
        cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(cp[kind == 0]).tolist():
            inner = [x for _, x in cut("a" + chr(c) + "1")]
            table[c] = {((0, 2), (2, 3)): LETTER, ((0, 1), (1, 3)): NUMBER}.get(tuple(inner), OTHER)
        kind = table[cp]
    return kind


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabulary files use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretokens(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every pre-token of the code points ``cp``; texts begin at ``off``."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds_of(cp)
    begin = np.zeros(n + 1, bool)
    begin[off[off <= n]] = True
    start = begin[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.empty(n, bool)  # last character of its run
    last[:-1] = start[1:]
    last[-1] = True
    ends_text = begin[1:].copy()
    ends_text[-1] = True
    space = kind == SPACE
    # the last white space before other text stands alone, or leads the next token if it is a blank
    tail = space & last & ~ends_text
    start |= tail
    lead = tail & (cp == 32)
    after = np.flatnonzero(lead) + 1
    start[after] = False
    # contractions: a lone apostrophe at the start of a token, then s t m d or re ve ll
    quote = np.flatnonzero((cp == 39) & start & last)
    quote = quote[quote + 1 < n]
    quote = quote[~begin[quote + 1]]
    if len(quote):
        x = cp[quote + 1]
        one = np.isin(x, [ord(c) for c in "stmd"])
        far = np.minimum(quote + 2, n - 1)
        y = np.where((quote + 2 < n) & ~begin[far], cp[far], 0)
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for q, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[q + 1] = False
            stop = q + size
            stop = stop[stop < n]
            start[stop] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Merges of a byte-level vocabulary file and the ids of the pre-tokens seen so far."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        vocab, letters = model["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        # first step of the search: a slot of 2**20 by a hash of the pair, -1 if no pair falls there
        self._slot = np.full(1 << 20, -1, np.int32)
        self._slot[self._hash(self.key)] = np.arange(len(self.key))
        self._split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self._flat = self._edge = None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 20 | b
        at = self._slot[self._hash(k)]
        out = np.full(len(k), _NONE, np.int32)
        maybe = np.flatnonzero(at >= 0)
        at, k = at[maybe], k[maybe]
        good = self.key[at] == k
        out[maybe[good]] = self.rank[at[good]]
        rest = maybe[~good]  # another pair took the slot, or this is no pair
        at = np.minimum(np.searchsorted(self.key, k[~good]), len(self.key) - 1)
        out[rest] = np.where(self.key[at] == k[~good], self.rank[at], _NONE)
        return out

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key.astype(U) * U(0x9E3779B97F4A7C15) >> U(44)).astype(np.int64)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number after all merges of the sequences laid end to end in ``symbols``."""
        sym, seq = symbols, np.repeat(np.arange(len(sizes)), sizes)
        done_sym, done_seq = [], []
        while len(sym):
            pair = np.full(len(sym), _NONE, np.int32)
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            pair[inner] = self._ranks(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(pair, first)
            width = np.diff(np.append(first, len(sym)))
            least = np.repeat(least, width)
            over = least == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                go = ~over
                sym, seq, pair, least = sym[go], seq[go], pair[go], least[go]
                if not len(sym):
                    break
            hit = pair == least
            at = np.flatnonzero(hit)
            # neighbouring hits overlap (one symbol with itself): every other one of a run, from the left
            fresh = np.append(True, at[1:] != at[:-1] + 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym = sym.copy()
            sym[at] = self.new[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        seq = np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        return np.concatenate(done_sym)[order], np.bincount(seq, minlength=len(sizes))

    def _learn(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray, keys: list[int]) -> None:
        text = cp[np.repeat(s - np.concatenate([[0], np.cumsum(e - s)[:-1]]), e - s) + np.arange(int((e - s).sum()))]
        raw = np.frombuffer(text.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (text > 0x7F).astype(np.int64) + (text > 0x7FF) + (text > 0xFFFF)
        sizes = np.add.reduceat(width, np.concatenate([[0], np.cumsum(e - s)[:-1]]))
        ids, n = self.merge(self.byte_id[raw], sizes)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.ids.append(ids.astype(np.int32))
        self.size.append(n)
        self._flat = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if self._flat is None:
            self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
            self._flat, self._edge = self.ids[0], np.concatenate([[0], np.cumsum(self.size[0])])
        return self._flat, self._edge

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entry of every pre-token, text of it) for texts without special strings."""
        lengths = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate([[0], np.cumsum(lengths)])
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        s = pretokens(cp, off[:-1])
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = np.append(s[1:], len(cp))
        v = A.mix((cp + 1).astype(U))
        v *= A.powers(A._BASE, len(v))
        p = np.concatenate([np.zeros(1, U), np.cumsum(v)])
        h = A.span_hash(p, s, e)
        order = np.argsort(h, kind="stable")
        fresh = np.append(True, h[order][1:] != h[order][:-1])
        code = np.empty(len(h), np.int64)
        code[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        keys = h[first].tolist()
        if len(self.known) > CACHE:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            at = first[new]
            self._learn(cp, s[at], e[at], [keys[i] for i in new])
        known = self.known
        entry = np.array([known[k] for k in keys], np.int64)
        return entry[code], A.rows_of(s, off)

    def _pieces(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
        """Texts cut at special strings: parts, owner of each part, and (part before it, id) of each."""
        parts, owner, marks = [], [], []
        for i, t in enumerate(texts):
            last = 0
            for m in self._split.finditer(t) if self._split and t else ():
                parts.append(t[last:m.start()])
                owner.append(i)
                marks.append((len(parts) - 1, self.special[m[0]]))
                last = m.end()
            parts.append(t[last:] if t else "")
            owner.append(i)
        return parts, np.array(owner, np.int64), marks

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of every text; null counts as empty."""
        parts, owner, marks = self._pieces(texts)
        entry, part = self._encode(parts)
        total = np.bincount(owner[[m[0] for m in marks]], minlength=len(texts)) if marks else np.zeros(len(texts), np.int64)
        if len(entry):
            size = np.diff(self.table()[1])
            total = total + np.bincount(owner[part], weights=size[entry], minlength=len(texts)).astype(np.int64)
        return total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and where each text begins (one more offset than texts)."""
        parts, owner, marks = self._pieces(texts)
        entry, part = self._encode(parts)
        flat, edge = self.table() if len(entry) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        size = edge[entry + 1] - edge[entry] if len(entry) else entry
        stop = np.cumsum(size)
        ids = flat[np.repeat(edge[entry] - (stop - size), size) + np.arange(int(size.sum()))] if len(entry) else flat
        own = owner[part]
        if marks:
            where = np.concatenate([[0], stop])[np.searchsorted(part, [m[0] for m in marks], "right")]
            ids = np.insert(ids, where, [m[1] for m in marks])
        total = np.bincount(own, weights=size, minlength=len(texts)).astype(np.int64) if len(entry) else np.zeros(len(texts), np.int64)
        if marks:
            total += np.bincount(owner[[m[0] for m in marks]], minlength=len(texts))
        return ids, np.concatenate([[0], np.cumsum(total)])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
    A.trim()
