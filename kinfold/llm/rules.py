"""Operator 3: quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U
from kinfold.llm.common import to_batch

# Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUPLICATE_LINE_PERCENT = 50
MAX_CAPITAL_PERCENT = 40
MEAN_WORD_CHARS = (2, 20)
SYMBOLS = "#*$%&|<>"
#: Rows from which cost and rejection are estimated; they decide the order only, never a verdict.
SAMPLE_ROWS = 400

_SYMBOL = ~A.word_class(SYMBOLS)
_LINE = A.word_class("\n")
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


class Texts:
    """The texts of a chunk, with what several rules need computed once, on first use."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._words = self._prefix = None

    @property
    def words(self):
        if self._words is None:
            self._words = A.spans(self.data, self.off, A.NOT_SPACE)
        return self._words

    @property
    def prefix(self):
        if self._prefix is None:
            self._prefix = A.prefix(self.data, A.VALUES)
        return self._prefix

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def n_words(self):
        return A.counts(self.words[2], self.n)

    def word_chars(self):
        return self.per_row(A.NOT_SPACE[self.data] & _LEAD[self.data])

    def n_symbols(self):
        return self.per_row(_SYMBOL[self.data])

    def capitals(self):
        return self.per_row(_UPPER[self.data]), self.per_row(_LOWER[self.data])

    def lines(self):
        """Lines with a word, and how many of them equal an earlier line of their text."""
        s, e, rows = A.spans(self.data, self.off, _LINE)
        w = self.words[0]
        real = np.searchsorted(w, e) > np.searchsorted(w, s)
        s, e, rows = s[real], e[real], rows[real]
        key = A.mix(A.span_hash(self.prefix, s, e) + A.mix(rows.astype(U)))
        first = np.unique(key, return_index=True)[1]
        total = A.counts(rows, self.n)
        return total, total - A.counts(rows[first], self.n)

    def n_repeat_words(self):
        """Words inside 3-word windows that their text holds twice or more."""
        s, e, rows = self.words
        at, h = A.windows(A.span_hash(self.prefix, s, e), rows, 3)
        hit = np.zeros(len(s), bool)
        if len(at):
            key = A.mix(h + A.mix(rows[at].astype(U)))
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            again = at[n[inverse] > 1]
            for i in range(3):
                hit[again + i] = True
        return A.counts(rows[hit], self.n)

    def take(self, rows: np.ndarray) -> Texts:
        if rows.all():
            return self
        size = np.diff(self.off)
        return Texts(self.data[np.repeat(rows, size)], np.concatenate([[0], np.cumsum(size[rows])]))


def few_words(t: Texts):
    return t.n_words() < MIN_WORDS


def repeated_words(t: Texts):
    return 100 * t.n_repeat_words() > MAX_REPEAT_PERCENT * t.n_words()


def symbol_heavy(t: Texts):
    return 100 * t.n_symbols() > MAX_SYMBOLS_PER_100_WORDS * t.n_words()


def duplicate_lines(t: Texts):
    total, again = t.lines()
    return 100 * again > MAX_DUPLICATE_LINE_PERCENT * total


def shouting(t: Texts):
    upper, lower = t.capitals()
    return 100 * upper > MAX_CAPITAL_PERCENT * (upper + lower)


def odd_word_length(t: Texts):
    n, chars = t.n_words(), t.word_chars()
    return (chars < MEAN_WORD_CHARS[0] * n) | (chars > MEAN_WORD_CHARS[1] * n)


BASE = (few_words, repeated_words)
RULES = (few_words, repeated_words, symbol_heavy, duplicate_lines, shouting, odd_word_length)
Rule = Callable[[Texts], np.ndarray]


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected texts per second on a bounded sample, best first.

    The order changes what the cascade costs, not what it keeps: a text stays if no rule rejects it.
    """
    column = docs.select(F.col("text").cast("string").alias("text")).limit(rows).toArrow().column(0)
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    rank = {}
    for rule in rules:
        gone, start = 0, time.perf_counter()
        for _, _, data, off in A.chunks(column):
            gone += int(rule(Texts(data, off)).sum())
        rank[rule] = (gone + 0.5) / (time.perf_counter() - start + 1e-6)
    return sorted(rules, key=lambda r: -rank[r])


def cascade(t: Texts, rules: list[Rule]) -> np.ndarray:
    """Which texts every rule lets pass; a rule sees only what the rules before it kept."""
    alive = np.ones(t.n, bool)
    for rule in rules:
        if not t.n:
            break
        good = ~rule(t)
        alive[np.flatnonzero(alive)[~good]] = False
        t = t.take(good)
    return alive


SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
])


def _score(rules: list[Rule], batches):
    for batch in batches:
        for lo, hi, data, off in A.chunks(batch.column(1)):
            t = Texts(data, off)
            n, repeats = t.n_words(), t.n_repeat_words()
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            kept = ~failed
            kept[kept] = cascade(t.take(~failed), rules)
            yield to_batch(SCORED, batch.column(0).slice(lo, hi - lo), n, t.word_chars(), t.n_symbols(),
                           t.lines()[1], repeats, failed, kept)


def score_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, ...).

    Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have no word and fail.  ``base_failed``
    holds the two base rules; ``kept`` is false there, else the verdict of the other rules.  Repeated
    rows are scored alike, ids may be null or tied, and other columns aren't read.
    """
    rules = order_rules(docs, tuple(r for r in RULES if r not in BASE))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(
        partial(_score, rules),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
    )


def _keep(rules: list[Rule], at: int, batches):
    for batch in batches:
        kept = [cascade(Texts(data, off), rules) for _, _, data, off in A.chunks(batch.column(at))]
        yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns; null texts fail."""
    return docs.mapInArrow(partial(_keep, order_rules(docs, rules), docs.columns.index("text")), docs.schema)


def keep_passing(docs: DataFrame, rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of ``docs`` that pass ``rules`` taken as they stand, without a sample; all columns stay."""
    return docs.mapInArrow(partial(_keep, list(rules), docs.columns.index("text")), docs.schema)
