"""Operator 4: token counts by rank-synchronous merging of ragged pre-token arrays."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.bpe import text_chunks, vocabulary
from kinfold.llm.common import to_batch

VOCABULARY = "byte_bpe_50k.json"
COUNTED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a vocabulary file in the installed package (each worker resolves its own)."""
    return public_tokenizers.path(name)


def _count(name: str, limit: int, batches):
    vocab = vocabulary(vocabulary_path(name))
    for batch in batches:
        n_bytes = np.diff(A.buffers(batch.column(1))[1])
        texts = batch.column(1).to_pylist()
        parts = [vocab.count(texts[lo:hi]) for lo, hi in text_chunks(texts)]
        n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield to_batch(COUNTED, batch.column(0), n_bytes, n, n > limit)


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text, ...).

    Counts equal those of the tokenizer library without added tokens; special strings inside a text
    are one token each.  Null texts count as empty (0 tokens).  Rows are independent, so null, tied
    and repeated ids need no care; other columns aren't read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(partial(_count, name, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
