"""Operator 10: token counts by prefix dynamic programming.

``prefix_counts`` stores the exact token count of every character prefix of
every whole text (one little-endian int32 each, the prefix of 0 characters
first). The total is the last entry; "how many tokens are the first k
characters", "how much text fits a budget" and "where do chunks of at most B
tokens end" are answered from the stored counts without encoding again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from flowlens.llm.common import text_of
from flowlens.llm.tokens import prefix_bpe

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def _each(batches, vocabulary: str, answer):
    """Batches with the text column replaced by what ``answer`` makes of its
    prefix counts."""
    bpe = prefix_bpe(vocabulary)
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("_text"))
        for i in range(0, len(texts), 200):  # bounds what is held at once
            part = texts.slice(i, 200)
            counts = bpe.many(part.to_pylist())
            keep = [batch.column(k).slice(i, 200) for k, n in enumerate(names) if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*keep, *answer(part, counts)], names=[*[n for n in names if n != "_text"], *answer.names])


class _Store:
    names = ("n_bytes", "n_tokens", "prefix_tokens")

    def __call__(self, texts, counts):
        return [pc.binary_length(texts).cast(pa.int64()),
                pa.array([int(c[-1]) for c in counts], pa.int64()),
                pa.array([c.tobytes() for c in counts], pa.binary())]


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_bytes``, ``n_tokens`` and
    ``prefix_tokens`` (columns of these names in ``docs`` are replaced).

    Null or empty text: 0 bytes, 0 tokens, one stored entry (0). Repeated rows
    are answered each. Narrow: no shuffle; a task holds 200 texts at a time.
    """
    made = {"n_bytes", "n_tokens", "prefix_tokens", "_text"}
    kept = [c for c in docs.columns if c != text and c not in made]
    src = docs.select(*kept, text_of(docs, text).alias("_text"))
    schema = StructType([*[src.schema[c] for c in kept], StructField("n_bytes", LongType()),
                         StructField("n_tokens", LongType()), StructField("prefix_tokens", BinaryType())])
    return src.mapInArrow(lambda it: _each(it, vocabulary, _Store()), schema)


def tokens_of_prefix(chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first ``chars`` characters, read from the stored counts
    (null beyond the text)."""
    at = F.lit(chars) if isinstance(chars, int) else chars
    four = F.substring(F.col(prefix_tokens), (at * 4 + 1).cast("int"), F.lit(4))
    value = F.conv(F.concat(*[F.hex(F.substring(four, F.lit(k), F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10)
    return F.when((at >= 0) & (F.octet_length(four) == 4), value.cast("long"))


def longest_prefix(prefix_tokens: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(np.frombuffer(prefix_tokens, dtype="<i4") <= budget)[-1])


def truncations(stored: DataFrame, budget: int) -> DataFrame:
    """Adds ``budget_chars``: the characters of the longest prefix that has at
    most ``budget`` tokens (the whole text if it fits). ``budget`` >= 0."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    kept = [c for c in stored.columns if c != "budget_chars"]
    src = stored.select(*kept)
    schema = StructType([*src.schema.fields, StructField("budget_chars", LongType())])

    def run(batches):
        for b in batches:
            at = b.schema.names.index("prefix_tokens")
            cut = [None if v is None else longest_prefix(v, budget) for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cut, pa.int64())],
                                             names=[*b.schema.names, "budget_chars"])

    return src.mapInArrow(run, schema)
