"""Operator 5: quality rules as a learned decision list.

Every text is measured; a bounded grid of thresholds turns the measures of the
labelled documents into counts per grid cell (all labelled rows, added up by
Spark); sequential covering on these counts grows conjunctions of thresholds by
information gain, prunes them on rows held back, and emits the ordered list as
one Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import SPACE_WORDS, Prefix, blocks, buffer, shingles, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: measures per word or line that rules may test, and the thresholds they may use
GRID = {
    "n_words": (20, 50, 100, 200, 400, 1000),
    "symbols_per_word": (0.01, 0.03, 0.1, 0.2, 0.4, 0.8),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "mean_word_chars": (2.0, 3.0, 4.0, 5.0, 6.5, 8.0),
    "upper_share": (0.03, 0.1, 0.2, 0.35, 0.6),
}
MAX_RULES, MAX_TESTS = 8, 4
#: share of rejected among the labelled documents that a rule covers, at least
PRECISION = 0.9
#: labelled documents to reject that a rule covers, at least
SUPPORT = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(raw: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
    """The measures of the documents of one buffer, one row each."""
    docs = len(offsets) - 1
    out = np.zeros((docs, len(MEASURES)), dtype=np.int64)
    if not len(raw):
        return out
    starts, ends, first = words(raw, offsets, SPACE_WORDS)
    cum = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    between = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    out[:, 0] = np.diff(first)
    out[:, 1] = between(cum(SPACE_WORDS[raw] & ((raw & 0xC0) != 0x80)))
    out[:, 2] = between(cum(_SYMBOL[raw]))
    out[:, 6] = between(cum((raw >= 65) & (raw <= 90)))
    runs = shingles(Prefix(raw).window(starts, ends), 3)
    for d in range(docs):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= 4:
            _, which, count = np.unique(runs[a:b - 2], return_inverse=True, return_counts=True)
            hit = count[which] > 1
            if hit.any():
                inside = np.zeros(b - a, dtype=bool)
                for k in range(3):
                    inside[k:k + len(hit)] |= hit
                out[d, 4] = inside.sum()
        seen: set[str] = set()
        for line in texts[d].split("\n"):
            if line.strip(" \t\n\v\f\r"):
                out[d, 5] += 1
                if line in seen:
                    out[d, 3] += 1
                seen.add(line)
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text plus the measures (replacing columns of such names):
    words are runs without white space (space, tab, line feed, vertical tab,
    form feed, carriage return), ``n_dup_lines`` lines with a word that equal an
    earlier line, ``n_repeat_words`` words in 3-word windows that occur twice or
    more. Null and empty texts measure 0."""
    kept = [c for c in docs.columns if c != text and c not in (*MEASURES, "_text")]
    src = docs.select(*kept, text_of(docs, text).alias("_text"))
    schema = StructType([*[src.schema[c] for c in kept], *[StructField(m, LongType()) for m in MEASURES]])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept))
            raw, offsets = buffer(texts)
            texts = texts.to_pylist()
            for i, j in blocks(offsets):
                m = _measure(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(len(kept))),
                     *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(len(MEASURES)))], names=schema.names)

    return src.mapInArrow(run, schema)


def values() -> dict[str, Column]:
    """The testable values as expressions over the measures (0 where nothing is
    divided by)."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"n_words": F.col("n_words").cast("double"), "symbols_per_word": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
            "mean_word_chars": share("word_chars", "n_words"), "upper_share": share("n_upper", "word_chars")}


@dataclass(frozen=True)
class Test:
    value: str
    above: bool
    threshold: float

    def column(self) -> Column:
        v = values()[self.value]
        return v >= F.lit(float(self.threshold)) if self.above else v < F.lit(float(self.threshold))

    def __str__(self) -> str:
        return f"{self.value} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold; counts of the labelled documents it met."""
    tests: tuple[Test, ...]
    rejected: int
    kept: int

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.tests))} ({self.rejected} of {self.rejected + self.kept})"


def cell_counts(labelled: DataFrame, fold_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of ``bin_...`` per value, ``fold`` (2: held back for pruning), ``bad``,
    ``good``: at most (thresholds + 1) multiplied over the grid, times 3 folds,
    whatever the number of labelled rows."""
    v = values()
    bins = []
    for name, thresholds in GRID.items():
        at = F.lit(0)
        for t in thresholds:
            at = at + F.when(v[name] >= F.lit(float(t)), 1).otherwise(0)
        bins.append(at.alias(f"bin_{name}"))
    fold = F.pmod(F.xxhash64(fold_key), F.lit(3)).alias("fold")
    rows = labelled.where(F.col(label).isNotNull()).select(*bins, fold, F.col(label).alias("_l"))
    return rows.groupBy(*[f"bin_{n}" for n in GRID], "fold").agg(
        F.sum(F.when(F.col("_l") == 0, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("_l") != 0, 1).otherwise(0)).alias("good"))


def learn(cells: list[dict], max_rules: int = MAX_RULES, max_tests: int = MAX_TESTS, precision: float = PRECISION,
          support: int = SUPPORT) -> list[Rule]:
    """Sequential covering on cell counts; ends when no rule reaches ``precision``
    and ``support``. The order of the cells does not matter."""
    if not cells:
        return []
    names = list(GRID)
    bins = np.array([[c[f"bin_{n}"] for n in names] for c in cells])
    bad, good = (np.array([c[k] for c in cells], dtype=np.int64) for k in ("bad", "good"))
    held = np.array([c["fold"] for c in cells]) == 2
    every = [Test(n, above, t) for n in names for t in GRID[n] for above in (True, False)]

    def covers(t: Test) -> np.ndarray:
        k = GRID[t.value].index(t.threshold) + 1
        at = bins[:, names.index(t.value)]
        return at >= k if t.above else at < k

    masks = {t: covers(t) for t in every}
    left = np.ones(len(cells), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        now, tests = left & ~held, []
        p0, n0 = int(bad[now].sum()), int(good[now].sum())
        while p0 and n0 and len(tests) < max_tests:
            best = (0.0, None)
            for t in every:
                m = now & masks[t]
                p, n = int(bad[m].sum()), int(good[m].sum())
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, t)
            if best[1] is None:
                break
            tests.append(best[1])
            now = now & masks[best[1]]
            p0, n0 = int(bad[now].sum()), int(good[now].sum())
        if not tests:
            break

        def worth(k: int) -> float:
            m = left & held & np.logical_and.reduce([masks[t] for t in tests[:k]])
            p, n = int(bad[m].sum()), int(good[m].sum())
            return (p - n) / (p + n) if p + n else -1.0

        best_k = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        tests = tests[:best_k] if worth(best_k) > -1.0 else tests
        m = left & np.logical_and.reduce([masks[t] for t in tests])
        p, n = int(bad[m].sum()), int(good[m].sum())
        if p < support or p < precision * (p + n):
            break
        rules.append(Rule(tuple(tests), p, n))
        left &= ~m
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, else null, as one ordered
    conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        out = out.when(r.column(), F.lit(k))
    return out.cast("int")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality"):
    """``(rows, rules)``: every document (its other columns, without the text) with
    its measures, ``base_failed``, ``rule`` (the rejecting rule, null if none) and
    ``kept``; and the rules, learned from all labelled documents.

    Several labels of one key count as the lowest; null labels and keys without
    a document are left out; without labels no rule is learned and only the
    base decides.
    """
    rows = staged(measured(docs.drop("base_failed", "rule", "kept"), text), "measures")
    one = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_quality"))
    known = rows.join(one, rows[key] == one["_k"]).where(~base_failed())
    cells = cell_counts(known, key, "_quality")
    rules = learn([r.asDict() for r in cells.collect()])  # bounded by the grid
    out = rows.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
