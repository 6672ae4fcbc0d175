"""Operator 1: toxicity grades by cumulative-link ordinal regression.

Features are hashed words and 4-byte runs inside words (lower-cased, the start of
a word marked), each counted once per document. The model is
``P(grade > k) = 1 / (1 + exp(cut_k - w.x))``: one weight vector shared by all
cuts, cuts in ascending order. A document's expected severity is the sum of
these probabilities, between 0 and the highest grade.

Fitted on a bounded sample of labelled documents (``SAMPLE``); features are
chosen by how much they tell about the grades in the sample (at most
``FEATURES``). All documents are scored in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType)

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import ALNUM_WORDS, Prefix, blocks, buffer, words

#: labelled documents that the model is fitted on, at most
SAMPLE = 24_000
#: hash range and number of chosen features
SPACE, FEATURES = 1 << 20, 2000
#: documents of the sample that hold a chosen feature, at least
SUPPORT = 8
#: a chosen feature is so many times as frequent, or as rare, in graded documents
LIFT = 2.0
GRADES = 4
#: one in so many sample documents is held out to set the decision threshold
HELD_OUT = 5
_WORD, _RUN = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)


def features(raw: np.ndarray, offsets: np.ndarray):
    """(document, feature) of every word and every 4-byte run, repeats included,
    and the words per document."""
    starts, ends, first = words(raw, offsets, ALNUM_WORDS)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.diff(first)
    pre = Prefix(raw, fold=True)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    of, ids = [doc], [pre.window(starts, ends) ^ _WORD]
    n = np.maximum(ends - starts - 3, 0)
    some = np.flatnonzero(n)
    if len(some):
        n = n[some]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[some], n) + inside
        of.append(np.repeat(doc[some], n))
        ids.append(pre.window(at, at + 4) ^ _RUN ^ (inside == 0).astype(np.uint64))
    return (np.concatenate(of), (np.concatenate(ids) % np.uint64(SPACE)).astype(np.int64), np.diff(first))


def _documents(batches, at: int):
    """(batch, first row, rows, documents, features, words) in bounded parts."""
    for batch in batches:
        raw, offsets = buffer(batch.column(at))
        for i, j in blocks(offsets):
            yield batch, i, j, *features(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def _once(doc: np.ndarray, feature: np.ndarray):
    """Each (document, feature) once, ordered."""
    key = np.unique(doc * np.int64(SPACE) + feature)
    return key // SPACE, key % SPACE


def feature_counts(sample: DataFrame, grades: int) -> DataFrame:
    """Documents of each grade that hold a feature: ``feature, n_0, n_1, ...``; added
    up per task first, at most ``SPACE`` rows in all."""
    schema = StructType([StructField("feature", LongType()), *[StructField(f"n_{g}", LongType()) for g in range(grades)]])

    def run(batches):
        count = np.zeros((SPACE, grades), dtype=np.int32)
        for batch, i, j, doc, feature, _ in _documents(batches, 2):
            grade = batch.column(1).slice(i, j - i).to_numpy()
            d, f = _once(doc, feature)
            np.add.at(count, (f, grade[d]), 1)
        there = np.flatnonzero(count.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there)] + [pa.array(count[there, g].astype(np.int64))
                                                              for g in range(grades)], names=schema.names)

    return sample.select("doc_id", "grade", "_text").mapInArrow(run, schema).groupBy("feature").agg(
        *[F.sum(f"n_{g}").alias(f"n_{g}") for g in range(grades)])


@dataclass
class Model:
    """Feature numbers, their shared weights, ascending cuts, decision threshold."""
    chosen: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5
    held_out: dict = field(default_factory=dict)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, size: int, grades: int, steps: int = 400,
        penalty: float = 2e-3, rate: float = 0.05):
    """Weights and cuts that maximise the penalised likelihood of the grades (Adam on
    the whole sample). ``doc, feature``: the ones of a sparse 0/1 matrix."""
    n = len(grade)
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, tail = theta[:size], theta[size:]
        cuts = tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))])
        score = np.bincount(doc, weights=w[feature], minlength=n)
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))  # P(grade > k)
        full = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
        p = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))])
        low, high = slope[rows, grade], slope[rows, grade + 1]
        d_score = -(low - high) / p / n
        d_cut = np.zeros(grades + 1)
        np.add.at(d_cut, grade, low / p / n)
        np.add.at(d_cut, grade + 1, -high / p / n)
        d_cut = d_cut[1:grades]
        down = np.cumsum(d_cut[::-1])[::-1]  # a step between cuts moves all later ones
        grad = np.concatenate([np.bincount(feature, weights=d_score[doc], minlength=size) + penalty * w,
                               down[:1], down[1:] * np.exp(tail[1:])])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    tail = theta[size:]
    return theta[:size], tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))])


def sampled(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, text: str = "text",
            key: str = "doc_id") -> DataFrame:
    """``doc_id, grade, _text`` of at most ``sample`` labelled documents, those of
    the smallest hash. Several labels of one key count as the highest."""
    one = graded.where(F.col("grade").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.max("grade").cast("int").alias("grade"))
    few = one.orderBy(F.xxhash64("_k", F.lit(3)), "_k").limit(sample)  # the fit's documented bound
    return docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("_text")).join(
        F.broadcast(few), F.col("doc_id") == F.col("_k")).select("doc_id", "grade", "_text").dropDuplicates(["doc_id"])


def severity_grades(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text",
                    key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Grades 0..3 where labels tell only toxic or not: 0 not toxic; toxic documents
    1, 2 or 3 by thirds of how many of their words' features occur in toxic
    documents of the sample alone, per 100 words."""
    two = sampled(docs, labels.select(key, F.col(label).alias("grade")), sample, text, key)
    counts = feature_counts(two, 2)
    telling = [r["feature"] for r in counts.where((F.col("n_0") == 0) & (F.col("n_1") >= SUPPORT)).select("feature")
               .orderBy(F.desc("n_1"), "feature").limit(FEATURES).collect()]
    lookup = np.zeros(SPACE, dtype=bool)
    lookup[telling] = True

    def run(batches):
        for batch, i, j, doc, feature, n in _documents(batches, 2):
            rate = np.bincount(doc[lookup[feature]], minlength=j - i) * 100 / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                                              pa.array(rate)], names=["doc_id", "toxic", "rate"])

    kind = two.schema["doc_id"].dataType
    rated = staged(two.mapInArrow(run, StructType([StructField("doc_id", kind), StructField("toxic", IntegerType()),
                                                   StructField("rate", DoubleType())])), "toxic-rates")
    cut = rated.where("toxic > 0").agg(F.percentile("rate", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).first()["q"]
    cut = cut or [0.0, 0.0]
    grade = F.when(F.col("toxic") <= 0, 0).when(F.col("rate") <= cut[0], 1).when(F.col("rate") <= cut[1], 2).otherwise(3)
    return rated.select(F.col("doc_id").alias(key), grade.alias("grade"))


def train(docs: DataFrame, graded: DataFrame, grades: int = GRADES, sample: int = SAMPLE, text: str = "text",
          key: str = "doc_id") -> Model | None:
    """Model from documents with grades 0..grades-1 (``key, grade``); None if the
    sample has a single grade."""
    rows = staged(sampled(docs, graded, sample, text, key), "toxic-sample")
    total = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    n = sum(total.values())
    # chi-square of feature against grade
    with_ = sum((F.col(f"n_{g}") for g in range(grades)), F.lit(0))
    tell = F.lit(0.0)
    for g in range(grades):
        if total.get(g):
            expect = with_ * F.lit(total[g] / n)
            tell = tell + (F.col(f"n_{g}") - expect) * (F.col(f"n_{g}") - expect) / expect
    # rates among graded and ungraded documents, half a document added to each
    some = n - total.get(0, 0)
    ratio = ((with_ - F.col("n_0") + 0.5) / F.lit(some + 1.0)) / ((F.col("n_0") + 0.5) / F.lit(total.get(0, 0) + 1.0))
    chosen = [r["feature"] for r in feature_counts(rows, grades).where(with_ >= SUPPORT)
              .where((ratio >= LIFT) | (ratio <= 1 / LIFT))
              .orderBy(F.desc(tell), "feature").limit(FEATURES).select("feature").collect()]
    if not chosen:
        return None
    chosen = np.array(sorted(chosen), dtype=np.int64)
    slot = np.full(SPACE, -1, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))

    def run(batches):
        for batch, i, j, doc, feature, _ in _documents(batches, 2):
            keep = slot[feature] >= 0
            d, f = _once(doc[keep], feature[keep])
            f, ends = slot[f].astype("<i4"), np.searchsorted(d, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                 pa.array([f[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                names=["doc_id", "grade", "features"])

    matrix = rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("grade", IntegerType()),
                                              StructField("features", BinaryType())]))
    got = matrix.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HELD_OUT)) == 0).orderBy(
        "doc_id").collect()  # the bounded sample: at most `sample` rows of chosen features

    def ones(rows_):
        ids = [np.frombuffer(r["features"], dtype="<i4") for r in rows_]
        return (np.repeat(np.arange(len(rows_)), [len(x) for x in ids]),
                np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64),
                np.array([r["grade"] for r in rows_], dtype=np.int64))

    fitted = [r for r in got if not r["held"]] or got
    if len({r["grade"] for r in fitted}) < 2:
        fitted = got
    w, cuts = fit(*ones(fitted), len(chosen), grades)
    model = Model(chosen, w, cuts)
    held = [r for r in got if r["held"]] or got
    doc, feature, grade = ones(held)
    p = model.above(np.bincount(doc, weights=w[feature], minlength=len(held)))[:, 0]
    best = (-1.0, 0.5)
    for t in np.unique(np.concatenate([[0.5], (np.sort(p)[1:] + np.sort(p)[:-1]) / 2])):
        hit, true = p >= t, grade > 0
        f1 = 2 * (hit & true).sum() / max(1, hit.sum() + true.sum())
        if (f1, -abs(t - 0.5)) > (best[0], -abs(best[1] - 0.5)):
            best = (float(f1), float(t))
    model.threshold = best[1]
    model.held_out = {"f1": best[0], "n": len(held),
                      "mean_grade_error": float(np.abs(model.above(np.bincount(
                          doc, weights=w[feature], minlength=len(held))).sum(axis=1) - grade).mean())}
    return model


def scored(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, expected_severity, p_above_0, ..., grade, toxic`` of every
    document. ``grade``: the expected severity rounded; ``toxic``: ``p_above_0`` at
    least the model's threshold. A text without a known feature (null and
    empty ones among them) holds nothing to grade: severity 0, not toxic;
    without a model all are. Repeated rows are scored each."""
    src = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("_text"))
    cuts = len(model.cuts) if model else GRADES - 1
    schema = StructType([src.schema["doc_id"], StructField("n_words", LongType()),
                         StructField("expected_severity", DoubleType()),
                         *[StructField(f"p_above_{k}", DoubleType()) for k in range(cuts)],
                         StructField("grade", IntegerType()), StructField("toxic", BooleanType())])

    def run(batches):
        slot = np.full(SPACE, -1, dtype=np.int32)
        if model:
            slot[model.chosen] = np.arange(len(model.chosen))
        for batch, i, j, doc, feature, n in _documents(batches, 1):
            keep = slot[feature] >= 0
            d, f = _once(doc[keep], feature[keep])
            p = np.zeros((j - i, cuts))
            if len(d):
                some = np.unique(d)
                p[some] = model.above(np.bincount(d, weights=model.weights[slot[f]], minlength=j - i))[some]
            expected = np.round(p.sum(axis=1), 6)
            toxic = (p[:, 0] >= model.threshold) & (p[:, 0] > 0) if model else np.zeros(j - i, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(expected),
                 *(pa.array(np.round(p[:, k], 6)) for k in range(cuts)),
                 pa.array(np.rint(expected).astype(np.int32)), pa.array(toxic)], names=schema.names)

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id",
             label: str = "toxic") -> tuple[DataFrame, Model | None]:
    """``(scores, model)`` of all documents, from labels toxic or not."""
    graded = severity_grades(docs, labels, sample, text, key, label)
    model = train(docs, graded, GRADES, sample, text, key)
    return scored(docs, model, text, key), model
