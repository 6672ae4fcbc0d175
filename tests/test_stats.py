"""E01-E14 and the rank helper against numpy / brute force on small data."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluation as ev
from flowlens.operators import ranking


@pytest.mark.parametrize("n", [1, 2, 5, 501, 1501, 2000])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.normal(size=n).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    lin = ranking.quantile_linear(df, "v", 0.995)
    assert lin == pytest.approx(float(np.percentile(vals, 99.5)), rel=1e-12, abs=1e-12)
    k = int(math.floor(0.999 * (n - 1) + 0.5))
    near = ranking.quantile_nearest(df, "v", 0.999)
    assert near == sorted(vals)[k]


def test_stacked_quantiles(spark):
    rng = np.random.default_rng(3)
    a, b = rng.exponential(size=700), rng.exponential(size=700) * 10
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    caps = ranking.nearest_quantiles_stacked(df, ["a", "b"], 0.999)
    k = int(math.floor(0.999 * 699 + 0.5))
    assert caps["a"] == sorted(a)[k] and caps["b"] == sorted(b)[k]


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(scores, labels):
    order = sorted(set(scores), reverse=True)
    P = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_ap_with_ties(spark):
    rng = np.random.default_rng(7)
    scores = [float(x) for x in rng.integers(0, 30, size=400)]       # many ties
    labels = [int(x) for x in (rng.random(400) < 0.3)]
    df = spark.createDataFrame(list(zip(scores, labels)), "s double, y int")
    got = ev.roc_auc_ap(ev.score_curve(df, "s", "y")).collect()[0]
    assert got["roc_auc"] == pytest.approx(brute_auc(scores, labels), rel=1e-12)
    assert got["average_precision"] == pytest.approx(brute_ap(scores, labels), rel=1e-12)


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    from pyspark.sql import functions as F
    m = ev.binary_metrics(ev.confusion_counts(df, "y", F.col("s") > 1)).collect()[0]
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = {r["feature"]: r for r in ev.fit_scaler(df, ["a", "b"]).collect()}
    assert rows["a"]["mean"] == 2.0 and rows["a"]["scale"] == 1.0     # population std of (1, 3)
    assert rows["b"]["scale"] == 1.0


@pytest.mark.parametrize("n,frac", [(10, 0.2), (1001, 0.2), (999, 0.1)])
def test_exact_split_sizes(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "k")
    out = ev.exact_split(df, "k", frac)
    valid = out.filter("split = 'valid'").count()
    assert valid == int(n * frac) and out.count() == n


def test_stratified_split(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = ev.stratified_split(df, "k", "y", 0.2)
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got[(1, "valid")] == 50 and got[(0, "valid")] == 150


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 4]], "e double")
    h = {r["bin"]: r["n"] for r in ev.error_histogram(df, "e", 4).collect()}
    assert h == dict(enumerate(np.histogram([0, 1, 2, 3, 4, 4], bins=4)[0].tolist()))


METRICS = __import__("os").environ.get("FLOWLENS_GOLDEN_METRICS", "")  # stored evaluation record (JSON)


@pytest.mark.skipif(not __import__("os").path.exists(METRICS), reason="golden record not supplied")
def test_binary_metrics_reproduce_stored_record(spark):
    """E04/E05 arithmetic on the stored confusion matrix gives the stored P/R/F1."""
    import json
    rec = json.load(open(METRICS))
    (tn, fp), (fn, tp) = rec["confusion_matrix"]
    cm = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    m = ev.binary_metrics(cm).collect()[0]
    assert m["precision"] == pytest.approx(rec["precision"], rel=1e-12)
    assert m["recall"] == pytest.approx(rec["recall"], rel=1e-12)
    assert m["f1"] == pytest.approx(rec["f1"], rel=1e-12)


@pytest.mark.parametrize("case", ["ties", "wide", "odd", "one", "tiny"])
def test_counting_selection(spark, case):
    from flowlens.operators.selection import kth
    rng = np.random.default_rng(7)
    vals = {"ties": [5.0] * 900 + list(rng.normal(size=100)), "wide": list(10.0 ** rng.uniform(-300, 300, 700)) + [-1.7e308, 1.7e308],
            "odd": [float("nan")] * 3 + [float("inf")] * 2 + [-float("inf")] + list(rng.normal(size=50)),
            "one": [3.0], "tiny": [5e-324 * i for i in range(40)]}[case]
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double").repartition(5)
    want = sorted(vals, key=lambda v: (math.isnan(v), v))
    ks = sorted({0, len(vals) // 3, len(vals) // 2, len(vals) - 1})
    n, found = kth(df, [F.col("v")], lambda n: ks)[0]
    assert n == len(vals)
    for k in ks:
        assert found[k].value == want[k] or math.isnan(want[k])
        if not math.isnan(want[k]):
            assert (found[k].below, found[k].equal) == (sum(v < want[k] for v in vals), vals.count(want[k]))


def test_selection_of_whole_numbers_and_empty(spark):
    from flowlens.operators.selection import kth
    vals = [-2**63, 2**63 - 1, 0, 7, 7, 7, -5]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    _, found = kth(df, [F.col("v")], lambda n: list(range(n)))[0]
    assert [found[k].value for k in range(7)] == sorted(vals)
    assert kth(df.limit(0), [F.col("v")], lambda n: [0]) == [(0, {})]


@pytest.mark.parametrize("keys", [[None] * 100, [1] * 90 + list(range(10)), [None] * 50 + list(range(50)), [3] * 100])
def test_split_sizes_hold_for_null_and_repeated_keys(spark, keys):
    for other in (lambda i: i, lambda i: 0):  # rows that differ, rows that are equal
        df = spark.createDataFrame([(k, other(i)) for i, k in enumerate(keys)], "k long, v long").repartition(4)
        got = {r["split"]: r["count"] for r in ev.exact_split(df, "k", 0.2).groupBy("split").count().collect()}
        assert got == {"train": 80, "valid": 20}


def test_selection_shuffles_only_counts(spark):
    df = spark.range(1000).selectExpr("id * 1.0D as v")
    out = ev.exact_split(df.selectExpr("cast(v as long) as k", "v"), "k", 0.2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
