"""Scaler, thresholds, detection metrics, curves, histogram, splits.

Global-order statistics (percentiles, ROC/PR cumulative sums, exact split
cuts) go through the range-partitioned rank helper; aggregates are single
partial/final aggregations (no single-task window anywhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ordered_running_sums, partition_offsets, quantile_linear, ranged
from .selection import first_rows


# ---------------------------------------------------------------------------
# E01 / E02 standard scaler (population std, zero variance -> 1)
# ---------------------------------------------------------------------------
def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One aggregation pass -> table (feature, pos, mean, scale)."""
    aggs = []
    for f in features:
        v = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))  # NaN is skipped like null
        aggs += [F.avg(v).alias(f"m_{f}"), F.stddev_pop(v).alias(f"s_{f}")]
    stats = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("pos"), F.col(f"m_{f}").alias("mean"),
                              F.col(f"s_{f}").alias("std")) for i, f in enumerate(features)])
    out = stats.select(F.explode(rows).alias("r")).select("r.*")
    # values this small are treated as zero variance (as a float64 scaler does)
    return out.withColumn("scale", F.when(F.coalesce(F.col("std"), F.lit(0.0)) < F.lit(1e-12), F.lit(1.0))
                          .otherwise(F.col("std"))).drop("std")


def scaler_params(scaler: DataFrame) -> list[tuple[str, float, float]]:
    """Collect the fitted table (one row per feature; bounded by the feature count)."""
    return [(r["feature"], float(r["mean"] if r["mean"] is not None else 0.0), float(r["scale"]))
            for r in scaler.orderBy("pos").collect()]


def scale_columns(df: DataFrame, params, suffix: str = "") -> DataFrame:
    """(x - mean) / scale with the fitted values as literals (constant-folded)."""
    return df.withColumns({f"{f}{suffix}": (F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in params})


# ---------------------------------------------------------------------------
# E03-E05 threshold and binary metrics
# ---------------------------------------------------------------------------
def percentile_threshold(df: DataFrame, score_col: str, percentile: float = 99.5) -> float | None:
    """Numpy-style linear percentile (exact)."""
    return quantile_linear(df, score_col, percentile / 100.0)


def confusion_counts(df: DataFrame, label_col: str, flag: Column) -> DataFrame:
    """[[TN, FP], [FN, TP]] as four count columns (one aggregation)."""
    y = F.col(label_col).cast("int")
    p = flag.cast("int")
    return df.agg(F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
                  F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
                  F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
                  F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"))


def binary_metrics(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1; zero division -> 0."""
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double")
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return cm.withColumns({"precision": prec, "recall": rec, "f1": f1})


# ---------------------------------------------------------------------------
# E06-E08 ranking metrics from cumulative counts over distinct scores
# ---------------------------------------------------------------------------
def score_curve(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """One row per distinct score, descending: positives/negatives at the score
    and cumulative true/false positives at threshold >= score (E08 table)."""
    grouped = (df.groupBy(F.col(score_col).cast("double").alias("threshold"))
               .agg(F.sum((F.col(label_col) == 1).cast("long")).alias("pos"),
                    F.sum((F.col(label_col) != 1).cast("long")).alias("neg")))
    cum = ordered_running_sums(grouped, [F.col("threshold").desc()], ["pos", "neg"])
    return cum.select("threshold", "pos", "neg", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))


def roc_pr_points(curve: DataFrame, totals: dict) -> DataFrame:
    """Fpr, tpr, precision, recall per threshold (one row per distinct score)."""
    P, N = float(totals["P"]), float(totals["N"])
    return curve.withColumns({
        "fpr": F.col("fps") / F.lit(N) if N else F.lit(float("nan")),
        "tpr": F.col("tps") / F.lit(P) if P else F.lit(float("nan")),
        "precision": F.col("tps") / (F.col("tps") + F.col("fps")),
        "recall": F.col("tps") / F.lit(P) if P else F.lit(float("nan")),
    })


def roc_auc_ap(curve: DataFrame) -> DataFrame:
    """E06 / E07 in one aggregation over the curve table:
    AUC = sum(pos * (neg below + neg at / 2)) / (P N)  (ties count one half);
    AP = sum(pos_at / P * precision at the threshold)  (step sum)."""
    tot = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    neg_below = F.lit(N) - F.col("fps")
    auc_term = F.col("pos") * (neg_below + F.col("neg") / F.lit(2.0))
    ap_term = (F.col("pos") / F.lit(P)) * (F.col("tps") / (F.col("tps") + F.col("fps")))
    return curve.agg(
        (F.sum(auc_term) / F.lit(P * N)).alias("roc_auc") if P and N else F.lit(None).cast("double").alias("roc_auc"),
        F.sum(F.when(F.col("pos") > 0, ap_term)).alias("average_precision") if P
        else F.lit(None).cast("double").alias("average_precision"))


# ---------------------------------------------------------------------------
# E09-E11
# ---------------------------------------------------------------------------
def error_histogram(df: DataFrame, col: str, bins: int = 80) -> DataFrame:
    """Equal-width bins between min and max, last bin closed; all bins returned."""
    spark = df.sparkSession
    df = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()[0]
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"), F.lit(bins - 1))
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(F.broadcast(counts), "bin", "left")  # at most `bins` rows
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def error_series(df: DataFrame, seq_col: str, col: str, tau: float) -> DataFrame:
    """Every error with its sequence number and the threshold. ``seq`` orders
    the rows; a plot sorts what it shows."""
    return df.select(F.col(seq_col).alias("seq"), F.col(col).alias("err"), F.lit(float(tau)).alias("threshold"))


def error_moments(df: DataFrame, col: str) -> DataFrame:
    """Mean and population std."""
    return df.agg(F.avg(col).alias("mean_err"), F.stddev_pop(col).alias("std_err"))


# ---------------------------------------------------------------------------
# E12-E14 exact-size shuffled splits
# ---------------------------------------------------------------------------
def shuffle_key(key_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("\0null")), F.lit(str(seed))))


def exact_split(df: DataFrame, key_col: str, valid_fraction: float, seed: int = 42) -> DataFrame:
    """Rows in md5(key || seed) order; n_valid = int(n * f); the
    first n - n_valid rows are ``train``, the rest ``valid``. The sizes hold for null and
    repeated keys too: rows of one key are cut by their other columns, equal rows anywhere."""
    n = df.count()
    hashed = shuffle_key(key_col, seed)
    digits = [F.conv(F.substring(hashed, at, size), 16, 10).cast("bigint") for at, size in ((1, 15), (16, 15), (31, 2))]
    out = first_rows(df, digits, n - int(n * valid_fraction), "_train")
    return out.withColumn("split", F.when(F.col("_train"), "train").otherwise("valid")).drop("_train")


def stratified_split(df: DataFrame, key_col: str, label_col: str, valid_fraction: float,
                     seed: int = 42) -> DataFrame:
    """The exact split inside every label: per label n_valid = int(n_l * f),
    ranks from one range-partitioned pass over (label, hash) minus the label's
    first rank (per-label counts: one row per label)."""
    h = shuffle_key(key_col, seed)
    x = df.withColumn("_h", h)
    r = ranged(x, [F.col(label_col), F.col("_h")])
    off = partition_offsets(r).select("_pid", "_off_cnt")
    labels = r.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n_l"))
    # one row per label: a window over it is bounded by the label count
    w_first = labels.withColumn("_first", F.coalesce(
        F.sum("_n_l").over(Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (r.join(F.broadcast(off), "_pid").join(F.broadcast(w_first), label_col)
              .withColumn("_rl", F.col("_off_cnt") + F.col("_pos") - F.col("_first")))
    n_valid = F.floor(F.col("_n_l") * F.lit(valid_fraction))
    out = ranked.withColumn("split", F.when(F.col("_rl") < F.col("_n_l") - n_valid, "train").otherwise("valid"))
    return out.drop("_h", "_pid", "_pos", "_off_cnt", "_n_l", "_first", "_rl")

