"""Isolation forest grown and applied on Spark.

Sampling (M05): every tree needs ``min(256, n)`` rows drawn without
replacement. A hash of the row's key below a threshold keeps about
4 x trees x 256 rows; within these each row gets one hash per tree, a
threshold keeps about 1,000 rows per tree, and the 256 smallest hashes per tree
are the sample. Both thresholds are one expression at every size (up to 1: all
rows), and depend on keys alone, so equal rows give the same trees however they
are partitioned. The per-tree groups are bounded, and
``groupBy(tree).applyInPandas`` grows each tree in its own task. The node table
(trees x at most 2^(depth+1) nodes) is the model; it is saved as Parquet, and
scoring computes path lengths from it in an Arrow UDF. The random streams differ from any
single-machine library, so scores agree in distribution, not bit for bit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir
from .evaluation import scale_columns
from .ranking import quantile_linear

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, right_child int, "
               "size long, depth int")


def avg_path_length(n):
    """c(n): average unsuccessful-search path length in a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng, max_depth: int):
    """Random isolation tree as flat node rows (node ids in creation order)."""
    nodes = []

    def build(idx, depth):
        node_id = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[node_id] = (node_id, -1, float("nan"), -1, -1, len(idx), depth)
            return node_id
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            nodes[node_id] = (node_id, -1, float("nan"), -1, -1, len(idx), depth)
            return node_id
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[node_id] = (node_id, f, thr, left, right, len(idx), depth)
        return node_id

    build(np.arange(len(x)), 0)
    return nodes


def train_isolation_forest(df: DataFrame, features: list[str], key_col: str, n_trees: int = 200,
                           max_samples: int = 256, seed: int = 42, oversample: float = 4.0) -> DataFrame:
    """Node table of ``n_trees`` trees (max depth ceil(log2(sample size)))."""
    n = df.count()
    psi = min(max_samples, n)
    if psi == 0:
        raise ValueError("no rows")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    def u(*salt) -> F.Column:
        """uniform [0, 1) per key and salt from a 64-bit hash"""
        h = F.xxhash64(F.col(key_col), *salt, F.lit(seed))
        return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))

    # a uniform subset of a uniform subset is uniform
    base = min(1.0, oversample * n_trees * psi / n)
    share = min(1.0, oversample * psi / max(1.0, base * n))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    cand = (df.where(u(F.lit("base")) < F.lit(base))
            .select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(key_col),
                    F.explode(F.filter(trees, lambda t: u(t) < F.lit(share))).alias("tree"))
            .withColumn("_u", u(F.col("tree"))))
    # per tree at most ~oversample x psi rows: the window groups are bounded
    w = Window.partitionBy("tree").orderBy("_u", key_col, "x")
    sample = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "_u")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, tree])
        rows = _grow(x, rng, max_depth)
        return pd.DataFrame([(tree,) + r for r in rows],
                            columns=["tree", "node", "feature", "threshold", "left_child", "right_child",
                                     "size", "depth"])

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def save_forest(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(path)


def demo_forest(spark, features: list[str]) -> DataFrame:
    """Fixed small trees from a closed formula (used by the SQL oracle of M06 and M08)."""
    return spark.createDataFrame([(t, *node) for t in range(DEMO_TREES) for node in demo_tree(t, len(features))], NODE_SCHEMA)


DEMO_TREES = 5


def demo_tree(t: int, n_features: int) -> list[tuple]:
    """Node rows of one of these trees: a root, two splits, four leaves of 64 rows in all."""
    def threshold(k: int) -> float:
        return ((t * 5 + k * 3) % 11 - 4) / 8.0
    leaf = [(64 - 7 * t) // 4 + k for k in range(3)]
    sizes = [*leaf, 64 - sum(leaf)]
    rows = [(0, t % n_features, threshold(0), 1, 2, 64, 0),
            (1, (t + 2) % n_features, threshold(1), 3, 4, sizes[0] + sizes[1], 1),
            (2, (t + 4) % n_features, threshold(2), 5, 6, sizes[2] + sizes[3], 1)]
    return rows + [(3 + k, -1, float("nan"), -1, -1, sizes[k], 2) for k in range(4)]


def _forest_arrays(nodes: DataFrame):
    """Collect the node table (bounded: trees x 2^(depth+1) rows) into arrays."""
    pdf = nodes.toPandas().sort_values(["tree", "node"])
    trees = []
    for _, g in pdf.groupby("tree"):
        trees.append((g["feature"].to_numpy(int), g["threshold"].to_numpy(float), g["left_child"].to_numpy(int),
                      g["right_child"].to_numpy(int), g["size"].to_numpy(float), g["depth"].to_numpy(float)))
    psi = float(pdf[pdf["node"] == 0]["size"].max())
    return trees, psi


def path_length_udf(trees, psi):
    cn = float(avg_path_length([psi])[0])

    @pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, thr, left, right, size, depth in trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(int(depth.max()) + 1):
                f = feat[node]
                internal = f >= 0
                if not internal.any():
                    break
                val = x[rows, np.where(internal, f, 0)]
                nxt = np.where(val < thr[node], left[node], right[node])
                node = np.where(internal, nxt, node)
            total += depth[node] + avg_path_length(size[node])
        mean_depth = total / len(trees)
        return pd.Series(np.power(2.0, -mean_depth / cn))  # anomaly score s(x) in (0, 1]
    return score


def score_isolation_forest(df: DataFrame, nodes: DataFrame, features: list[str],
                           out_col: str = "if_score") -> DataFrame:
    """M06 (part): s(x) = 2^(-E[h(x)] / c(psi)); higher = more anomalous."""
    trees, psi = _forest_arrays(nodes)
    udf = path_length_udf(trees, psi)
    return df.withColumn(out_col, udf(*[F.col(f).cast("double") for f in features]))


def fit_offset(scored_train: DataFrame, score_col: str = "if_score", contamination: float = 0.05) -> float:
    """offset = contamination percentile of the training ``score_samples``
    (= -s(x)), exact via the rank helper."""
    neg = scored_train.select((-F.col(score_col)).alias("_ss"))
    # one double column, written once: the counting passes read it instead of
    # re-running the scoring UDF
    ensure_checkpoint_dir(neg.sparkSession)
    neg = neg.checkpoint(eager=True)
    return quantile_linear(neg, "_ss", contamination)


def decision(df: DataFrame, offset: float, score_col: str = "if_score") -> DataFrame:
    """decision_function = score_samples - offset; anomaly score is its
    negation; flag when decision < 0."""
    d = (-F.col(score_col)) - F.lit(float(offset))
    return df.withColumns({"if_decision": d, "if_anomaly_score": -d, "if_flag": (d < 0).cast("int")})


def flag_by_threshold(score: F.Column, threshold: float = -0.200629) -> F.Column:
    """Anomaly when -score >= threshold."""
    return ((-score) >= F.lit(float(threshold))).cast("int")


def preview(df: DataFrame, key_col: str, nodes: DataFrame, features: list[str], offset: float, n: int = 5,
            label_col: str | None = None, scaler=None) -> DataFrame:
    """The first ``n`` rows in key order (top-k), scored with the forest: key, label if there is
    one, score, decision and flag. ``scaler`` rows scale the features before."""
    rows = df.orderBy(key_col).limit(n)
    if scaler is not None:
        rows = scale_columns(rows, scaler)
    label = [label_col] if label_col and label_col in df.columns else []
    return decision(score_isolation_forest(rows, nodes, features), offset).select(
        key_col, *label, "if_score", "if_decision", "if_anomaly_score", "if_flag")
