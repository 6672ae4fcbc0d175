"""Dense autoencoder trained and scored on Spark.

Training (M01) is data-parallel: every epoch is one Spark job. Each partition
starts from the broadcast weights and Adam state, runs its own shuffled
mini-batches (numpy inside the task), and returns its row count, weights,
Adam moments and summed batch losses; the driver averages them weighted by
rows (local-SGD model averaging). This replaces the reference's single-process
mini-batch loop: the optimiser sees partition-local batches between
synchronisations, so losses are close to but not identical with a serial run.
``gradient_pass`` gives the exact full-batch gradient (sums from all
partitions) for checks and for ``mode="full"`` training.

Scoring (M03/M04) is one Arrow UDF (vectorised matmul per batch,
weights captured in the closure: bounded by the net size) returning the MSE
and, on request, the per-feature squared errors, inputs and reconstruction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions import fixed
from .evaluation import exact_split, fit_scaler, scale_columns, scaler_params

ARCHITECTURES = {
    "small": [16, 8, 16],
    "medium": [64, 32, 16, 32, 64],
    "large": [128, 64, 32, 16, 32, 64, 128],
}


# ---------------------------------------------------------------------------
# numpy net (runs inside tasks and on the driver for tiny arrays)
# ---------------------------------------------------------------------------
def init_weights(dims: list[int], seed: int = 42):
    """Glorot-uniform kernels, zero biases."""
    rng = np.random.default_rng(seed)
    ws, bs = [], []
    for a, b in zip(dims[:-1], dims[1:]):
        lim = math.sqrt(6.0 / (a + b))
        ws.append(rng.uniform(-lim, lim, size=(a, b)))
        bs.append(np.zeros(b))
    return ws, bs


def forward(x, ws, bs):
    acts = [x]
    h = x
    for i, (w, b) in enumerate(zip(ws, bs)):
        z = h @ w + b
        h = np.maximum(z, 0.0) if i < len(ws) - 1 else z
        acts.append(h)
    return acts


def loss_and_grads(x, ws, bs, reduce: str = "mean"):
    """MSE over all entries; ``reduce='sum'`` returns summed squared error and
    gradients of the sum (for exact aggregation across partitions)."""
    acts = forward(x, ws, bs)
    diff = acts[-1] - x
    n = x.shape[0] * x.shape[1]
    if reduce == "sum":
        loss, g = float((diff ** 2).sum()), 2.0 * diff
    else:
        loss, g = float((diff ** 2).mean()), 2.0 * diff / n
    gws, gbs = [None] * len(ws), [None] * len(ws)
    for i in reversed(range(len(ws))):
        gws[i] = acts[i].T @ g
        gbs[i] = g.sum(axis=0)
        if i > 0:
            g = (g @ ws[i].T) * (acts[i] > 0)
    return loss, gws, gbs


def flatten(arrs) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrs])


def unflatten(vec, shapes):
    out, k = [], 0
    for s in shapes:
        size = int(np.prod(s))
        out.append(np.asarray(vec[k:k + size]).reshape(s))
        k += size
    return out


def _shapes(dims):
    return [(a, b) for a, b in zip(dims[:-1], dims[1:])] + [(b,) for b in dims[1:]]


class Model:
    """Fitted autoencoder: feature order, scaler and layer weights."""

    def __init__(self, features, scaler, ws, bs):
        self.features = list(features)
        self.scaler = list(scaler)  # [(feature, mean, scale)]
        self.ws = [np.asarray(w, dtype=float) for w in ws]
        self.bs = [np.asarray(b, dtype=float) for b in bs]

    @property
    def dims(self):
        return [self.ws[0].shape[0]] + [w.shape[1] for w in self.ws]

    def to_frames(self, spark):
        """A09 tables: features(pos, name), scaler(feature, pos, mean, scale),
        layers(layer, in_dim, out_dim, activation, weights, bias)."""
        feats = spark.createDataFrame([(i, f) for i, f in enumerate(self.features)], "pos int, name string")
        scal = spark.createDataFrame([(f, i, float(m), float(s)) for i, (f, m, s) in enumerate(self.scaler)],
                                     "feature string, pos int, mean double, scale double")
        rows = [(i, int(w.shape[0]), int(w.shape[1]), "relu" if i < len(self.ws) - 1 else "linear",
                 [float(v) for v in w.ravel()], [float(v) for v in b]) for i, (w, b) in enumerate(zip(self.ws, self.bs))]
        layers = spark.createDataFrame(rows, "layer int, in_dim int, out_dim int, activation string, "
                                             "weights array<double>, bias array<double>")
        return {"features": feats, "scaler": scal, "layers": layers}

    def save(self, spark, path: str):
        for name, df in self.to_frames(spark).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "Model":
        feats = [r["name"] for r in spark.read.parquet(f"{path}/features").orderBy("pos").collect()]
        scal = [(r["feature"], r["mean"], r["scale"]) for r in spark.read.parquet(f"{path}/scaler").orderBy("pos").collect()]
        ws, bs = [], []
        for r in spark.read.parquet(f"{path}/layers").orderBy("layer").collect():
            ws.append(np.array(r["weights"]).reshape(r["in_dim"], r["out_dim"]))
            bs.append(np.array(r["bias"]))
        return cls(feats, scal, ws, bs)


# ---------------------------------------------------------------------------
# M03 / M04 scoring
# ---------------------------------------------------------------------------
DETAIL_TYPE = T.StructType([
    T.StructField("mse", T.DoubleType()),
    T.StructField("x", T.ArrayType(T.DoubleType())),
    T.StructField("x_hat", T.ArrayType(T.DoubleType())),
    T.StructField("err", T.ArrayType(T.DoubleType())),
])


def _scaled_matrix(cols, means, scales):
    x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
    return (x - means) / scales


def score_autoencoder(df: DataFrame, model: Model, out_col: str = "ae_score") -> DataFrame:
    """Scaled reconstruction MSE per row (one Arrow UDF)."""
    means = np.array([m for _, m, _ in model.scaler])
    scales = np.array([s for _, _, s in model.scaler])
    ws, bs = model.ws, model.bs

    @pandas_udf(T.DoubleType())
    def mse_udf(*cols: pd.Series) -> pd.Series:
        xs = _scaled_matrix(cols, means, scales)
        xh = forward(xs, ws, bs)[-1]
        return pd.Series(((xs - xh) ** 2).mean(axis=1))

    return df.withColumn(out_col, mse_udf(*[F.col(f).cast("double") for f in model.features]))


def score_autoencoder_detail(df: DataFrame, model: Model, out_col: str = "ae") -> DataFrame:
    """struct(mse, x, x_hat, err) computed once per row."""
    means = np.array([m for _, m, _ in model.scaler])
    scales = np.array([s for _, _, s in model.scaler])
    ws, bs = model.ws, model.bs

    @arrow_udf(DETAIL_TYPE)
    def detail_udf(*cols: pa.Array) -> pa.Array:
        xs = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype(float) - means) / scales
        xh = forward(xs, ws, bs)[-1]
        err = (xs - xh) ** 2
        at = pa.array(np.arange(len(xs) + 1, dtype=np.int32) * xs.shape[1])
        lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(m).ravel())) for m in (xs, xh, err)]
        return pa.StructArray.from_arrays([pa.array(err.mean(axis=1)), *lists], ["mse", "x", "x_hat", "err"])

    return df.withColumn(out_col, detail_udf(*[F.col(f).cast("double") for f in model.features]))


def top_feature_errors(detail: Column, features: list[str], raw_cols: list[Column], k: int = 5) -> Column:
    """the k largest per-feature errors, descending, ties to the higher
    index, with name, err, x, x_hat and the raw input value (no shuffle)."""
    items = F.array(*[F.struct(detail["err"][i].alias("err"), F.lit(i).alias("idx"), F.lit(f).alias("name"),
                               detail["x"][i].alias("x"), detail["x_hat"][i].alias("x_hat"),
                               raw_cols[i].cast("double").alias("raw"))
                      for i, f in enumerate(features)])
    return F.slice(F.sort_array(items, asc=False), 1, k)


# ---------------------------------------------------------------------------
# M01 / M02 training
# ---------------------------------------------------------------------------
def _epoch_fn(dims, wvec, mvec, vvec, step, lr, batch, epoch, seed, train=True,
              beta1=0.9, beta2=0.999, eps=1e-7):
    shapes = _shapes(dims)
    n_layers = len(dims) - 1

    def run(batches):
        xs_tr, xs_va, pid = [], [], 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pid = int(pdf["_pid"].iloc[0])
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            val = pdf["_val"].to_numpy().astype(bool)
            xs_tr.append(x[~val])
            xs_va.append(x[val])
        tr = np.concatenate(xs_tr) if xs_tr else np.zeros((0, dims[0]))
        va = np.concatenate(xs_va) if xs_va else np.zeros((0, dims[0]))
        params = unflatten(wvec, shapes)
        ws, bs = params[:n_layers], params[n_layers:]
        # validation error of the incoming (averaged) weights
        val_sse = float(((forward(va, ws, bs)[-1] - va) ** 2).sum()) if len(va) else 0.0
        m = unflatten(mvec, shapes)
        v = unflatten(vvec, shapes)
        t = step
        loss_sum, n_batches = 0.0, 0
        rng = np.random.default_rng([seed, epoch, pid])
        order = rng.permutation(len(tr))
        for s in range(0, len(tr) if train else 0, batch):
            xb = tr[order[s:s + batch]]
            loss, gws, gbs = loss_and_grads(xb, ws, bs)
            grads = gws + gbs
            t += 1
            cur = ws + bs
            for i, g in enumerate(grads):
                m[i] = beta1 * m[i] + (1 - beta1) * g
                v[i] = beta2 * v[i] + (1 - beta2) * g * g
                mh = m[i] / (1 - beta1 ** t)
                vh = v[i] / (1 - beta2 ** t)
                cur[i] = cur[i] - lr * mh / (np.sqrt(vh) + eps)
            ws, bs = cur[:n_layers], cur[n_layers:]
            loss_sum += loss * len(xb)
            n_batches += 1
        yield pd.DataFrame({
            "n": [len(tr)], "n_val": [len(va)], "val_sse": [val_sse], "loss_sum": [loss_sum],
            "steps": [n_batches], "w": [flatten(ws + bs)], "m": [flatten(m)], "v": [flatten(v)]})
    return run


EPOCH_SCHEMA = ("n long, n_val long, val_sse double, loss_sum double, steps long, "
                "w array<double>, m array<double>, v array<double>")


def prepare_training_frame(df: DataFrame, features: list[str], key_col: str, val_fraction: float = 0.2,
                           seed: int = 42, n_parts: int | None = None):
    """Split (E13), fit the scaler on the train part (E01), scale (E02) and pack
    the features into one array column; persisted for the epoch loop."""
    split = exact_split(df, key_col, val_fraction, seed)
    scaler = scaler_params(fit_scaler(split.filter(F.col("split") == "train"), features))
    scaled = scale_columns(split, scaler)
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = (scaled.select(F.array(*[F.col(f) for f in features]).alias("x"),
                            (F.col("split") == "valid").alias("_val"), F.col(key_col).alias("_key"))
              .repartition(n, F.xxhash64("_key"))
              .withColumn("_pid", F.spark_partition_id())
              .drop("_key"))
    return packed.persist(StorageLevel.MEMORY_AND_DISK), scaler


def train_autoencoder(df: DataFrame, features: list[str], key_col: str, size: str = "small",
                      hidden: list[int] | None = None, epochs: int = 50, batch: int = 256, lr: float = 1e-3,
                      val_fraction: float = 0.2, seed: int = 42, n_parts: int | None = None):
    """M01 + M02: returns (Model with the best-validation weights, history DataFrame)."""
    spark = df.sparkSession
    data, scaler = prepare_training_frame(df, features, key_col, val_fraction, seed, n_parts)
    dims = [len(features)] + (hidden or ARCHITECTURES[size]) + [len(features)]
    ws, bs = init_weights(dims, seed)
    wvec = flatten(ws + bs)
    mvec, vvec = np.zeros_like(wvec), np.zeros_like(wvec)
    step = 0
    history, best = [], (float("inf"), wvec)
    prev_loss = None
    try:
        for epoch in range(epochs + 1):
            train_now = epoch < epochs
            fn = _epoch_fn(dims, wvec, mvec, vvec, step, lr, batch, epoch, seed, train=train_now)
            parts = data.mapInPandas(fn, EPOCH_SCHEMA).collect()  # one row per partition
            n_tot = sum(r["n"] for r in parts)
            n_val = sum(r["n_val"] for r in parts)
            val_loss = sum(r["val_sse"] for r in parts) / max(n_val * len(features), 1) if n_val else float("nan")
            if prev_loss is not None:  # val loss of the weights produced by the previous epoch
                history.append((epoch, prev_loss, val_loss))
                if val_loss < best[0]:
                    best = (val_loss, wvec)
            if not train_now:
                break
            wts = np.array([r["n"] for r in parts], dtype=float)
            if wts.sum() == 0:
                raise ValueError("no training rows")
            wvec = sum(np.asarray(r["w"]) * k for r, k in zip(parts, wts)) / wts.sum()
            mvec = sum(np.asarray(r["m"]) * k for r, k in zip(parts, wts)) / wts.sum()
            vvec = sum(np.asarray(r["v"]) * k for r, k in zip(parts, wts)) / wts.sum()
            step += int(round(sum(r["steps"] * k for r, k in zip(parts, wts)) / wts.sum()))
            prev_loss = sum(r["loss_sum"] for r in parts) / max(n_tot, 1)
    finally:
        data.unpersist()
    final = best[1] if math.isfinite(best[0]) else wvec
    params = unflatten(final, _shapes(dims))
    n_layers = len(dims) - 1
    model = Model(features, scaler, params[:n_layers], params[n_layers:])
    hist = spark.createDataFrame(history, "epoch int, loss double, val_loss double")
    return model, hist


def gradient_pass(df: DataFrame, model: Model, x_col: str = "x"):
    """Exact full-batch loss and gradient (sum over all partitions / N*D)."""
    dims = model.dims
    shapes = _shapes(dims)
    wvec = flatten(model.ws + model.bs)
    n_layers = len(dims) - 1

    def run(batches):
        params = unflatten(wvec, shapes)
        ws, bs = params[:n_layers], params[n_layers:]
        tot_g, tot_l, n = np.zeros_like(wvec), 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[x_col].to_numpy()).astype(float)
            loss, gws, gbs = loss_and_grads(x, ws, bs, reduce="sum")
            tot_g += flatten(gws + gbs)
            tot_l += loss
            n += x.shape[0]
        yield pd.DataFrame({"n": [n], "sse": [tot_l], "g": [tot_g]})

    parts = df.select(x_col).mapInPandas(run, "n long, sse double, g array<double>").collect()
    n = sum(r["n"] for r in parts)
    denom = max(n * dims[0], 1)
    g = sum(np.asarray(r["g"]) for r in parts) / denom
    return sum(r["sse"] for r in parts) / denom, unflatten(g, shapes)


def demo_model(features: list[str], scaler, hidden: int = 4) -> Model:
    """Fixed small weights from a closed formula (used by the SQL oracle of M03)."""
    d = len(features)
    w1 = np.array([[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(hidden)] for i in range(d)])
    b1 = np.array([((j * 5) % 7 - 3) / 10.0 for j in range(hidden)])
    w2 = np.array([[((j * 5 + k * 2) % 9 - 4) / 10.0 for k in range(d)] for j in range(hidden)])
    b2 = np.array([((k * 3) % 5 - 2) / 10.0 for k in range(d)])
    return Model(features, scaler, [w1, w2], [b1, b2])


__all__ = ["fixed"]
