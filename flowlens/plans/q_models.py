"""Registered queries: autoencoder and isolation forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import autoencoder as ae
from ..operators import evaluation as ev
from ..operators import flows as fl
from ..operators import iforest as iso
from ..sources.sinks import write_metrics
from ..session import scratch_dir
from . import fixtures
from .oracle_sql import with_layers
from .q_stats import CM_SQL, CURVE_SQL, STATS_SQL, TAU_SQL
from .registry import register, sql_round, stable_round

FEATS = fixed.COMPACT_FEATURES


def _compact(spark, sf):
    return fl.compact_from_flows(fixtures.flows(spark, sf))


def _demo(spark, sf):
    comp = _compact(spark, sf)
    scaler = ev.scaler_params(ev.fit_scaler(comp.filter(F.col("label") == 0), FEATS))
    return comp, ae.demo_model(FEATS, scaler)


def demo_layers(source: str, columns: dict[str, str] | None = None) -> list[str]:
    """CTEs ``xs, hs, os, es, ms``: the demo model on ``source`` (with ``stats``); ``ms`` has all
    columns of ``source``, scaled inputs ``x0..``, outputs ``o0..``, errors ``e0..``, ``mse``."""
    m = ae.demo_model(FEATS, [(f, 0.0, 1.0) for f in FEATS])
    w1, b1, w2, b2 = m.ws[0], m.bs[0], m.ws[1], m.bs[1]
    xs = ", ".join(f"({(columns or {}).get(f, f)} - m_{f}) / s_{f} AS x{i}" for i, f in enumerate(FEATS))
    hid = ", ".join("greatest(0.0, " + " + ".join(f"x{i} * ({float(w1[i][j])!r})" for i in range(len(FEATS)))
                    + f" + ({float(b1[j])!r})) AS h{j}" for j in range(w1.shape[1]))
    out = ", ".join(" + ".join(f"h{j} * ({float(w2[j][k])!r})" for j in range(w1.shape[1])) + f" + ({float(b2[k])!r}) AS o{k}"
                    for k in range(len(FEATS)))
    errs = ", ".join(f"(x{k} - o{k}) * (x{k} - o{k}) AS e{k}" for k in range(len(FEATS)))
    mse = "(" + " + ".join(f"e{k}" for k in range(len(FEATS))) + f") / {len(FEATS)}.0 AS mse"
    return [f"xs AS (SELECT src.*, {xs} FROM {source} src, stats)", f"hs AS (SELECT *, {hid} FROM xs)",
            f"os AS (SELECT *, {out} FROM hs)", f"es AS (SELECT *, {errs} FROM os)", f"ms AS (SELECT *, {mse} FROM es)"]


def _demo_forward_sql(select_tail: str) -> str:
    return with_layers([STATS_SQL, *demo_layers("compact")], select_tail)


@register("m03_score_autoencoder", _demo_forward_sql(f"SELECT flow_id, {sql_round('mse', 8)} AS ae_mse FROM ms"))
def m03(spark, sf):
    comp, model = _demo(spark, sf)
    return ae.score_autoencoder(comp, model, "ae_mse").select("flow_id", stable_round("ae_mse", 8).alias("ae_mse"))


@register("m04_reconstruction_detail", _demo_forward_sql(
    f"SELECT flow_id, {sql_round('mse', 8)} AS mse, " + ", ".join(f"{sql_round(f'e{k}', 8)} AS err_{f}"
                                                                 for k, f in enumerate(FEATS))
    + " FROM ms"))
def m04(spark, sf):
    comp, model = _demo(spark, sf)
    d = ae.score_autoencoder_detail(comp, model, "ae")
    return d.select("flow_id", stable_round("ae.mse", 8).alias("mse"),
                    *[stable_round(F.col("ae.err")[k], 8).alias(f"err_{f}") for k, f in enumerate(FEATS)])


_ITEMS = "[" + ", ".join(f"{{'e': e{k}, 'i': {k}, 'n': '{f}'}}" for k, f in enumerate(FEATS)) + "]"


@register("f05_top_feature_errors", _demo_forward_sql(
    f"""SELECT flow_id, array_to_string(list_transform(list_slice(list_reverse(list_sort({_ITEMS})), 1, 5),
                                                   lambda s: s.n), ',') AS top_features,
           {sql_round(f"list_reverse(list_sort({_ITEMS}))[1].e", 8)} AS top_err FROM ms"""))
def f05(spark, sf):
    comp, model = _demo(spark, sf)
    d = ae.score_autoencoder_detail(comp, model, "ae")
    top = ae.top_feature_errors(F.col("ae"), FEATS, [F.col(f) for f in FEATS], 5)
    d = d.withColumn("top", top)
    return d.select("flow_id", F.array_join(F.transform("top", lambda s: s["name"]), ",").alias("top_features"),
                    stable_round(F.col("top")[0]["err"], 8).alias("top_err"))


def _forest_score_sql() -> str:
    """Score of the fixed forest from scaled features ``x0..``: path length is 2 plus the leaf's part."""
    def tree(t):
        rows = {r[0]: r for r in iso.demo_tree(t, len(FEATS))}
        leaf = {k: 2.0 + float(iso.avg_path_length([rows[k][5]])[0]) for k in range(3, 7)}

        def split(k, left, right):
            return f"CASE WHEN x{rows[k][1]} < {rows[k][2]!r} THEN {left} ELSE {right} END"
        return split(0, split(1, repr(leaf[3]), repr(leaf[4])), split(2, repr(leaf[5]), repr(leaf[6])))
    total = " + ".join(f"({tree(t)})" for t in range(iso.DEMO_TREES))
    return f"pow(2.0, -(({total}) / {float(iso.DEMO_TREES)!r}) / {float(iso.avg_path_length([64])[0])!r})"


FOREST_LAYERS = [STATS_SQL, demo_layers("compact")[0], f"fs AS (SELECT *, {_forest_score_sql()} AS s FROM xs)",
                 "fo AS (SELECT quantile_cont(-s, 0.05) AS o FROM fs)",
                 "fd AS (SELECT *, -s - o AS d, CAST(-s - o < 0 AS INTEGER) AS flag FROM fs, fo)"]


def _fixed_forest(spark, sf):
    """The compact rows scaled and scored with the fixed forest, written as its node table and read back."""
    def build():
        path = scratch_dir(spark, "forest")
        iso.save_forest(iso.demo_forest(spark, FEATS), path)
        comp, model = _demo(spark, sf)
        nodes = iso.load_forest(spark, path)
        scored = iso.score_isolation_forest(ev.scale_columns(comp, model.scaler), nodes, FEATS)
        return comp, model.scaler, nodes, scored, iso.fit_offset(scored, contamination=0.05)
    return fixtures.memo(spark, sf, "fixed-forest", build)


@register("m06_fixed_forest_scores", with_layers(FOREST_LAYERS, f"""
SELECT flow_id, {sql_round('s', 9)} AS if_score, {sql_round('d', 9)} AS if_decision, flag AS if_flag FROM fd"""))
def m06_fixed(spark, sf):
    *_, scored, offset = _fixed_forest(spark, sf)
    return iso.decision(scored, offset).select("flow_id", stable_round("if_score", 9).alias("if_score"),
                                               stable_round("if_decision", 9).alias("if_decision"), "if_flag")


@register("m06_forest_metrics", with_layers(FOREST_LAYERS, f"""
, cm AS (SELECT count(*) FILTER (WHERE label = 0 AND flag = 0) AS tn, count(*) FILTER (WHERE label = 0 AND flag = 1) AS fp,
                count(*) FILTER (WHERE label = 1 AND flag = 0) AS fn, count(*) FILTER (WHERE label = 1 AND flag = 1) AS tp FROM fd),
g AS (SELECT round(s, 9) AS s, sum(label) AS pos, sum(1 - label) AS neg FROM fd GROUP BY 1),
k AS (SELECT *, sum(neg) OVER (ORDER BY s DESC) AS fps FROM g)
SELECT tn, fp, fn, tp, {sql_round("coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0)", 9)} AS f1,
  (SELECT {sql_round("sum(pos * ((SELECT sum(neg) FROM g) - fps + neg / 2.0)) / ((SELECT sum(pos) FROM g) * (SELECT sum(neg) FROM g))", 9)} FROM k)
  AS roc_auc FROM cm"""))
def m06_metrics(spark, sf):
    """AUC of the anomaly score and F1 of the flag, as the training script reports them."""
    *_, scored, offset = _fixed_forest(spark, sf)
    out = iso.decision(scored, offset).withColumn("if_rank", F.round("if_score", 9))
    cm = ev.confusion_counts(out, "label", F.col("if_flag") == 1)
    auc = ev.roc_auc_ap(ev.score_curve(out, "if_rank", "label")).select(stable_round("roc_auc", 9).alias("roc_auc"))
    return ev.binary_metrics(cm).select("tn", "fp", "fn", "tp", stable_round("f1", 9).alias("f1")).join(F.broadcast(auc))


@register("m08_preview_scoring", with_layers(FOREST_LAYERS, f"""
SELECT flow_id, label, {sql_round('s', 9)} AS if_score, {sql_round('d', 9)} AS if_decision, flag AS if_flag
FROM fd ORDER BY flow_id LIMIT 5"""))
def m08(spark, sf):
    comp, scaler, nodes, _, offset = _fixed_forest(spark, sf)
    return iso.preview(comp, "flow_id", nodes, FEATS, offset, 5, "label", scaler).select(
        "flow_id", "label", stable_round("if_score", 9).alias("if_score"),
        stable_round("if_decision", 9).alias("if_decision"), "if_flag")


@register("m07_fixed_threshold_flag", with_layers([STATS_SQL], """
SELECT flow_id, CAST(-(0.5 - byte_rate / 1e5) >= -0.200629 AS INTEGER) AS flag FROM compact"""))
def m07(spark, sf):
    comp = _compact(spark, sf)
    score = F.lit(0.5) - F.col("byte_rate") / F.lit(1e5)
    return comp.select("flow_id", iso.flag_by_threshold(score).alias("flag"))


def _trained(spark, sf, epochs=50):
    comp = _compact(spark, sf)
    normal = fl.normal_rows(comp, "label")  # D03: label 0 rows (all rows when none)
    return ae.train_autoencoder(normal, FEATS, "flow_id", size="small", epochs=epochs)


@register("m01_train_autoencoder")
def m01(spark, sf):
    """Layer table (A09) of the autoencoder trained on normal compact rows."""
    model, _ = _trained(spark, sf)
    return model.to_frames(spark)["layers"].select("layer", "in_dim", "out_dim", "activation",
                                                   F.size("weights").alias("n_weights"))


@register("m02_training_history")
def m02(spark, sf):
    _, hist = _trained(spark, sf)
    return hist


_A09 = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {i} AS pos, {sql_round(f'm_{f}', 6)} AS mean, {sql_round(f's_{f}', 6)} AS scale FROM stats"
    for i, f in enumerate(FEATS))
_A09_NET = ae.demo_model(FEATS, [(f, 0.0, 1.0) for f in FEATS])


@register("a09_model_tables", with_layers([STATS_SQL], f"""
SELECT t.*, l.* FROM ({_A09}) t, (VALUES {', '.join(
    f"({k}, {w.shape[0]}, {w.shape[1]}, {round(float(w.sum()), 9) + 0.0!r}::DOUBLE, {round(float(b.sum()), 9) + 0.0!r}::DOUBLE)"
    for k, (w, b) in enumerate(zip(_A09_NET.ws, _A09_NET.bs)))}) l(layer, in_dim, out_dim, weight_sum, bias_sum)"""))
def a09(spark, sf):
    """The model saved, loaded and saved as tables again: features and scaler by layer shapes and sums."""
    _, model = _demo(spark, sf)
    path = scratch_dir(spark, "model")
    model.save(spark, path)
    tables = ae.Model.load(spark, path).to_frames(spark)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    layers = tables["layers"].select("layer", "in_dim", "out_dim", stable_round(total("weights"), 9).alias("weight_sum"),
                                     stable_round(total("bias"), 9).alias("bias_sum"))
    scaler = tables["features"].join(tables["scaler"].drop("pos"), F.col("name") == F.col("feature")).select(
        "feature", "pos", stable_round("mean", 6).alias("mean"), stable_round("scale", 6).alias("scale"))
    return scaler.join(F.broadcast(layers))  # a few layers


@register("a10_metrics_export", f"""
SELECT tn, fp, fn, tp, {sql_round('coalesce(tp / NULLIF(tp + fp, 0), 0.0)', 9)} AS precision,
  {sql_round('coalesce(tp / NULLIF(tp + fn, 0), 0.0)', 9)} AS recall, {sql_round('tau', 9)} AS threshold,
  {sql_round('roc_auc', 9)} AS roc_auc, {sql_round('pr_auc', 9)} AS pr_auc
FROM ({CM_SQL}) cm, ({with_layers([TAU_SQL], 'SELECT tau FROM tau')}) t,
  ({with_layers([CURVE_SQL], "SELECT sum(pos * ((N - fps) + neg / 2.0)) / (max(P) * max(N)) AS roc_auc, "
                             "sum(CASE WHEN pos > 0 THEN (pos / P) * (tps / (tps + fps)) END) AS pr_auc FROM c, tot")}) a""")
def a10(spark, sf):
    """One-row evaluation record (threshold, matrix, P/R, AUC, AP) written as JSON and read back."""
    scored = fixtures.flows(spark, sf).select("flow_id", "ae_score", "label")
    tau = ev.percentile_threshold(scored, "ae_score", 99.5)
    cm = ev.binary_metrics(ev.confusion_counts(scored, "label", F.col("ae_score") >= F.lit(tau)))
    rank = ev.roc_auc_ap(ev.score_curve(scored, "ae_score", "label")).collect()[0]
    rec = cm.withColumns({"threshold": F.lit(tau), "roc_auc": F.lit(rank["roc_auc"]),
                          "pr_auc": F.lit(rank["average_precision"])})
    path = scratch_dir(spark, "metrics")
    write_metrics(rec, path)
    back = spark.read.schema(rec.schema).json(path)
    return back.select("tn", "fp", "fn", "tp", *[stable_round(c, 9).alias(c) for c in (
        "precision", "recall", "threshold", "roc_auc", "pr_auc")])


def _iforest(spark, sf):
    comp = _compact(spark, sf)
    split = ev.stratified_split(comp, "flow_id", "label", 0.2)
    scaler = ev.scaler_params(ev.fit_scaler(split.filter(F.col("split") == "train"), FEATS))
    scaled = ev.scale_columns(split, scaler)
    nodes = iso.train_isolation_forest(scaled.filter(F.col("split") == "train"), FEATS, "flow_id")
    return scaled, nodes


@register("m05_train_isolation_forest")
def m05(spark, sf):
    _, nodes = _iforest(spark, sf)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"),
                                     F.max("size").alias("sample_size"))


@register("m06_isolation_scores")
def m06(spark, sf):
    scaled, nodes = _iforest(spark, sf)
    scored = iso.score_isolation_forest(scaled, nodes, FEATS)
    offset = iso.fit_offset(scored.filter(F.col("split") == "train"), contamination=0.05)
    out = iso.decision(scored.filter(F.col("split") == "valid"), offset)
    return out.select("flow_id", "label", "if_score", "if_decision", "if_anomaly_score", "if_flag")


@register("m01_embeddings_separation")
def m01_embeddings(spark, sf):
    """Autoencoder trained on embeddings of label 0, scored on all; ROC-AUC of
    'label != 0' against the reconstruction error (separation check)."""
    emb = fixtures.embeddings(spark, sf)
    dim = 64
    cols = [f"e{i}" for i in range(dim)]
    flat = emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    model, _ = ae.train_autoencoder(flat.filter(F.col("label") == 0), cols, "vec_id", hidden=[16, 8, 16], epochs=30)
    scored = ae.score_autoencoder(flat, model, "err").withColumn("y", (F.col("label") != 0).cast("int"))
    return ev.roc_auc_ap(ev.score_curve(scored, "err", "y"))


__all__ = ["np"]
