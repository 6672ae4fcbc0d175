"""Registered queries: statistics, evaluation, splits and serving views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluation as ev
from ..operators import flows as fl
from ..operators import views
from . import fixtures
from .oracle_sql import FLOWS, chain, with_layers
from .q_decision import _dec
from .registry import register, sql_round, stable_round

PERCENTILE = 99.5
FEATS = fixed.COMPACT_FEATURES
# Outputs that are sums or quotients of sums are rounded to fixed decimals on
# both sides: Spark and DuckDB add in different orders (last-bit noise).
R6, R7, R9, R10 = 6, 7, 9, 10


def rnd(c, d):
    return stable_round(c, d)

COMPACT_SQL = FLOWS + """,
compact AS (
SELECT flow_id, CAST(pkts_fwd AS DOUBLE) AS pkts_fwd, CAST(pkts_rev AS DOUBLE) AS pkts_rev,
  CAST(bytes_fwd AS DOUBLE) AS bytes_fwd, CAST(bytes_rev AS DOUBLE) AS bytes_rev,
  greatest(CASE WHEN duration > 0 THEN duration ELSE 0.01 END, 0.01) AS duration,
  (pkts_fwd + pkts_rev) / greatest(CASE WHEN duration > 0 THEN duration ELSE 0.01 END, 0.01) AS pkt_rate,
  (bytes_fwd + bytes_rev) / greatest(CASE WHEN duration > 0 THEN duration ELSE 0.01 END, 0.01) AS byte_rate,
  (bytes_fwd + 1.0) / (bytes_rev + 1.0) AS fwd_rev_ratio,
  CASE lower(proto) WHEN 'icmp' THEN 1.0 WHEN 'tcp' THEN 6.0 WHEN 'udp' THEN 17.0 ELSE 0.0 END AS proto, label
FROM flows)"""

STATS_SQL = COMPACT_SQL + ",\nstats AS (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN coalesce(stddev_pop({f}), 0) < 1e-12 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
    for f in FEATS) + " FROM compact WHERE label = 0)"

TAU_SQL = FLOWS + f""",
tau AS (SELECT quantile_cont(ae_score, {PERCENTILE / 100.0}) AS tau FROM flows)"""

CURVE_SQL = FLOWS + """,
s AS (SELECT ae_score AS threshold, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM flows GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tps, sum(neg) OVER (ORDER BY threshold DESC) AS fps FROM s),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s)"""

LOG_SQL = FLOWS + """,
plog AS (SELECT *, (flow_id % 997) / 10.0 AS infer_ms, (flow_id % 997) / 10.0 + 0.3 AS total_ms,
                CASE WHEN flow_id % 101 = 0 THEN 'error' ELSE 'ok' END AS status FROM flows)"""


def _compact(spark, sf):
    return fl.compact_from_flows(fixtures.flows(spark, sf))


def _scored(spark, sf):
    return fixtures.flows(spark, sf).select("flow_id", "ts_unix", "ae_score", "label")


def _tau(spark, sf):
    return ev.percentile_threshold(_scored(spark, sf), "ae_score", PERCENTILE)


@register("e01_scaler_fit", with_layers([STATS_SQL], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {i} AS pos, {sql_round(f"m_{f}", R6)} AS mean, {sql_round(f"s_{f}", R6)} AS scale FROM stats"
    for i, f in enumerate(FEATS))))
def e01(spark, sf):
    comp = _compact(spark, sf)
    fit = ev.fit_scaler(comp.filter(F.col("label") == 0), FEATS)
    return fit.select("feature", "pos", rnd("mean", R6).alias("mean"), rnd("scale", R6).alias("scale"))


@register("e02_scaler_transform", with_layers([STATS_SQL], "SELECT flow_id, " + ", ".join(
    f"{sql_round(f'({f} - m_{f}) / s_{f}', R7)} AS {f}_scaled" for f in FEATS) + " FROM compact, stats"))
def e02(spark, sf):
    comp = _compact(spark, sf)
    params = ev.scaler_params(ev.fit_scaler(comp.filter(F.col("label") == 0), FEATS))
    return ev.scale_columns(comp, params, suffix="_scaled").select(
        "flow_id", *[rnd(f"{f}_scaled", R7).alias(f"{f}_scaled") for f in FEATS])


@register("e03_percentile_threshold", with_layers([TAU_SQL], f"SELECT {sql_round('tau', R9)} AS threshold FROM tau"))
def e03(spark, sf):
    return _scored(spark, sf).agg(F.count(F.lit(1)).alias("_n")).select(
        rnd(F.lit(_tau(spark, sf)).cast("double"), R9).alias("threshold"))


CM_SQL = with_layers([TAU_SQL], """
SELECT sum(CASE WHEN label = 0 AND ae_score < tau THEN 1 ELSE 0 END) AS tn,
       sum(CASE WHEN label = 0 AND ae_score >= tau THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN label = 1 AND ae_score < tau THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN label = 1 AND ae_score >= tau THEN 1 ELSE 0 END) AS tp
FROM flows, tau""")


def _cm(spark, sf):
    tau = _tau(spark, sf)
    return ev.confusion_counts(_scored(spark, sf), "label", F.col("ae_score") >= F.lit(tau))


@register("e04_confusion_matrix", CM_SQL)
def e04(spark, sf):
    return _cm(spark, sf)


@register("e05_precision_recall_f1", f"""
SELECT tn, fp, fn, tp, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision,
       coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall,
       coalesce(2 * (tp / NULLIF(tp + fp, 0)) * (tp / NULLIF(tp + fn, 0))
                / NULLIF((tp / NULLIF(tp + fp, 0)) + (tp / NULLIF(tp + fn, 0)), 0), 0.0) AS f1
FROM ({CM_SQL}) cm""")
def e05(spark, sf):
    return ev.binary_metrics(_cm(spark, sf))


def _curve(spark, sf):
    return ev.score_curve(_scored(spark, sf), "ae_score", "label")


@register("e06_roc_auc", with_layers([CURVE_SQL], f"""
SELECT {sql_round("sum(pos * ((N - fps) + neg / 2.0)) / (max(P) * max(N))", R10)} AS roc_auc FROM c, tot"""))
def e06(spark, sf):
    return ev.roc_auc_ap(_curve(spark, sf)).select(rnd("roc_auc", R10).alias("roc_auc"))


@register("e07_average_precision", with_layers([CURVE_SQL], f"""
SELECT {sql_round("sum(CASE WHEN pos > 0 THEN (pos / P) * (tps / (tps + fps)) END)", R10)} AS average_precision
FROM c, tot"""))
def e07(spark, sf):
    return ev.roc_auc_ap(_curve(spark, sf)).select(rnd("average_precision", R10).alias("average_precision"))


@register("e08_roc_pr_curve", with_layers([CURVE_SQL], """
SELECT threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(tps AS DOUBLE) AS tps,
       CAST(fps AS DOUBLE) AS fps, fps / N AS fpr, tps / P AS tpr, tps / (tps + fps) AS precision,
       tps / P AS recall FROM c, tot"""))
def e08(spark, sf):
    curve = _curve(spark, sf)
    tot = _scored(spark, sf).agg(F.sum((F.col("label") == 1).cast("long")).alias("P"),
                                 F.sum((F.col("label") != 1).cast("long")).alias("N")).collect()[0]
    return ev.roc_pr_points(curve, {"P": tot["P"], "N": tot["N"]}).select(
        "threshold", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"),
        F.col("tps").cast("double").alias("tps"), F.col("fps").cast("double").alias("fps"),
        "fpr", "tpr", "precision", "recall")


@register("e09_error_histogram", with_layers([FLOWS], """
, mm AS (SELECT min(ae_score) AS lo, max(ae_score) AS hi FROM flows),
b AS (SELECT least(CAST(floor((ae_score - lo) / (hi - lo) * 80) AS INTEGER), 79) AS bin, count(*) AS n
      FROM flows, mm GROUP BY 1)
SELECT r.range::INTEGER AS bin, lo + r.range * ((hi - lo) / 80) AS bin_lo, lo + (r.range + 1) * ((hi - lo) / 80) AS bin_hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM range(80) r, mm LEFT JOIN b ON b.bin = r.range"""))
def e09(spark, sf):
    return ev.error_histogram(_scored(spark, sf), "ae_score", 80)


@register("e10_error_series", with_layers([TAU_SQL], """
SELECT flow_id AS seq, ae_score AS err, tau AS threshold FROM flows, tau"""))
def e10(spark, sf):
    return ev.error_series(_scored(spark, sf), "flow_id", "ae_score", _tau(spark, sf))


@register("e11_error_moments", with_layers([FLOWS], f"""
SELECT {sql_round("avg(ae_score)", R9)} AS mean_err, {sql_round("stddev_pop(ae_score)", R9)} AS std_err FROM flows"""))
def e11(spark, sf):
    m = ev.error_moments(_scored(spark, sf), "ae_score")
    return m.select(rnd("mean_err", R9).alias("mean_err"), rnd("std_err", R9).alias("std_err"))


def _split_sql(where: str, frac: float) -> str:
    return with_layers([FLOWS], f"""
, r AS (SELECT flow_id, row_number() OVER (ORDER BY md5(CAST(flow_id AS VARCHAR) || '42')) - 1 AS rk,
               count(*) OVER () AS n FROM flows {where})
SELECT flow_id, CASE WHEN rk < n - CAST(floor(n * {frac}) AS BIGINT) THEN 'train' ELSE 'valid' END AS split FROM r""")


@register("d04_numeric_columns", with_layers([COMPACT_SQL], f"""
SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)} FROM compact"""))
def d04(spark, sf):
    comp = fl.compact_from_flows(fixtures.flows(spark, sf))
    return comp.select(*fl.numeric_columns(comp, drop=("label", "flow_id")))


@register("e12_exact_split", _split_sql("", 0.2))
def e12(spark, sf):
    return ev.exact_split(_scored(spark, sf), "flow_id", 0.2).select("flow_id", "split")


@register("e13_train_val_split", _split_sql("WHERE label = 0", 0.2))
def e13(spark, sf):
    normal = _scored(spark, sf).filter(F.col("label") == 0)
    return ev.exact_split(normal, "flow_id", 0.2).select("flow_id", "split")


@register("e14_stratified_split", with_layers([FLOWS], """
, r AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(flow_id AS VARCHAR) || '42')) - 1 AS rk,
               count(*) OVER (PARTITION BY label) AS n FROM flows)
SELECT flow_id, label, CASE WHEN rk < n - CAST(floor(n * 0.2) AS BIGINT) THEN 'train' ELSE 'valid' END AS split FROM r"""))
def e14(spark, sf):
    return ev.stratified_split(_scored(spark, sf), "flow_id", "label", 0.2).select("flow_id", "label", "split")


@register("e15_stats_rollup", with_layers(chain("rep2"), f"""
SELECT count(*) FILTER (WHERE is_anom) AS alerts_buffered,
       count(*) AS recent_buffered,
       count(DISTINCT CASE WHEN is_anom THEN concat_ws('|', k_src, k_dst, k_proto, k_class, CAST(k_port AS VARCHAR)) END)
         AS repeat_keys_buffered,
       CAST({fixed.LIVE_BANDS['ok']} AS DOUBLE) AS band_ok, CAST({fixed.LIVE_BANDS['warn']} AS DOUBLE) AS band_warn,
       CAST({fixed.LIVE_BANDS['crit']} AS DOUBLE) AS band_crit
FROM rep2"""))
def e15(spark, sf):
    return views.stats_rollup(_dec(spark, sf))


@register("e16_requests_by_status", with_layers([LOG_SQL], "SELECT status, count(*) AS requests FROM plog GROUP BY 1"))
def e16(spark, sf):
    return views.requests_by_status(fixtures.prediction_log(spark, sf))


def _e17_sql():
    parts = []
    for c in ("infer_ms", "total_ms"):
        for le in fixed.LATENCY_BUCKETS_MS:
            parts.append(f"SELECT '{c}' AS metric, '{le}' AS le, CAST(count(*) FILTER (WHERE {c} <= {float(le)}) AS DOUBLE) AS value FROM plog WHERE status = 'ok'")
        parts.append(f"SELECT '{c}', '+Inf', CAST(count({c}) AS DOUBLE) FROM plog WHERE status = 'ok'")
        parts.append(f"SELECT '{c}', 'sum', {sql_round(f'CAST(sum({c}) AS DOUBLE)', R6)} FROM plog WHERE status = 'ok'")
        parts.append(f"SELECT '{c}', 'count', CAST(count({c}) AS DOUBLE) FROM plog WHERE status = 'ok'")
    return with_layers([LOG_SQL], " UNION ALL ".join(parts))


@register("e17_latency_histograms", _e17_sql())
def e17(spark, sf):
    h = views.latency_histograms(fixtures.prediction_log(spark, sf))
    return h.withColumn("value", F.when(F.col("le") == "sum", rnd("value", R6)).otherwise(F.col("value")))


@register("f03_rolling_throughput", with_layers([FLOWS], f"""
SELECT flow_id,
  CASE WHEN n < 2 THEN 0.0 ELSE n / greatest(1e-6, ts_unix - first_ts) END AS throughput_fps
FROM (SELECT flow_id, ts_unix,
        count(*) OVER (ORDER BY ts_unix RANGE BETWEEN {fixed.THROUGHPUT_WINDOW_S} PRECEDING AND CURRENT ROW)
        - count(*) OVER (PARTITION BY ts_unix) + row_number() OVER (PARTITION BY ts_unix ORDER BY flow_id) AS n,
        min(ts_unix) OVER (ORDER BY ts_unix RANGE BETWEEN {fixed.THROUGHPUT_WINDOW_S} PRECEDING AND CURRENT ROW) AS first_ts
      FROM flows) x"""))
def f03(spark, sf):
    return views.rolling_throughput(fixtures.flows(spark, sf).select("flow_id", "ts_unix")).select(
        "flow_id", "throughput_fps")


@register("f04_recent", with_layers(chain("lab4"), f"""
SELECT flow_id, ts_unix, final_label, final_severity FROM lab4
ORDER BY ts_unix DESC, flow_id DESC LIMIT 1000"""))
def f04_recent(spark, sf):
    return views.recent(_dec(spark, sf), 1000).select("flow_id", "ts_unix", "final_label", "final_severity")


@register("f04_alerts", with_layers(chain("lab4"), f"""
SELECT flow_id, ts_unix, final_label, final_severity FROM lab4 WHERE is_anom
ORDER BY ts_unix DESC, flow_id DESC LIMIT 1000"""))
def f04_alerts(spark, sf):
    return views.alerts(_dec(spark, sf), 1000).select("flow_id", "ts_unix", "final_label", "final_severity")
