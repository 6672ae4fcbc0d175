"""Registered queries: context, repetition, decision ladder and text (G, F01-F02, H, D06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.context import enrich_context, escalate_one_level, raw_event
from ..functions.decision import adjust_for_context, display_label, repeat_review
from ..functions.ipscope import annotate_ip_scope
from ..functions.text import attach_explanations
from ..operators.alerts import assemble_alert
from ..operators.repetition import attach_repetition
from . import fixtures
from .oracle_sql import chain, q, with_layers
from .registry import register

EV = chain("rep2")
DEC = chain("lab4")
TXT = chain("text")


# The context stage is a plan: built once per session and input folder. Repetition runs
# a job when it is called, so every query runs its own: what a query costs does not
# depend on the queries before it.
def _ctx(spark, sf):
    return fixtures.memo(spark, sf, "ctx", lambda: enrich_context(raw_event(fixtures.flows(spark, sf)),
                                                                 keep_helpers=True))


def _rep(spark, sf):
    return attach_repetition(_ctx(spark, sf))


def _dec(spark, sf):
    return display_label(repeat_review(adjust_for_context(_rep(spark, sf))))


def _txt(spark, sf):
    return attach_explanations(_dec(spark, sf))


# --- flagship slice ---------------------------------------------------------
def flagship(spark, sf):
    ev = _rep(spark, sf)
    return (ev.groupBy("traffic_class", "raw_severity", "repeat_level")
            .agg(F.count(F.lit(1)).alias("n")))


register("slice_class_severity_repeat", with_layers(EV, """
SELECT traffic_class, raw_severity, repeat_level, count(*) AS n FROM rep2
GROUP BY traffic_class, raw_severity, repeat_level"""))(flagship)


@register("g01_severity_bands", with_layers(EV, "SELECT flow_id, raw_severity, is_anom FROM ev_n"))
def g01(spark, sf):
    return raw_event(fixtures.flows(spark, sf)).select("flow_id", "raw_severity", "is_anom")


@register("g02_raw_event", with_layers(EV, """
SELECT flow_id, ts_unix, src_ip, src_port, dest_ip, dest_port, proto, app_proto, direction, ae_score,
       raw_severity, is_anom AS raw_model_flag FROM ev_n"""))
def g02(spark, sf):
    return raw_event(fixtures.flows(spark, sf)).select(
        "flow_id", "ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto",
        "direction", "ae_score", "raw_severity", F.col("is_anom").alias("raw_model_flag"))


@register("c10_ip_scope", with_layers(EV, """
SELECT flow_id, s_private AS src_ip_private, s_loopback AS src_ip_loopback, s_link_local AS src_ip_link_local,
       s_multicast AS src_ip_multicast, s_unspecified AS src_ip_unspecified,
       d_private AS dest_ip_private, d_loopback AS dest_ip_loopback, d_link_local AS dest_ip_link_local,
       d_multicast AS dest_ip_multicast, d_unspecified AS dest_ip_unspecified, _db AS dest_ip_broadcast
FROM ev_s"""))
def c10(spark, sf):
    f = fixtures.flows(spark, sf).select("flow_id", "src_ip", "dest_ip")
    return annotate_ip_scope(f, ["src_ip", "dest_ip"]).drop("src_ip", "dest_ip").drop("src_ip_broadcast")


@register("g03_direction", with_layers(EV, "SELECT flow_id, _dir AS direction_norm FROM ev_d"))
def g03(spark, sf):
    return _ctx(spark, sf).select("flow_id", "direction_norm")


@register("g04_traffic_class", with_layers(EV, "SELECT flow_id, class0 AS traffic_class_rule FROM cls"))
def g04(spark, sf):
    return _ctx(spark, sf).select("flow_id", F.col("_class0").alias("traffic_class_rule"))


@register("g05_traffic_note", with_layers(EV, "SELECT flow_id, traffic_note FROM note"))
def g05(spark, sf):
    return _ctx(spark, sf).select("flow_id", "traffic_note")


@register("g06_context_tags", with_layers(EV, "SELECT flow_id, context_tags_text FROM note"))
def g06(spark, sf):
    return _ctx(spark, sf).select("flow_id", F.array_join("context_tags", ",").alias("context_tags_text"))


@register("g07_benign_context", with_layers(EV, """
SELECT flow_id, traffic_class, likely_benign, benign_reason FROM note"""))
def g07(spark, sf):
    return _ctx(spark, sf).select("flow_id", "traffic_class", "likely_benign", "benign_reason")


@register("f01_repeat_key", with_layers(EV, """
SELECT flow_id, k_src, k_dst, k_proto, k_class, k_port FROM rkey"""))
def f01(spark, sf):
    ev = _rep(spark, sf)
    k = F.col("repetition_key")
    return ev.select("flow_id", k["src_ip"].alias("k_src"), k["dest_ip"].alias("k_dst"),
                     k["proto"].alias("k_proto"), k["traffic_class"].alias("k_class"),
                     k["dest_port"].alias("k_port"))


@register("f02_repetition", with_layers(EV, """
SELECT flow_id, repeat_previous_count, repeat_count, repeat_level FROM rep2"""))
def f02(spark, sf):
    return _rep(spark, sf).select("flow_id", "repeat_previous_count", "repeat_count", "repeat_level")


@register("g08_common_desktop", with_layers(DEC, "SELECT flow_id, common_desktop FROM adj1"))
def g08(spark, sf):
    return adjust_for_context(_rep(spark, sf)).select("flow_id", "common_desktop")


@register("g09_context_severity", with_layers(DEC, """
SELECT flow_id, final_severity_after_context, array_to_string(_reasons, '|') AS context_reasons FROM adj3"""))
def g09(spark, sf):
    return adjust_for_context(_rep(spark, sf)).select(
        "flow_id", "final_severity_after_context",
        F.array_join("adjustment_reasons", "|").alias("context_reasons"))


@register("g10_escalate_one_level", with_layers(EV, """
SELECT flow_id, raw_severity,
       CASE raw_severity WHEN 'OK' THEN 'WARN' WHEN 'WARN' THEN 'MED' WHEN 'MED' THEN 'CRIT'
                         WHEN 'CRIT' THEN 'CRIT' ELSE raw_severity END AS escalated
FROM ev"""))
def g10(spark, sf):
    ev = raw_event(fixtures.flows(spark, sf))
    return ev.select("flow_id", "raw_severity", escalate_one_level("raw_severity").alias("escalated"))


@register("g11_repeat_review", with_layers(DEC, """
SELECT flow_id, final_severity_before_repeat, final_severity_review, final_severity_reason FROM rv3"""))
def g11(spark, sf):
    return repeat_review(adjust_for_context(_rep(spark, sf))).select(
        "flow_id", "final_severity_before_repeat", "final_severity_review", "final_severity_reason")


@register("g12_display_label", with_layers(DEC, """
SELECT flow_id, final_severity, final_label, display_label_reason,
       array_to_string(adjustment_reasons, '|') AS adjustment_reasons_text FROM lab4"""))
def g12(spark, sf):
    return _dec(spark, sf).select("flow_id", "final_severity", "final_label", "display_label_reason",
                                  F.array_join("adjustment_reasons", "|").alias("adjustment_reasons_text"))


@register("h01_repeat_explanation", with_layers(TXT, "SELECT flow_id, repeat_explanation FROM t5"))
def h01(spark, sf):
    return _txt(spark, sf).select("flow_id", "repeat_explanation")


@register("h02_adjustment_reason", with_layers(TXT, "SELECT flow_id, adjustment_reason FROM t5"))
def h02(spark, sf):
    return _txt(spark, sf).select("flow_id", "adjustment_reason")


@register("h03_interpretation", with_layers(TXT, "SELECT flow_id, interpretation FROM t5"))
def h03(spark, sf):
    return _txt(spark, sf).select("flow_id", "interpretation")


@register("h04_summary", with_layers(TXT, "SELECT flow_id, summary FROM t5"))
def h04(spark, sf):
    return _txt(spark, sf).select("flow_id", "summary")


@register("h05_explanation", with_layers(TXT, "SELECT flow_id, explanation FROM t5"))
def h05(spark, sf):
    return _txt(spark, sf).select("flow_id", "explanation")


@register("h06_possible_explanation", with_layers(TXT, """
SELECT flow_id, possible_explanation, what_to_check FROM t5"""))
def h06(spark, sf):
    return _txt(spark, sf).select("flow_id", "possible_explanation", "what_to_check")


H07_COLS = ["summary", "interpretation", "explanation", "adjustment_reason", "possible_explanation",
            "what_to_check"]


@register("h07_explanation_bundle", with_layers(TXT, f"""
SELECT flow_id, {', '.join(H07_COLS)}, summary AS short_summary, explanation AS full_explanation FROM t5"""))
def h07(spark, sf):
    return _txt(spark, sf).select("flow_id", *H07_COLS, "short_summary", "full_explanation")


G13_FLAT = ["flow_id", "ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto",
            "direction", "ae_score", "raw_severity", "raw_model_flag", "traffic_class", "likely_benign",
            "benign_reason", "traffic_note", "repeat_count", "repeat_previous_count", "repeat_level",
            "repeat_window_s", "final_label", "final_severity", "display_label", "severity",
            "display_label_reason", "summary", "interpretation", "adjustment_reason",
            "possible_explanation", "what_to_check"]


@register("g13_final_alert", with_layers(TXT, """
SELECT CAST(flow_id AS VARCHAR) AS flow_id, ts_unix, src_ip, src_port, dest_ip, dest_port, proto, app_proto,
       direction, ae_score, raw_severity, is_anom AS raw_model_flag, traffic_class, likely_benign, benign_reason,
       traffic_note, repeat_count, repeat_previous_count, repeat_level, 45 AS repeat_window_s, final_label,
       final_severity, final_label AS display_label, final_severity AS severity, display_label_reason, summary,
       interpretation, adjustment_reason, possible_explanation, what_to_check,
       final_severity_before_repeat AS severity_before_repeat,
       final_severity_after_context AS severity_after_context, k_dst AS key_dest_ip, k_port AS key_dest_port
FROM t5"""))
def g13(spark, sf):
    rec = assemble_alert(_txt(spark, sf))
    return rec.select(*G13_FLAT,
                      F.col("debug.severity_before_repeat").alias("severity_before_repeat"),
                      F.col("debug.severity_after_context").alias("severity_after_context"),
                      F.col("repetition_key.dest_ip").alias("key_dest_ip"),
                      F.col("repetition_key.dest_port").alias("key_dest_port"))


@register("d06_alerts", with_layers(DEC, """
SELECT flow_id, raw_severity, final_severity, final_label FROM lab4 WHERE is_anom"""))
def d06(spark, sf):
    return _dec(spark, sf).filter(F.col("is_anom")).select("flow_id", "raw_severity", "final_severity",
                                                          "final_label")


__all__ = ["fixed", "q"]


@register("g13_alert_timing", with_layers(TXT, f"""
, thr AS (
  SELECT flow_id,
    CASE WHEN n < 2 THEN 0.0 ELSE n / greatest(1e-6, ts_unix - first_ts) END AS throughput_fps
  FROM (SELECT flow_id, ts_unix,
          count(*) OVER (ORDER BY ts_unix RANGE BETWEEN {fixed.THROUGHPUT_WINDOW_S} PRECEDING AND CURRENT ROW)
          - count(*) OVER (PARTITION BY ts_unix) + row_number() OVER (PARTITION BY ts_unix ORDER BY flow_id) AS n,
          min(ts_unix) OVER (ORDER BY ts_unix RANGE BETWEEN {fixed.THROUGHPUT_WINDOW_S} PRECEDING AND CURRENT ROW)
            AS first_ts
        FROM flows) x)
SELECT CAST(t5.flow_id AS VARCHAR) AS flow_id, CAST(t5.flow_id % 997 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS infer_ms,
       CAST(t5.flow_id % 997 AS DOUBLE) / CAST(10.0 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS total_ms,
       thr.throughput_fps, t5.final_label
FROM t5 JOIN thr ON thr.flow_id = t5.flow_id"""))
def g13_timing(spark, sf):
    """G13 timing section (infer, total latency and rolling throughput) of the
    record built from the prediction log."""
    from ..operators.alerts import decide_events
    rec = assemble_alert(decide_events(fixtures.prediction_log(spark, sf), with_throughput=True))
    return rec.select("flow_id", F.col("timing.infer_ms").alias("infer_ms"), F.col("timing.total_ms").alias("total_ms"),
                      F.col("timing.throughput_fps").alias("throughput_fps"), "final_label")
