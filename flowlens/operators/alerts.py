"""The per-event decision job (batch form of the live path) and G13 assembly.

score -> raw event (G01/G02) -> context (G03-G07) -> repetition (F01/F02)
-> context adjust, repeat review, label (G09-G12) -> text (H01-H07)
-> final record (G13). One shuffle in total: the repetition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.context import enrich_context, raw_event
from ..functions.decision import decide
from ..functions.text import attach_explanations
from .repetition import attach_repetition
from .views import rolling_throughput

EVENT_COLUMNS = ["flow_id", "ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto",
                 "app_proto", "direction", "ae_score"]


def decide_events(df: DataFrame, bands: dict | None = None, with_text: bool = True,
                  with_throughput: bool = False) -> DataFrame:
    """Events with ``ae_score`` -> all decision columns (flat).

    ``with_throughput`` adds ``throughput_fps`` (F03, the rolling 10 s rate at
    each event, as stamped on the raw event) at the cost of one more shuffle
    (time buckets)."""
    extra = [c for c in df.columns if c not in EVENT_COLUMNS]
    ev = df.select(*EVENT_COLUMNS, *extra)
    if with_throughput:
        ev = rolling_throughput(ev)
    ev = raw_event(ev, bands)
    ev = enrich_context(ev)
    ev = attach_repetition(ev)
    ev = decide(ev)
    if with_text:
        ev = attach_explanations(ev)
    return ev


def assemble_alert(df: DataFrame, bands: dict | None = None) -> DataFrame:
    """Nested final alert record (one struct column per section)."""
    bands = fixed.LIVE_BANDS if bands is None else bands
    band_struct = F.struct(*[F.lit(float(bands[k])).alias(k) for k in ("ok", "warn", "crit")])
    timing_cols = [c for c in ("infer_ms", "total_ms", "throughput_fps") if c in df.columns]
    timing = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                        for c in ("infer_ms", "total_ms", "throughput_fps")]) if timing_cols else \
        F.struct(F.lit(0.0).alias("infer_ms"), F.lit(0.0).alias("total_ms"), F.lit(0.0).alias("throughput_fps"))
    cols = [
        F.col("ts_unix").cast("double").alias("ts_unix"),
        F.col("flow_id").cast("string").alias("flow_id"),
        "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "direction",
        F.col("ae_score").cast("double").alias("ae_score"),
        "raw_severity", F.col("is_anom").alias("raw_model_flag"),
        "traffic_class", "likely_benign", "benign_reason", "traffic_note", "context_tags",
        "repeat_count", "repeat_previous_count", "repeat_level", "repeat_window_s", "repetition_key",
        "final_label", "final_severity", "summary", "interpretation", "explanation",
        F.coalesce(F.nullif("adjustment_reason", F.lit("")), F.nullif("final_severity_reason", F.lit("")),
                   F.lit("")).alias("adjustment_reason"),
        "possible_explanation", "what_to_check",
        F.col("final_label").alias("display_label"), "display_label_reason",
        F.col("final_severity").alias("severity"),
        timing.alias("timing"),
        F.struct(F.lit("autoencoder").alias("name"), band_struct.alias("bands")).alias("model"),
        F.struct(F.col("is_anom").alias("is_anom"),
                 F.col("final_severity_before_repeat").alias("severity_before_repeat"),
                 F.col("final_severity_after_context").alias("severity_after_context"),
                 F.col("repeat_explanation").alias("repeat_explanation"),
                 F.struct(F.col("repetition_key").alias("repeat_key"), F.col("repeat_window_s").alias("repeat_window_s"),
                          F.col("repeat_previous_count").alias("previous_count"),
                          F.col("repeat_count").alias("current_count"), F.col("repeat_level").alias("repeat_level"),
                          F.col("repeat_boost").alias("suspicion_boost"),
                          F.col("is_repeated").alias("is_repeated")).alias("repeat_info")).alias("debug"),
    ]
    for c in ("top_features", "top_features_raw"):
        if c in df.columns:
            cols.append(c)
    return df.select(*cols)
