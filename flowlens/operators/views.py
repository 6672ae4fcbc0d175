"""Serving views over the alert table / prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def rolling_throughput(df: DataFrame, ts_col: str = "ts_unix", seq_col: str = "flow_id",
                       window_s: float = fixed.THROUGHPUT_WINDOW_S, bucket_s: int = 60) -> DataFrame:
    """events per second over the last ``window_s`` seconds at each event
    (inclusive; later events with the same timestamp are not yet counted):
    n / max(1e-6, ts - first), 0 when n < 2.

    The window is partitioned by time bucket (>= window_s) and each row is also
    copied into the bucket of ts + window_s, so no task holds the whole stream."""
    if bucket_s < window_s:
        raise ValueError("bucket_s must be >= window_s")
    ts = F.col(ts_col).cast("double")
    own = F.floor(ts / F.lit(float(bucket_s)))
    nxt = F.floor((ts + F.lit(float(window_s))) / F.lit(float(bucket_s)))
    x = df.withColumn("_own_b", own).withColumn("_b", F.explode(F.array_distinct(F.array(own, nxt))))
    frame = Window.partitionBy("_b").orderBy(ts).rangeBetween(-int(window_s), 0)
    x = x.withColumns({"_c": F.count(F.lit(1)).over(frame), "_first": F.min(ts).over(frame)})
    peers = Window.partitionBy("_b", ts_col)  # served by the "_b" exchange above
    x = x.withColumns({"_pn": F.count(F.lit(1)).over(peers),
                       "_rn": F.row_number().over(peers.orderBy(F.col(seq_col)))})
    x = x.filter(F.col("_b") == F.col("_own_b"))
    n = F.col("_c") - F.col("_pn") + F.col("_rn")
    fps = F.when(n < 2, F.lit(0.0)).otherwise(n / F.greatest(F.lit(1e-6), ts - F.col("_first")))
    return x.withColumn("throughput_fps", fps).drop("_own_b", "_b", "_pn", "_rn", "_c", "_first")


def newest(df: DataFrame, limit: int, ts_col: str = "ts_unix", seq_col: str = "flow_id") -> DataFrame:
    """the ``limit`` newest rows, newest first (TakeOrderedAndProject). A limit
    below 1 is rejected; whoever serves from a buffer passes its size."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    return df.orderBy(F.col(ts_col).desc(), F.col(seq_col).desc()).limit(limit)


def recent(df: DataFrame, limit: int = 50) -> DataFrame:
    return newest(df, limit)


def alerts(df: DataFrame, limit: int = 50) -> DataFrame:
    """Alerts are events with the raw model flag."""
    return newest(df.filter(F.col("is_anom")), limit)


def stats_rollup(decided: DataFrame, bands: dict | None = None) -> DataFrame:
    """Bands, true counts of alerts, events and distinct repetition keys."""
    b = fixed.LIVE_BANDS if bands is None else bands
    return decided.agg(
        F.count(F.when(F.col("is_anom"), 1)).alias("alerts_buffered"),
        F.count(F.lit(1)).alias("recent_buffered"),
        F.count_distinct(F.col("repetition_key")).alias("repeat_keys_buffered"),
    ).withColumns({"band_ok": F.lit(b["ok"]), "band_warn": F.lit(b["warn"]), "band_crit": F.lit(b["crit"])})


def requests_by_status(log: DataFrame) -> DataFrame:
    """E16."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histograms(log: DataFrame, cols=("infer_ms", "total_ms"),
                       buckets=fixed.LATENCY_BUCKETS_MS) -> DataFrame:
    """Cumulative bucket counts (le), +Inf, sum and count per latency column,
    from successful requests; one aggregation pass (no row explosion)."""
    ok = log.filter(F.col("status") == "ok")
    aggs = []
    for c in cols:
        for i, le in enumerate(buckets):
            aggs.append(F.sum((F.col(c) <= F.lit(float(le))).cast("long")).alias(f"{c}__{i}"))
        aggs += [F.count(F.col(c)).alias(f"{c}__inf"), F.sum(c).alias(f"{c}__sum")]
    wide = ok.agg(*aggs)
    rows = []
    for c in cols:
        for i, le in enumerate(buckets):
            rows.append(F.struct(F.lit(c).alias("metric"), F.lit(str(le)).alias("le"),
                                 F.col(f"{c}__{i}").cast("double").alias("value")))
        rows.append(F.struct(F.lit(c).alias("metric"), F.lit("+Inf").alias("le"),
                             F.col(f"{c}__inf").cast("double").alias("value")))
        rows.append(F.struct(F.lit(c).alias("metric"), F.lit("sum").alias("le"),
                             F.col(f"{c}__sum").cast("double").alias("value")))
        rows.append(F.struct(F.lit(c).alias("metric"), F.lit("count").alias("le"),
                             F.col(f"{c}__inf").cast("double").alias("value")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
