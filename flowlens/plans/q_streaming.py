"""Registered queries: the streaming job.

Each query writes its derived input to the shared folder, runs the stream
with ``availableNow`` into a parquet sink and returns the sink contents, so
the result can be compared with the batch formulation (same SQL oracle).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import views
from ..session import default_parallelism, scratch_dir
from ..sources.eve import stream_eve_flows
from ..streaming import live
from ..streaming import stream as st
from . import fixtures
from .oracle_sql import FLOWS, chain, with_layers
from .q_models import FEATS, _demo, demo_layers
from .q_sources import EVE_SRC, LIVE_SELECT, LIVE_SQL
from .q_stats import STATS_SQL
from .registry import register, sql_round, stable_round

EVENT_COLS = ["flow_id", "ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto",
              "direction", "ae_score"]


@register("t01_stream_flow_features", LIVE_SQL)
def t01(spark, sf):
    """A05 + T01: EVE lines read as a text stream -> B14 features, mDNS dropped."""
    path = st.write_stream_input(fixtures.eve_lines(spark, sf), spark, "eve", fmt="text")
    feats = fl.live_flow_features(stream_eve_flows(spark, path))
    return st.run_to_parquet(feats, spark, "t01")


def _event_stream(spark, sf):
    flows = fixtures.flows(spark, sf).select(*EVENT_COLS)
    path = st.write_stream_input(flows, spark, "events")
    return spark.readStream.schema(flows.schema).parquet(path)


def _in_time_order(df, spark, name, order, chunks, write, files=None):
    """Write ``df`` as ``chunks`` batches of files, each a stretch of ``order`` and later than the
    one before; returns the folder and the files of a batch."""
    path, files = scratch_dir(spark, name), files or max(1, default_parallelism(spark) // 2)
    top = df.agg(F.max(order)).first()[0] or 0
    size = top // chunks + 1
    for k in range(chunks):
        write(df.where((F.col(order) >= k * size) & (F.col(order) < (k + 1) * size)).repartition(files), path)
    return path, files


def _event_batches(spark, sf, chunks=4):
    flows = fixtures.flows(spark, sf).select(*EVENT_COLS)
    path, files = _in_time_order(flows, spark, "event-batches", "flow_id", chunks,
                                 lambda df, p: df.write.mode("append").parquet(p))
    return spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", str(files)).parquet(path)


@register("t02_stream_repetition", with_layers(chain("rep2"), """
SELECT flow_id, repeat_previous_count, repeat_count, repeat_level FROM rep2"""))
def t02(spark, sf):
    from ..functions.context import enrich_context, raw_event
    ev = enrich_context(raw_event(_event_batches(spark, sf)))
    rep = st.attach_repetition_stream(ev, columns=["flow_id"])
    out = st.run_to_parquet(rep.select("flow_id", "repeat_previous_count", "repeat_count", "repeat_level"),
                            spark, "t02")
    return out


@register("t03_stream_decisions", with_layers(chain("text"), """
SELECT flow_id, raw_severity, traffic_class, repeat_level, final_severity, final_label, summary FROM t5"""))
def t03(spark, sf):
    dec = st.decision_stream(_event_stream(spark, sf))
    return st.run_to_parquet(dec.select("flow_id", "raw_severity", "traffic_class", "repeat_level",
                                        "final_severity", "final_label", "summary"), spark, "t03")


# --- the live job ------------------------------------------------------------
def _base(sql):
    return re.sub(r"\bflows\b", "base", sql)


REQUEST_SQL = """reqs AS (
SELECT CAST(b.flow_id AS VARCHAR) AS flow_id, b.ts_unix, b.src_ip, b.src_port, b.dest_ip, b.dest_port, b.proto,
       b.app_proto, b.direction, c.pkts_fwd, c.pkts_rev, c.bytes_fwd, c.bytes_rev, c.duration, c.pkt_rate, c.byte_rate,
       c.fwd_rev_ratio, c.proto AS proto_feature FROM base b JOIN compact c ON c.flow_id = b.flow_id WHERE b.flow_id % 20 = 17)"""
_ITEMS = "[" + ", ".join(f"{{'e': e{k}, 'i': {k}, 'n': '{f}', 'r': {'proto_feature' if f == 'proto' else f}}}"
                         for k, f in enumerate(FEATS)) + "]"
_TOP = f"list_slice(list_reverse(list_sort({_ITEMS})), 1, 5)"
LIVE_LAYERS = [
    _base(STATS_SQL), _base(EVE_SRC[len(FLOWS) + 2:]), f"lv AS ({LIVE_SELECT})", REQUEST_SQL,
    "feats AS (SELECT * FROM lv UNION ALL SELECT * FROM reqs)", *demo_layers("feats", {"proto": "proto_feature"}),
    "flows AS (SELECT flow_id, ts_unix, src_ip, src_port, dest_ip, dest_port, proto, app_proto, direction, mse AS ae_score, "
    "0 AS label FROM ms)", *chain("text")[1:]]
LIVE_COLUMNS = ["src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "direction", "raw_severity", "traffic_class",
                "likely_benign", "benign_reason", "traffic_note", "repeat_count", "repeat_previous_count", "repeat_level",
                "final_label", "final_severity", "display_label_reason", "summary", "interpretation", "explanation",
                "adjustment_reason", "possible_explanation", "what_to_check"]


def _live_job(spark, sf, chunks=4):
    """The job over the fixture lines in several micro-batches."""
    _, model = _demo(spark, sf)
    lines = fixtures.live_lines(spark, sf)
    # a gzip file is read by one task: as many files a batch as cores
    path, files = _in_time_order(lines, spark, "live-lines", "line_no", chunks,
                                 lambda df, p: df.select("value").write.mode("append").text(p, compression="gzip"),
                                 default_parallelism(spark))
    job = live.LiveJob(spark, model, scratch_dir(spark, "live"))
    stream = spark.readStream.option("maxFilesPerTrigger", str(files)).text(path)
    q = job.start(stream, scratch_dir(spark, "live-ckpt"), availableNow=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return job


@register("t03_live_job", with_layers(LIVE_LAYERS, f"""
SELECT t5.flow_id, t5.ts_unix, {', '.join('t5.' + c for c in LIVE_COLUMNS)}, {sql_round('t5.ae_score', 6)} AS ae_score,
  t5.is_anom AS raw_model_flag, t5.context_tags_text, t5.k_dst AS key_dest_ip, t5.k_port AS key_dest_port,
  t5.final_severity_before_repeat AS severity_before_repeat, t5.final_severity_after_context AS severity_after_context,
  t5.repeat_explanation, t5.repeat_previous_count > 0 AS is_repeated,
  array_to_string(list_transform({_TOP}, lambda s: s.n), ',') AS top_features,
  array_to_string(list_transform({_TOP}, lambda s: CAST(CAST(s.r AS BIGINT) AS VARCHAR)), ',') AS top_raw,
  {sql_round(f'({_TOP})[1].e', 6)} AS top_err, CAST(8.0 AS DOUBLE) AS crit_band
FROM t5 JOIN ms ON ms.flow_id = t5.flow_id AND ms.ts_unix = t5.ts_unix"""))
def t03_live(spark, sf):
    """Every section of the records of the live job, flattened."""
    rec = _live_job(spark, sf).records()
    info, top = F.col("debug.repeat_info"), F.col("top_features")
    return rec.select(
        "flow_id", "ts_unix", *LIVE_COLUMNS, stable_round("ae_score", 6).alias("ae_score"), "raw_model_flag",
        F.array_join("context_tags", ",").alias("context_tags_text"), info["repeat_key"]["dest_ip"].alias("key_dest_ip"),
        info["repeat_key"]["dest_port"].alias("key_dest_port"), "debug.severity_before_repeat",
        "debug.severity_after_context", "debug.repeat_explanation", info["is_repeated"].alias("is_repeated"),
        F.array_join(F.transform(top, lambda t: t["name"]), ",").alias("top_features"),
        F.array_join(F.transform("top_features_raw", lambda t: F.rint(t["raw"]).cast("long").cast("string")), ",").alias("top_raw"),
        stable_round(top[0]["err"], 6).alias("top_err"), F.col("model.bands.crit").alias("crit_band"))


@register("t03_live_rejected", with_layers([FLOWS], """
SELECT CAST(flow_id AS VARCHAR) AS flow_id, ts_unix, 'missing_features=2 ex=[''byte_rate'', ''proto'']' AS error
FROM flows WHERE flow_id % 20 = 7"""))
def t03_rejected(spark, sf):
    return _live_job(spark, sf).rejected().select("flow_id", "ts_unix", "error")


@register("t03_live_requests", with_layers(LIVE_LAYERS, """
SELECT 'ok' AS status, count(*) AS requests FROM ms
UNION ALL SELECT 'error', count(*) FROM base WHERE flow_id % 20 = 7"""))
def t03_requests(spark, sf):
    """E16 on what the live job answered."""
    return views.requests_by_status(_live_job(spark, sf).requests())


@register("t04_stream_throughput", with_layers([FLOWS], """
, w AS (SELECT ts_unix, unnest(generate_series(CAST(floor(ts_unix) AS BIGINT) - 9, CAST(floor(ts_unix) AS BIGINT))) AS s FROM flows)
SELECT s AS window_start, s + 10 AS window_end, count(*) AS n, count(*) / 10.0::DOUBLE AS fps FROM w
WHERE ts_unix >= s AND ts_unix < s + 10 GROUP BY s"""))
def t04(spark, sf):
    """Sliding 10 s windows (1 s slide), closed by the watermark; a closing event after the data
    lets the last ones out."""
    rows = fixtures.flows(spark, sf).select("flow_id", "ts_unix")
    path = scratch_dir(spark, "throughput-in")
    files = max(1, default_parallelism(spark) // 2)
    rows.repartition(files).write.parquet(path)
    st.closing_event(rows).repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(files)).parquet(path)
    out = st.run_to_parquet(st.throughput_windows(stream), spark, "t04")
    return out.select(F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"),
                      "n", "fps")


@register("t05_stream_watermark_late_rows", with_layers(chain("rep2"), """
SELECT 2 * count(*) AS rows_out, 2 * count(*) FILTER (WHERE is_anom) AS anomalous_rows_out,
       2 * count(*) FILTER (WHERE NOT is_anom) AS quiet_rows_out FROM rep2"""))
def t05(spark, sf):
    """Late data (T05): the events arrive as one micro-batch of files, then the
    same events are replayed as a second micro-batch, behind the watermark.
    The keyed-state operator keeps every row and counts it in arrival order
    (as the per-key deque does); the watermark only expires idle keys, and a
    key touched by late rows gets its timeout clamped to the watermark.
    Returns the row counts (twice the events, split by the model flag)."""
    from ..functions.context import enrich_context, raw_event
    flows = fixtures.flows(spark, sf).select(*EVENT_COLS)
    path = st.scratch_dir(spark, "late-in")
    files = max(1, default_parallelism(spark))
    flows.repartition(files).write.parquet(path)             # first micro-batch
    flows.repartition(files).write.mode("append").parquet(path)  # replay, written later
    stream = (spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", str(files))
              .parquet(path))
    rep = st.attach_repetition_stream(enrich_context(raw_event(stream)), watermark="45 seconds",
                                      columns=["flow_id", "is_anom"])
    out = st.run_to_parquet(rep.select("flow_id", "is_anom", "repeat_count"), spark, "t05")
    return out.agg(F.count(F.lit(1)).alias("rows_out"),
                   F.count(F.when(F.col("is_anom"), 1)).alias("anomalous_rows_out"),
                   F.count(F.when(~F.col("is_anom"), 1)).alias("quiet_rows_out"))


@register("a07_stream_prediction_log")
def a07_stream(spark, sf):
    """Append-only JSON log written by the stream, partitioned by UTC date."""
    dec = st.decision_stream(_event_stream(spark, sf), with_text=False)
    rec = dec.select("flow_id", "ts_unix", "ae_score", "raw_severity", "final_label",
                     F.to_date(F.timestamp_seconds("ts_unix")).alias("log_date"))
    out = st.scratch_dir(spark, "plog")
    ck = st.scratch_dir(spark, "plog-ckpt")
    w = (rec.writeStream.format("json").option("checkpointLocation", ck).partitionBy("log_date")
         .trigger(availableNow=True))
    q = st.start_with_state_partitions(w, out, spark, default_parallelism(spark))
    q.awaitTermination()
    return spark.read.json(out)
