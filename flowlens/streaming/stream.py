"""The live decision path as one Structured Streaming query.

* T01: EVE lines -> the B14 features and D02 mDNS filter (same column code as batch).
* T02: the 45 s repetition count with keyed state: ``applyInPandasWithState`` per
  repetition key; the state in RocksDB is the deque of at most 50 event times, and an
  event-time timeout drops a key 45 s after its newest event. Only anomalous rows reach the stateful
  operator; the others pass through with the defaults (no null-key hot group).
  A key's rows of a micro-batch meet in one task; the live job (``live.py``)
  cuts hot keys.
* T03: features -> score -> context -> repetition -> decision -> text -> sink.
* T04: rolling throughput as a sliding event-time window count.
* T05: the watermark is configurable (default 45 s, the repetition window).
  Within a micro-batch events are processed in (event time, sequence) order;
  across micro-batches in arrival order, as the reference's deque does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import fixed
from ..functions.context import enrich_context, raw_event
from ..functions.decision import decide
from ..functions.text import attach_explanations
from ..operators.repetition import look_back, repeat_key_expr, with_levels
from ..session import default_parallelism, scratch_dir

KEY_FIELDS = ["k_src", "k_dst", "k_proto", "k_class", "k_port"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: columns that the count reads
COUNTED_BY = ["flow_id", "ts_unix", "is_anom", "src_ip", "dest_ip", "proto", "traffic_class", "dest_port"]

STATE_SCHEMA = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))])


def repetition_state_fn(window_s: float = fixed.REPEAT_WINDOW_S, cap: int = fixed.REPEAT_MAX_EVENTS_PER_KEY,
                        ts_col: str = "ts_unix", seq_col: str = "flow_id"):
    """Per-key deque: evict times older than ``window_s`` (strictly) from its head, previous =
    its length, append, keep the newest ``cap``. The rows of a micro-batch are counted
    together by the look-back of the batch operator, after the times in the state."""
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        had = [float(t) for t in state.get[0]] if state.exists else []
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        # only time and sequence are put in order; the rows stay where they are
        order = pd.concat([p[[ts_col, seq_col]] for p in frames], ignore_index=True).sort_values(
            [ts_col, seq_col], kind="mergesort")
        ts = np.concatenate([np.array(had, dtype=float), order[ts_col].to_numpy(dtype=float)])
        one = np.zeros(len(ts), dtype=np.int64)
        prev = look_back(one, one, ts, window_s, cap)
        left = [float(t) for t in ts[-min(int(prev[-1]) + 1, cap):]]
        state.update((left,))
        # expire 45 s after the newest time, never before the current watermark
        expire_ms = int((max(left) + float(window_s)) * 1000) + 1
        state.setTimeoutTimestamp(max(expire_ms, state.getCurrentWatermarkMs() + 1))
        counts = np.empty(len(order), dtype=np.int32)
        counts[order.index.to_numpy()] = prev[len(had):]
        del order, ts, one, prev
        frames.reverse()
        while frames:
            pdf = frames.pop()
            mine, counts = counts[:len(pdf)], counts[len(pdf):]
            yield pdf.assign(repeat_previous_count=mine)
    return fn


def attach_repetition_stream(events: DataFrame, watermark: str = "45 seconds",
                             window_s: float = fixed.REPEAT_WINDOW_S,
                             cap: int = fixed.REPEAT_MAX_EVENTS_PER_KEY, columns: list[str] | None = None) -> DataFrame:
    """T02 on a streaming frame with ``is_anom`` and ``traffic_class``: one list of at most
    ``cap`` times per key in RocksDB. No row is dropped for being late. With ``columns`` only
    those and what the count needs go on: Spark prunes no columns below Python."""
    if columns is not None:
        events = events.select(*dict.fromkeys([*columns, *COUNTED_BY]))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key = repeat_key_expr()
    ev = events.withColumn("event_time", F.timestamp_seconds(F.col("ts_unix")))
    ev = ev.withWatermark("event_time", watermark)
    anom = ev.filter(F.col("is_anom")).withColumns({
        "k_src": key["src_ip"], "k_dst": key["dest_ip"], "k_proto": key["proto"],
        "k_class": key["traffic_class"], "k_port": key["dest_port"]})
    out_schema = T.StructType(list(anom.schema.fields) + [T.StructField("repeat_previous_count", T.IntegerType())])
    counted = anom.groupBy(*KEY_FIELDS).applyInPandasWithState(
        repetition_state_fn(window_s, cap), out_schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    counted = counted.withColumn("repetition_key", F.struct(
        F.col("k_src").alias("src_ip"), F.col("k_dst").alias("dest_ip"), F.col("k_proto").alias("proto"),
        F.col("k_class").alias("traffic_class"), F.col("k_port").alias("dest_port"))).drop(*KEY_FIELDS)
    quiet = ev.filter(~F.col("is_anom")).withColumns({
        "repeat_previous_count": F.lit(0),
        "repetition_key": F.lit(None).cast(counted.schema["repetition_key"].dataType)})
    return with_levels(counted.unionByName(quiet), window_s, cap)


def decision_stream(events: DataFrame, bands: dict | None = None, watermark: str = "45 seconds",
                    with_text: bool = True) -> DataFrame:
    """Scored events (``ae_score``) -> full decision record columns."""
    ev = enrich_context(raw_event(events, bands))
    ev = attach_repetition_stream(ev, watermark)
    ev = decide(ev)
    return attach_explanations(ev) if with_text else ev


def throughput_windows(events: DataFrame, window: str = "10 seconds", slide: str = "1 second",
                       watermark: str = "10 seconds") -> DataFrame:
    """Events per sliding event-time window (approximation of F03)."""
    ev = events.withColumn("event_time", F.timestamp_seconds(F.col("ts_unix"))).withWatermark("event_time", watermark)
    secs = float(window.split()[0])
    return (ev.groupBy(F.window("event_time", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                    (F.col("n") / F.lit(secs)).alias("fps")))


def closing_event(events: DataFrame, window: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """One row that moves the watermark past every window of ``events``, to be sent as a batch after
    them. Windows that it falls into itself stay open, so none of them comes out."""
    past = sum(float(x.split()[0]) for x in (window, watermark)) + 60.0
    names = [f.name for f in events.schema.fields]
    last = events.agg((F.max("ts_unix") + F.lit(past)).alias("ts_unix"))
    return last.select(*[F.col(c) if c == "ts_unix" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in names])


def start_with_state_partitions(writer, path: str, spark: SparkSession, state_partitions: int | None):
    """Start a query whose stateful operators use ``state_partitions`` shuffle
    partitions (fixed in its checkpoint at the first batch). The stream clones
    the session at start, so the caller's setting is restored right after."""
    if not state_partitions:
        return writer.start(path)
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start(path)
    finally:
        spark.conf.set(key, old)


def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, output_mode: str = "append",
                   partition_by: list[str] | None = None, state_partitions: int | None = None) -> DataFrame:
    """Run a stream with ``availableNow`` into a parquet sink (checkpointed in the
    shared folder) and return the sink as a batch DataFrame. State partitions
    default to the cluster's parallelism."""
    out = scratch_dir(spark, f"{name}-out")
    ck = scratch_dir(spark, f"{name}-ckpt")
    w = stream.writeStream.format("parquet").option("checkpointLocation", ck).outputMode(output_mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    parts = state_partitions or default_parallelism(spark)
    q = start_with_state_partitions(w.trigger(availableNow=True), out, spark, parts)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out)


def write_stream_input(df: DataFrame, spark: SparkSession, name: str, fmt: str = "parquet") -> str:
    """Materialise a batch frame as files a file-stream source can read."""
    path = scratch_dir(spark, f"{name}-in")
    if fmt == "text":
        df.select("value").write.text(path)
    else:
        df.write.parquet(path)
    return path
