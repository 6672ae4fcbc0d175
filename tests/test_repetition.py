"""Batch window and streaming state equal a per-key deque simulation."""
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from flowlens.operators.repetition import BEFORE_SCHEMA, attach_repetition, carried, counted, repeat_key_expr


def deque_sim(events, window=45, cap=50):
    mem = defaultdict(deque)
    out = {}
    for seq, ts, key, anom in sorted(events, key=lambda e: (e[1], e[0])):
        if not anom:
            out[seq] = 0
            continue
        dq = mem[key]
        while dq and ts - dq[0] > window:
            dq.popleft()
        out[seq] = len(dq)
        dq.append(ts)
        while len(dq) > cap:
            dq.popleft()
    return out


def frame(spark, events):
    rows = [(seq, float(ts), "10.0.0.1", key, "TCP", "unknown", 4444, anom) for seq, ts, key, anom in events]
    return spark.createDataFrame(rows, "flow_id long, ts_unix double, src_ip string, dest_ip string, proto string, "
                                       "traffic_class string, dest_port int, is_anom boolean")


def check(spark, events, n_parts=None):
    got = {r["flow_id"]: r["repeat_previous_count"]
           for r in attach_repetition(frame(spark, events), n_parts=n_parts).collect()}
    assert got == deque_sim(events)


def test_edges_ties_cap(spark):
    ev = []
    seq = 0
    for ts in [0, 0, 0, 45, 45.001, 90.002, 200]:                      # ties, exactly 45 s, 45.001 s
        seq += 1
        ev.append((seq, ts, "a", True))
    for i in range(60):                                                  # 60 events in 45 s -> cap 50
        seq += 1
        ev.append((seq, 1000 + i * 0.5, "b", True))
    for ts in [1000.25, 1001.25]:                                        # non-anomalous rows in between
        seq += 1
        ev.append((seq, ts, "b", False))
    seq += 1
    ev.append((seq, 1000.75, "c", True))                                 # another key
    check(spark, ev)


def test_partition_edges(spark):
    # one key over many ranges, some of them shorter than the look-back
    rng = random.Random(1)
    ev = [(i, 880 + i * 3.0, "k", True) for i in range(60)]
    check(spark, ev, n_parts=7)
    check(spark, [(i, 100 + rng.random() * 200, "k" if i % 2 else f"k{i % 5}", i % 7 > 0) for i in range(900)], n_parts=24)
    check(spark, [(i, 100 + i * 0.01, "k", True) for i in range(300)], n_parts=50)


def test_hot_key_is_split(spark):
    """Half of all rows in one key within a minute: no partition has twice the mean."""
    ev = [(i, 1000 + (i % 600) * 0.1, "hot" if i % 2 else f"k{i % 997}", True) for i in range(24_000)]
    rows = frame(spark, ev).withColumn("repetition_key", repeat_key_expr())
    found = counted(rows, "ts_unix", "flow_id", 45, 50, n_parts=16)
    sizes = [r["count"] for r in found.groupBy("_lb_part").count().collect()]
    assert sum(sizes) == len(ev) and len(sizes) > 8 and max(sizes) < 2 * len(ev) / 16
    check(spark, ev[:4000], n_parts=16)


def test_counts_go_on_over_batches(spark):
    """Batch by batch with the carried rows as in one deque, late rows included."""
    rng = random.Random(2)
    batches, mem, want, got = [], {}, {}, {}
    for b in range(5):
        late = 60 if b == 3 else 0
        batches.append([(b * 1000 + i, 100 + b * 40 + rng.random() * 50 - late, f"k{rng.randint(0, 3)}", rng.random() < 0.8)
                        for i in range(120)])
    before = None
    for events in batches:
        for seq, ts, key, anom in sorted(events, key=lambda e: (e[1], e[0])):
            dq = mem.setdefault(key, deque())
            if not anom:
                want[seq] = 0
                continue
            while dq and dq[0] < ts - 45:
                dq.popleft()
            want[seq] = len(dq)
            dq.append(ts)
            if len(dq) > 50:
                dq.popleft()
        keep = []
        out = attach_repetition(frame(spark, events), before=before, n_parts=6, keep=keep)
        got.update((r["flow_id"], r["repeat_previous_count"]) for r in out.collect())
        before = spark.createDataFrame(carried(keep[0], 50).collect(), BEFORE_SCHEMA)
    assert got == want
    assert before.count() == sum(map(len, mem.values()))
    assert carried(keep[0], 50, horizon=1e9).count() == 0


def test_null_times_and_empty_input(spark):
    df = frame(spark, [(1, 5.0, "a", True), (2, 6.0, "a", True)]).unionByName(
        frame(spark, [(3, 0.0, "a", True), (4, 0.0, "a", True)]).withColumn("ts_unix", F.lit(None).cast("double")))
    got = {r["flow_id"]: r["repeat_previous_count"] for r in attach_repetition(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    assert attach_repetition(df.limit(0)).collect() == []


def test_cap_reached_counts(spark):
    ev = [(i, 5.0 + i * 0.1, "k", True) for i in range(80)]
    out = attach_repetition(frame(spark, ev)).orderBy("flow_id").collect()
    assert max(r["repeat_previous_count"] for r in out) == 50
    assert max(r["repeat_count"] for r in out) == 50
    assert out[0]["repeat_level"] == "single" and out[1]["repeat_level"] == "repeated"
    assert out[2]["repeat_level"] == "persistent"


def test_dns_key_port_zero(spark):
    df = frame(spark, [(1, 0.0, "d", True)]).withColumn("traffic_class", F.lit("dns"))
    r = attach_repetition(df).collect()[0]
    assert r["repetition_key"]["dest_port"] == 0


def test_stream_matches_batch_across_microbatches(spark, tmp_path):
    """T02 with one file per micro-batch: state carries across batches."""
    from flowlens.functions.context import enrich_context, raw_event
    from flowlens.streaming.stream import attach_repetition_stream
    cols = "flow_id long, ts_unix double, src_ip string, src_port int, dest_ip string, dest_port int, proto string, " \
           "app_proto string, direction string, ae_score double"
    rows = [(i, 100.0 + i * 7.0, "192.168.1.10", 5000, "8.8.8.8" if i % 3 else "1.1.1.1", 4444, "TCP", "", "",
             9.0 if i % 4 else 1.0) for i in range(40)]
    src = tmp_path / "in"
    for b in range(4):
        spark.createDataFrame(rows[b * 10:(b + 1) * 10], cols).coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    rep = attach_repetition_stream(enrich_context(raw_event(stream)))
    out = tmp_path / "out"
    q = (rep.select("flow_id", "repeat_previous_count").writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out)))
    q.awaitTermination()
    got = {r["flow_id"]: r["repeat_previous_count"] for r in spark.read.parquet(str(out)).collect()}
    batch = attach_repetition(enrich_context(raw_event(spark.createDataFrame(rows, cols))))
    exp = {r["flow_id"]: r["repeat_previous_count"] for r in batch.collect()}
    assert got == exp


def test_stream_late_replay_keeps_rows(spark, tmp_path):
    """A replay behind the watermark is counted in arrival order and does not fail
    the state timeout (clamped to the watermark)."""
    from flowlens.functions.context import enrich_context, raw_event
    from flowlens.streaming.stream import attach_repetition_stream
    cols = "flow_id long, ts_unix double, src_ip string, src_port int, dest_ip string, dest_port int, proto string, " \
           "app_proto string, direction string, ae_score double"
    rows = [(i, 1000.0 + i * 30.0, "192.168.1.10", 5000, "8.8.8.8", 4444, "TCP", "", "", 9.0) for i in range(20)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(src))
    spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1) \
        .parquet(str(src))
    rep = attach_repetition_stream(enrich_context(raw_event(stream)))
    q = (rep.select("flow_id", "repeat_previous_count").writeStream.format("parquet")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
