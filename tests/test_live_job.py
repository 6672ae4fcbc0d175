"""The live job: micro-batches equal one batch, a repeated batch and a restart change nothing."""
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions import fixed
from flowlens.operators import autoencoder as ae
from flowlens.operators.alerts import assemble_alert, decide_events
from flowlens.operators.flows import check_feature_contract
from flowlens.streaming import live

MODEL = ae.demo_model(fixed.COMPACT_FEATURES, [(f, 1.0, 2.0) for f in fixed.COMPACT_FEATURES])


def request(i, **features):
    full = {n: float((i * 7 + k) % 13) for k, n in enumerate(fixed.COMPACT_FEATURES)} | features
    return json.dumps({"flow_id": str(i), "ts_unix": 1000.0 + i * 4, "src_ip": "192.168.1.5", "src_port": 5000,
                       "dest_ip": "8.8.8.8" if i % 3 else "1.1.1.1", "dest_port": 4444, "proto": "TCP", "app_proto": "",
                       "direction": "", "features": {k: v for k, v in full.items() if v is not None}})


def eve(i):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{i:02d}.5Z", "event_type": "flow", "src_ip": "192.168.1.5",
                       "src_port": 5000, "dest_ip": "8.8.8.8", "dest_port": 443, "proto": 6, "app_proto": "tls",
                       "flow": {"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:02Z", "age": 2,
                                "pkts_toserver": 3, "pkts_toclient": 4, "bytes_toserver": 500, "bytes_toclient": 600}})


LINES = [request(i) for i in range(24)] + [request(30, proto=None), request(31, duration=None, proto=None), "", "{broken",
                                            '{"event_type": "dns"}', eve(3), eve(4)]


def one_batch(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    accepted, _ = check_feature_contract(live.requests_from_lines(df))
    return assemble_alert(decide_events(live.scored_requests(accepted, MODEL)))


def flat(df):
    return sorted(map(str, df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).collect()))


def put(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def run(spark, path, out, ck):
    job = live.LiveJob(spark, MODEL, out)
    q = job.start(spark.readStream.option("maxFilesPerTrigger", 1).text(path), ck, availableNow=True)
    q.awaitTermination()
    assert q.exception() is None
    return job


def test_micro_batches_and_restart_equal_one_batch(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (LINES[:9], LINES[9:16]):
        put(spark, path, part)
    run(spark, path, out, ck)
    put(spark, path, LINES[16:])
    job = run(spark, path, out, ck)  # a new job over the same folders goes on
    assert flat(job.records()) == flat(one_batch(spark, LINES))
    assert sorted(r["error"] for r in job.rejected().collect()) == [
        "missing_features=1 ex=['proto']", "missing_features=2 ex=['duration', 'proto']"]
    assert {r["status"]: r["count"] for r in job.requests().groupBy("status").count().collect()} == {"ok": 26, "error": 2}
    log = [json.loads(r.value) for r in spark.read.text(f"{out}/log").where("value != ''").select("value").collect()]
    assert len(log) == 26 and all(len(x["top_features"]) == 5 for x in log)
    assert max(r["repeat_previous_count"] for r in job.records().collect()) > 3


def test_a_batch_run_again_gives_the_same_files(spark, tmp_path):
    job = live.LiveJob(spark, MODEL, str(tmp_path / "out"))
    parts = [spark.createDataFrame([(x,) for x in LINES[k:k + 12]], "value string") for k in (0, 12)]
    job(parts[0], 0)
    job(parts[1], 1)
    once, state = flat(job.records()), flat(spark.read.parquet(job._at("state", 1)))
    job(parts[1], 1)
    assert flat(job.records()) == once and flat(spark.read.parquet(job._at("state", 1))) == state


def test_empty_batch(spark, tmp_path):
    job = live.LiveJob(spark, MODEL, str(tmp_path / "out"))
    job(spark.createDataFrame([], "value string"), 0)
    job(spark.createDataFrame([("no json",)], "value string"), 1)
    assert job.records().count() == 0 and job.rejected().count() == 0


def test_record_sections(spark):
    rec = one_batch(spark, LINES)
    info = rec.schema["debug"].dataType["repeat_info"].dataType.names
    assert info == ["repeat_key", "repeat_window_s", "previous_count", "current_count", "repeat_level", "suspicion_boost",
                    "is_repeated"]
    row = rec.where("flow_id = '5'").first()
    assert [t["name"] for t in row["top_features"]] == [t["name"] for t in row["top_features_raw"]]
    errs = [t["err"] for t in row["top_features"]]
    assert errs == sorted(errs, reverse=True) and len(errs) == 5
    for t in row["top_features"]:
        assert t["err"] == pytest.approx((t["x"] - t["x_hat"]) ** 2)


def test_each_line_is_parsed_once(spark, tmp_path):
    """The lines are read once for the events and once for the requests, not again for what is rejected."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(value):
        seen.add(1)
        return value

    lines = spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1)
    lines.write.parquet(str(tmp_path / "lines"))
    job = live.LiveJob(spark, MODEL, str(tmp_path / "out"))
    job(spark.read.parquet(str(tmp_path / "lines")).select(told.asNondeterministic()("value").alias("value")), 0)
    assert 0 < seen.value <= 2 * len(LINES)
    assert job.records().count() == 26 and job.rejected().count() == 2


def test_the_log_is_compressed_and_whole(spark, tmp_path):
    """One JSON object per record, as gzip files: its sentences repeat, plain text is ten times as large."""
    job = live.LiveJob(spark, MODEL, str(tmp_path / "out"))
    job(spark.createDataFrame([(request(i),) for i in range(300)], "value string").coalesce(1), 0)
    log = list((tmp_path / "out" / "log").glob("*/part-*"))
    assert log and all(f.name.endswith(".json.gz") for f in log)
    lines = [x for f in log for x in gzip.open(f, "rt").read().splitlines()]
    assert sorted(json.loads(x)["flow_id"] for x in lines) == sorted(r.flow_id for r in job.records().collect())
    assert len(lines) == 300
    assert sum(f.stat().st_size for f in log) < sum(map(len, lines)) / 4
    for name in ("requests", "records"):
        assert all(".zstd." in f.name for f in (tmp_path / "out" / name).glob("*/part-*"))


def test_a_batch_leaves_no_copy_of_its_records(spark, tmp_path):
    """The scored requests and the counted rows go once the records are written; E16 counts the records."""
    def counted():
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return {n for n in os.listdir(folder) if n.startswith("flowlens-repetition-")}

    before = counted()
    job = live.LiveJob(spark, MODEL, str(tmp_path / "out"))
    job(spark.createDataFrame([(x,) for x in LINES], "value string"), 0)
    assert counted() <= before
    assert not list((tmp_path / "out").glob("scored/*/*.parquet"))
    assert {r["status"]: r["count"] for r in job.requests().groupBy("status").count().collect()} == {"ok": 26, "error": 2}


def test_the_live_querys_lines_are_compressed(spark, monkeypatch):
    """The input that the registered queries make: gzip text, as many files a micro-batch as cores, every line there."""
    from flowlens.plans import fixtures, q_streaming

    sf, made, counts, write = "/root/testdata/sf0.001", [], [], q_streaming._in_time_order

    class Job:
        def __init__(self, *a):
            pass

        def start(self, stream, checkpoint, **trigger):
            w = stream.writeStream.foreachBatch(lambda df, k: counts.append(df.count()))
            return w.option("checkpointLocation", checkpoint).trigger(**trigger).start()

    monkeypatch.setattr(q_streaming, "_in_time_order", lambda *a: made.append(write(*a)) or made[0])
    monkeypatch.setattr(q_streaming.live, "LiveJob", Job)
    q_streaming._live_job(spark, sf)
    path, files = made[0]
    parts = [n for n in os.listdir(path.removeprefix("file:")) if n.startswith("part-")]
    assert all(n.endswith(".txt.gz") for n in parts) and len(parts) == 4 * files
    assert len(counts) == 4 and sum(counts) == fixtures.live_lines(spark, sf).count()
