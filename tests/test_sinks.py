"""A06 / A07 / A10 writers and the configurable stream source."""
import json
import os

from flowlens.sources import sinks
from flowlens.sources.eve import stream_eve_flows_from


def test_csv_sink_fixed_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5)], "x int, y string, z double")
    sinks.write_csv(df, str(tmp_path / "o"), columns=["z", "x", "y"])
    part = [f for f in os.listdir(tmp_path / "o") if f.startswith("part-")][0]
    head = open(tmp_path / "o" / part).read().splitlines()[0]
    assert head == "z,x,y"


def test_prediction_log_append_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, 1704067200.5, "OK"), (2, 1704153600.0, "REVIEW")],
                               "flow_id long, ts_unix double, final_label string")
    path = str(tmp_path / "log")
    sinks.append_prediction_log(df, path)
    sinks.append_prediction_log(df, path)
    back = spark.read.json(path)
    assert back.count() == 4
    assert sorted(r["log_date"].isoformat() for r in back.select("log_date").distinct().collect()) == \
        ["2024-01-01", "2024-01-02"]


def test_metrics_export_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(0.37, 83, 2)], "threshold double, tp long, fp long")
    sinks.write_metrics(df, str(tmp_path / "m"))
    part = [f for f in os.listdir(tmp_path / "m") if f.startswith("part-")][0]
    assert json.loads(open(tmp_path / "m" / part).read().splitlines()[0]) == {"threshold": 0.37, "tp": 83, "fp": 2}
    line = sinks.json_lines(df).collect()[0]["value"]
    assert json.loads(line)["tp"] == 83


def test_stream_source_by_configuration(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"event_type":"flow","flow_id":1,"proto":"TCP"}\n{"event_type":"dns"}\n')
    stream = stream_eve_flows_from(spark, "text", {"maxFilesPerTrigger": "1"}, str(src))
    q = (stream.select("flow_id", "proto").writeStream.format("memory").queryName("eve_cfg")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM eve_cfg").collect()
    assert [(r["flow_id"], r["proto"]) for r in rows] == [("1", "TCP")]
