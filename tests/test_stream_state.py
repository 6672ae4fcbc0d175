"""The keyed state of T02: rows stay in the frames they came in, and only what is asked for goes through Python."""
import numpy as np
import pandas as pd

from flowlens.streaming.stream import repetition_state_fn


class State:
    exists, hasTimedOut = False, False

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        self.at = at

    def getCurrentWatermarkMs(self):
        return 0


def test_rows_are_not_copied_into_one_frame():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"flow_id": np.arange(300), "ts_unix": rng.integers(0, 200, 300) / 2.0, "text": ["x" * 50] * 300})
    frames = [rows[:100], rows[100:110], rows[110:110], rows[110:]]
    state = State()
    out = list(repetition_state_fn(45, 50)(("k",), iter(frames), state))
    assert [len(p) for p in out] == [100, 10, 190]  # no frame as long as the key
    got = pd.concat(out).sort_values(["ts_unix", "flow_id"])
    ts = got["ts_unix"].to_numpy()
    deque, want = [], []
    for t in ts:
        while deque and t - deque[0] > 45:
            deque.pop(0)
        want.append(len(deque))
        deque = [*deque, t][-50:]
    assert got["repeat_previous_count"].tolist() == want
    assert state.value == (deque,)


def test_only_the_wanted_columns_go_through_the_state(spark, tmp_path):
    from pyspark.sql import functions as F

    from flowlens.streaming.stream import attach_repetition_stream

    df = spark.range(3).select(
        F.col("id").alias("flow_id"), F.lit(1.0).alias("ts_unix"), F.lit(True).alias("is_anom"), F.lit("a").alias("src_ip"),
        F.lit("b").alias("dest_ip"), F.lit("TCP").alias("proto"), F.lit("web").alias("traffic_class"), F.lit(1).alias("dest_port"),
        F.lit("long").alias("summary"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert "summary" in attach_repetition_stream(stream).columns
    assert "summary" not in attach_repetition_stream(stream, columns=["flow_id"]).columns
