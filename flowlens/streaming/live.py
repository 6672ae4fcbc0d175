"""The live job: lines in, alert records and rejected requests out.

One chain from the line to the record: EVE flow events become scoring requests (B14),
requests that come as such are taken as they are; the feature contract (D05) parts
accepted from rejected; accepted ones are scored once with detail (M04, F05), get
context, the repetition count (F02), decision, text and the record (G13). The
operators are those of the batch jobs; the job runs them on every micro-batch.

State: the repetition deques of the keys (50 times at most per key) are a table with one
version per micro-batch. A micro-batch reads the version before its own and
overwrites its own outputs, so a batch that is run again after a failure gives the
same files, and a restarted query goes on where the checkpoint says. The count is
the range-partitioned look-back, so a hot key is cut within a micro-batch.

Disk: the log holds some 3 KB of text per event, most of it the same sentences, so it is
gzip files of one JSON object a line; the tables are zstd parquet. The scored requests and the
counted rows of a micro-batch go once its records, which hold all their columns, are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.context import enrich_context, raw_event
from ..functions.decision import decide
from ..functions.text import attach_explanations
from ..operators import autoencoder as ae
from ..operators import flows as fl
from ..operators.alerts import assemble_alert
from ..operators.repetition import BEFORE_SCHEMA, attach_repetition, carried
from ..session import drop_folders, path_exists
from ..sources.eve import parse_eve_lines

REQUEST_FIELDS = ["flow_id", "ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "direction"]
REQUEST_SCHEMA = T.StructType(
    [T.StructField("flow_id", T.StringType()), T.StructField("ts_unix", T.DoubleType()),
     T.StructField("src_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
     T.StructField("dest_ip", T.StringType()), T.StructField("dest_port", T.IntegerType()),
     T.StructField("proto", T.StringType()), T.StructField("app_proto", T.StringType()),
     T.StructField("direction", T.StringType()),
     T.StructField("features", T.MapType(T.StringType(), T.DoubleType()))])


def requests_from_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Scoring requests of a batch of lines: flow events of EVE logs through the live features,
    and objects with a ``features`` map as they are. Other lines fall out."""
    events = fl.live_flow_features(parse_eve_lines(lines.select(value_col), value_col))
    names = {n: "proto_feature" if n == "proto" else n for n in fixed.COMPACT_FEATURES}
    features = F.create_map(*[x for n, c in names.items() for x in (F.lit(n), F.col(c))])
    made = events.select(*REQUEST_FIELDS, features.alias("features"))
    v = F.col(value_col)
    given = lines.where(v.contains('"features"')).select(
        F.inline(F.array(F.from_json(v, REQUEST_SCHEMA, {"mode": "PERMISSIVE"})))).where("features is not null")
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    given = given.withColumn("ts_unix", F.coalesce("ts_unix", now)).withColumn("flow_id", F.coalesce(
        "flow_id", F.concat(F.lit("ts_"), F.floor(F.col("ts_unix") * 1000).cast("string"))))
    return made.unionByName(given.select(*REQUEST_FIELDS, "features"))


def scored_requests(accepted: DataFrame, model: ae.Model) -> DataFrame:
    """The event columns with ``ae_score``, ``top_features``, ``top_features_raw``."""
    wide = accepted.select(*[c for c in REQUEST_FIELDS if c != "proto"], F.col("proto").alias("_proto"),
                           *[F.col("features")[n].alias(n) for n in model.features])
    wide = ae.score_autoencoder_detail(wide, model, "_ae")
    top = ae.top_feature_errors(F.col("_ae"), model.features, [F.col(n) for n in model.features], 5)
    out = wide.withColumn("_top", top).select(
        *[F.col("_proto").alias("proto") if c == "proto" else c for c in REQUEST_FIELDS],
        F.col("_ae.mse").alias("ae_score"),
        F.transform("_top", lambda t: F.struct(t["name"].alias("name"), t["err"].alias("err"), t["x"].alias("x"),
                                               t["x_hat"].alias("x_hat"))).alias("top_features"),
        F.transform("_top", lambda t: F.struct(t["name"].alias("name"), t["raw"].alias("raw"))).alias("top_features_raw"))
    return out


class LiveJob:
    """``foreachBatch`` handler. Under ``path``: ``requests`` (what the lines held), ``records`` (the
    accepted ones scored and decided, parquet), ``log`` (one JSON object per event, gzip), ``rejected``
    (``flow_id, error``) and ``state``, each by ``batch_id``; during a batch ``scored``, too."""

    def __init__(self, spark: SparkSession, model: ae.Model, path: str, bands: dict | None = None,
                 window_s: int = fixed.REPEAT_WINDOW_S, cap: int = fixed.REPEAT_MAX_EVENTS_PER_KEY,
                 lateness_s: float = 45.0, value_col: str = "value"):
        self.spark, self.model, self.path, self.bands = spark, model, path.rstrip("/"), bands
        self.window_s, self.cap, self.lateness_s, self.value_col = window_s, cap, lateness_s, value_col

    def _at(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch_id={batch_id}"

    def _before(self, batch_id: int) -> DataFrame | None:
        path = self._at("state", batch_id - 1)
        if batch_id and path_exists(self.spark, path):
            return self.spark.read.schema(BEFORE_SCHEMA).parquet(path)
        return None

    def _written(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = self._at(name, batch_id)
        df.write.mode("overwrite").parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        # every line is parsed once, every request scored once; what follows reads the files
        requests = self._written(requests_from_lines(lines, self.value_col), "requests", batch_id)
        accepted, rejected = fl.check_feature_contract(requests, feature_names=tuple(self.model.features))
        rejected.select("flow_id", "ts_unix", "error").write.mode("overwrite").parquet(self._at("rejected", batch_id))
        events = self._written(scored_requests(accepted, self.model), "scored", batch_id)
        keep: list[DataFrame] = []
        rep = attach_repetition(enrich_context(raw_event(events, self.bands)), window_s=self.window_s, cap=self.cap,
                                before=self._before(batch_id), keep=keep)
        record = assemble_alert(attach_explanations(decide(rep)), self.bands)
        done = self._written(record, "records", batch_id)
        newest = keep[0].agg(F.max("_lb_ts")).first()[0]
        horizon = None if newest is None else newest - self.window_s - self.lateness_s
        carried(keep[0], self.cap, horizon).write.mode("overwrite").parquet(self._at("state", batch_id))
        drop_folders(self.spark, keep[0].staged_path, self._at("scored", batch_id))
        done.write.mode("overwrite").json(self._at("log", batch_id), compression="gzip")

    def start(self, lines: DataFrame, checkpoint: str, **trigger):
        """Run on a stream of lines; ``trigger`` as for ``writeStream.trigger``."""
        w = lines.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return w.trigger(**trigger).start() if trigger else w.start()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def records(self) -> DataFrame:
        return self._read("records").drop("batch_id")

    def rejected(self) -> DataFrame:
        return self._read("rejected").drop("batch_id")

    def requests(self) -> DataFrame:
        """``flow_id, status``: every request the job answered (input of E16)."""
        return (self._read("records").select("flow_id", F.lit("ok").alias("status"))
                .unionByName(self._read("rejected").select("flow_id", F.lit("error").alias("status"))))
