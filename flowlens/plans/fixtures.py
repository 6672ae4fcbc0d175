"""Derived input views built from the driver tables (see FIXTURES.md).

The driver tables hold no network flows, so every operator reads ``flows``,
a narrow projection of ``events`` (no shuffle), or views derived from it.
Each view grows linearly with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import scratch_dir

EVENTS_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping, default):
    expr = None
    for k, v in mapping:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


_MEMO: dict = {}


def memo(spark: SparkSession, sf_dir: str, name: str, build):
    """Derived views are immutable plans (or written files): build once per
    session and input folder."""
    key = (id(spark), sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16-column ``flows`` view (FIXTURES.md section 2)."""
    return memo(spark, sf_dir, "flows", lambda: _flows(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(*EVENTS_COLUMNS)
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    ev = ev.withColumn("k", k)
    uid, eid = F.col("user_id"), F.col("event_id")
    k = F.col("k")
    vfloor = F.floor("value").cast("bigint")
    dest_ip = _case(k % 8, [(0, "192.168.1.1"), (1, "8.8.8.8"), (2, "239.255.255.250"),
                            (3, "255.255.255.255"), (4, "2a00:1450::1"), (5, "fe80::1"),
                            (6, "127.0.0.1")], "1.1.1.1")
    dest_port = _case((k + uid) % 12, [(0, 53), (1, 443), (2, 80), (3, 123), (4, 22), (5, 1900),
                                       (6, 4444), (7, 3478), (8, 554), (9, 8443), (10, 31337)], 700)
    app = _case(F.col("event_type"), [("click", "tls"), ("view", "http"), ("purchase", "quic"),
                                      ("error", "failed")], "")
    return ev.select(
        eid.alias("flow_id"),
        (F.lit(1704067200.0) + eid * F.lit(0.5)).cast("double").alias("ts_unix"),
        F.concat(F.when(uid % 7 == 0, F.lit("8.8.4.")).otherwise(F.lit("192.168.1.")),
                 (F.lit(10) + uid % 4).cast("string")).alias("src_ip"),
        (F.lit(1024) + (uid * 37) % 60000).cast("int").alias("src_port"),
        dest_ip.alias("dest_ip"),
        dest_port.cast("int").alias("dest_port"),
        F.when(k % 10 < 6, "TCP").when(k % 10 < 9, "UDP").otherwise("ICMP").alias("proto"),
        app.alias("app_proto"),
        F.when(eid % 5 == 0, "lateral").when(eid % 5 == 1, "egress").otherwise("unknown").alias("direction"),
        (F.lit(1) + vfloor % 50).cast("bigint").alias("pkts_fwd"),
        (eid % 40).cast("bigint").alias("pkts_rev"),
        ((F.lit(1) + vfloor % 50) * (F.lit(60) + k)).cast("bigint").alias("bytes_fwd"),
        ((eid % 40) * (F.lit(40) + uid % 100)).cast("bigint").alias("bytes_rev"),
        ((eid % 400) * F.lit(0.25)).cast("double").alias("duration"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        (F.col("value") / F.lit(15.0)).cast("double").alias("ae_score"),
    )


def _iso(ts_col):
    return F.date_format(F.timestamp_seconds(ts_col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def eve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eve_lines(value)``: EVE JSON lines of ``flows``; every 10th line another
    event_type, every 50th line damaged, timestamp suffixes varied (Z / +0000 / +00:00),
    numeric proto on every 3rd line, missing flow_id on every 13th, age 0 on every 4th."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    suffix = F.when(fid % 3 == 0, F.lit("+0000")).when(fid % 3 == 1, F.lit("Z")).otherwise(F.lit("+00:00"))
    start = F.concat(_iso(F.col("ts_unix")), suffix)
    end = F.concat(_iso(F.col("ts_unix") + F.col("duration")), suffix)
    proto = F.when(fid % 3 == 0, F.when(F.col("proto") == "TCP", F.lit("6"))
                   .when(F.col("proto") == "UDP", F.lit("17")).otherwise(F.lit("1")))
    obj = F.struct(
        F.concat(_iso(F.col("ts_unix")), suffix).alias("timestamp"),
        F.when(fid % 10 == 7, F.lit("alert")).otherwise(F.lit("flow")).alias("event_type"),
        F.when(fid % 13 != 0, fid).alias("flow_id"),
        F.concat(F.lit("1:"), fid.cast("string")).alias("community_id"),
        F.col("src_ip"), F.col("src_port"), F.col("dest_ip"), F.col("dest_port"),
        F.col("proto").alias("proto_text"),
        F.col("app_proto"),
        F.struct(start.alias("start"), end.alias("end"),
                 F.when(fid % 4 == 0, F.lit(0.0)).otherwise(F.col("duration")).alias("age"),
                 F.lit("closed").alias("state"), F.lit("timeout").alias("reason"),
                 F.col("pkts_fwd").alias("pkts_toserver"), F.col("pkts_rev").alias("pkts_toclient"),
                 F.col("bytes_fwd").alias("bytes_toserver"), F.col("bytes_rev").alias("bytes_toclient"),
                 ).alias("flow"),
    )
    js = F.to_json(obj)
    # numeric protocol numbers are written as JSON numbers, names as strings
    js = F.when(proto.isNotNull(),
                F.regexp_replace(js, r'"proto_text":"[A-Z]+"', F.concat(F.lit('"proto":'), proto)))\
        .otherwise(F.regexp_replace(js, r'"proto_text"', F.lit('"proto"')))
    js = F.when(fid % 50 == 0, F.substring(js, 1, 20)).otherwise(js)
    return f.select(fid.alias("line_no"), js.alias("value"))


def eve_token_files(spark: SparkSession, sf_dir: str) -> str:
    """EVE files on disk whose counters are written as ``n``, ``n.0``, ``n.7`` and ``"n.7"`` in turn, whose
    protocol is a number on every third line, with another protocol in a nested object and, on
    every sixth line, a byte that is no UTF-8 inside ``app_proto``. Returns their folder."""
    def build():
        fid = F.col("flow_id")
        count = _case(fid % 4, [(0, ""), (1, ".0"), (2, ".7")], ".7")
        n = F.concat(F.col("pkts_fwd").cast("string"), count)
        n = F.when(fid % 4 == 3, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)
        proto = F.when(fid % 3 == 0, F.lit("17")).when(fid % 3 == 1, F.lit('"6"')).otherwise(F.lit('"TCP"'))
        head = F.concat(F.lit('{"event_type":"flow","tunnel":{"proto":1,"age":5},"flow_id":'), fid.cast("string"),
                        F.lit(',"proto":'), proto, F.lit(',"app_proto":"t'))
        tail = F.concat(F.lit('ls","flow":{"pkts_toserver":'), n, F.lit(',"age":'),
                        F.when(fid % 2 == 0, F.lit("1.5")).otherwise(F.lit('"1.5"')), F.lit("}}"))
        stray = F.when(fid % 6 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
        line = F.concat(head.cast("binary"), stray, tail.cast("binary")).cast("string")
        path = scratch_dir(spark, "eve-tokens")
        flows(spark, sf_dir).select(line.alias("value")).write.text(path)
        return path
    return memo(spark, sf_dir, "eve-tokens", build)


def zeek_segment_files(spark: SparkSession, sf_dir: str) -> str:
    """Conn logs with two headers in one file (four files): two rows before the first header, then
    ``uid, id.resp_p, duration`` in this order for the first half of the flows, then
    ``duration, uid, service`` (no types line) for the second half. Returns their folder."""
    def build():
        f = flows(spark, sf_dir)
        half = F.col("flow_id") >= (f.agg(F.max("flow_id")).first()[0] or 0) // 2
        uid = F.concat(F.lit("C"), F.col("flow_id").cast("string"))
        dur = F.format_string("%.6f", "duration")
        one = F.concat_ws("\t", uid, F.col("dest_port").cast("string"), dur)
        two = F.concat_ws("\t", dur, uid, F.when(F.col("app_proto") == "", F.lit("-")).otherwise(F.col("app_proto")))
        body = f.select((F.col("flow_id") % 4).alias("file"), F.when(half, 6).otherwise(3).alias("part"), "flow_id",
                        F.when(half, two).otherwise(one).alias("value"))
        marks = [(0, "C0\t1\t1.0"), (0, "#separator \\x09"), (1, "#fields\tuid\tid.resp_p\tduration"),
                 (2, "#types\tstring\tport\tinterval"), (4, "#close"), (5, "#fields\tduration\tuid\tservice")]
        lines = spark.createDataFrame([(f"{k}", p, 0, t) for k in range(4) for p, t in marks],
                                      "file string, part int, flow_id long, value string")
        every = lines.unionByName(body.withColumn("file", F.col("file").cast("string")))
        path = scratch_dir(spark, "zeek-segments")
        (every.repartition("file").sortWithinPartitions("file", "part", "flow_id").select("file", "value")
         .write.partitionBy("file").text(path))
        return path
    return memo(spark, sf_dir, "zeek-segments", build)


def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input of the live job: ``eve_lines`` and, for the flows whose EVE line is another event
    (``flow_id % 10 = 7``), a scoring request; every other of these lacks two features."""
    from ..operators.flows import compact_from_flows

    some = flows(spark, sf_dir).where("flow_id % 10 = 7")
    made = compact_from_flows(some)
    full = F.create_map(*[x for n in fixed.COMPACT_FEATURES for x in (F.lit(n), F.col(n))])
    part = F.map_filter(full, lambda k, v: ~k.isin("byte_rate", "proto"))
    feats = made.select(F.col("flow_id").alias("line_no"), F.when(F.col("flow_id") % 20 == 7, part).otherwise(full).alias("features"))
    meta = ["ts_unix", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "direction"]
    requests = some.withColumnRenamed("flow_id", "line_no").select("line_no", *meta).join(feats, "line_no")
    body = F.to_json(F.struct(F.col("line_no").cast("string").alias("flow_id"), *meta, "features"))
    return eve_lines(spark, sf_dir).unionByName(requests.select("line_no", body.alias("value")))


def zeek_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``zeek_conn``: flows renamed to the conn.log columns (FIXTURES.md 1.1, section 3)."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    states = ["S0", "REJ", "RSTO", "SF", "S1", "OTH", "RSTR"]
    hists = ["ShADadFf", "Dd", "S", "ShR", "-"]
    return f.select(
        F.col("ts_unix").alias("ts"),
        F.concat(F.lit("C"), fid.cast("string")).alias("uid"),
        F.col("src_ip").alias("id.orig_h"), F.col("src_port").alias("id.orig_p"),
        F.col("dest_ip").alias("id.resp_h"), F.col("dest_port").alias("id.resp_p"),
        F.lower("proto").alias("proto"),
        F.when(fid % 11 == 0, F.lit("-")).when(F.col("app_proto") == "", F.lit("-"))
        .otherwise(F.col("app_proto")).alias("service"),
        F.col("duration"),
        F.col("bytes_fwd").alias("orig_bytes"), F.col("bytes_rev").alias("resp_bytes"),
        _case(fid % 7, list(enumerate(states)), "OTH").alias("conn_state"),
        F.lit(True).alias("local_orig"), F.lit(False).alias("local_resp"),
        F.lit(0).cast("bigint").alias("missed_bytes"),
        _case(fid % 5, list(enumerate(hists)), "-").alias("history"),
        F.col("pkts_fwd").alias("orig_pkts"),
        (F.col("bytes_fwd") + F.col("pkts_fwd") * 20).alias("orig_ip_bytes"),
        F.col("pkts_rev").alias("resp_pkts"),
        (F.col("bytes_rev") + F.col("pkts_rev") * 20).alias("resp_ip_bytes"),
        F.lit("(empty)").alias("tunnel_parents"),
        F.when(F.col("proto") == "TCP", 6).when(F.col("proto") == "UDP", 17).otherwise(1).alias("ip_proto"),
    )


def _label_text():
    fid = F.col("flow_id")
    return (F.when(fid % 97 == 0, F.lit(None).cast("string"))
            .when(F.col("label") == 1, F.when(fid % 2 == 0, F.lit("DoS")).otherwise(F.lit("1")))
            .when(fid % 5 == 0, F.lit(" normal ")).when(fid % 5 == 1, F.lit("Legitimate"))
            .when(fid % 5 == 2, F.lit("Non-Attack")).when(fid % 5 == 3, F.lit("0"))
            .otherwise(F.lit("BENIGN")))


def cic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIC-style labelled rows (duration in microseconds, text columns)."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    return f.select(
        fid.alias("flow_id"),
        F.when(fid % 31 == 0, F.lit("n/a")).otherwise((F.col("duration") * 1e6).cast("bigint").cast("string"))
        .alias("Flow Duration"),
        F.col("pkts_fwd").cast("string").alias("Total Fwd Packets"),
        F.col("pkts_rev").cast("string").alias("Total Backward Packets"),
        F.col("bytes_fwd").cast("string").alias("Total Length of Fwd Packets"),
        F.col("bytes_rev").cast("string").alias("Total Length of Bwd Packets"),
        F.when(fid % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.when(F.col("proto") == "TCP", "6").when(F.col("proto") == "UDP", "17").otherwise("1"))
        .alias("Protocol"),
        _label_text().alias("Label"),
    )


CIC_COLS = ["flow_id", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
            "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol", "Label"]


def labelled_files(spark: SparkSession, sf_dir: str) -> str:
    """``cic_raw`` as header CSV files with ``;`` and a column ``Note`` (``caf\u00e9``): even flows in a UTF-8
    file, odd ones in an ISO-8859-1 file. Returns their folder."""
    def build():
        raw = cic_raw(spark, sf_dir).withColumn("Note", F.lit("caf\u00e9"))
        cols = [*CIC_COLS, "Note"]
        line = F.concat_ws(";", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])
        body = raw.select((F.col("flow_id") % 2).alias("file"), F.lit(1).alias("part"), line.alias("value"))
        head = spark.createDataFrame([(k, 0, ";".join(cols)) for k in (0, 1)], "file long, part int, value string")
        every = head.unionByName(body)
        latin = F.encode("value", "ISO-8859-1").cast("string")
        path = scratch_dir(spark, "labelled")
        (every.withColumn("value", F.when(F.col("file") == 1, latin).otherwise(F.col("value"))).repartition("file")
         .sortWithinPartitions("file", "part").select("file", "value").write.partitionBy("file").text(path))
        return path
    return memo(spark, sf_dir, "labelled-files", build)


def unsw_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNSW-style labelled rows: marker columns as published, other headers
    untrimmed and mixed case (normalised by the mapper)."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    return f.select(
        fid.alias("flow_id"),
        F.col("duration").cast("string").alias("dur"),
        F.col("pkts_fwd").cast("string").alias("spkts"),
        F.col("pkts_rev").cast("string").alias("dpkts"),
        F.col("bytes_fwd").cast("string").alias("sbytes"),
        F.col("bytes_rev").cast("string").alias("dbytes"),
        F.when(fid % 19 == 0, F.lit("gre")).otherwise(F.lower("proto")).alias(" Proto "),
        _label_text().alias("Label "),
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prediction_log``: flows + latency columns and a request status."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    infer = ((fid % 997) / F.lit(10.0)).cast("double")
    return f.withColumns({
        "infer_ms": infer,
        "total_ms": infer + F.lit(0.3),
        "status": F.when(fid % 101 == 0, F.lit("error")).otherwise(F.lit("ok")),
    })


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


__all__ = ["flows", "eve_lines", "zeek_conn", "cic_raw", "unsw_raw", "prediction_log",
           "embeddings", "table", "fixed"]
