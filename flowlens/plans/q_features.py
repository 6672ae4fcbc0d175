"""Registered queries: the wide feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import flows as fl
from ..operators import matrix as mx
from . import fixtures
from .oracle_sql import FLOWS, scope_sql, v4num, with_layers
from .q_sources import B05_SQL, EVE_SRC, ZEEK_SRC, _eve_parsed, _zeek_parsed
from .registry import register, sql_round, stable_round


# log2 / sin / cos may differ in the last bit between the JVM and DuckDB:
# the registered queries report them rounded to 9 decimals on both sides.
TRANSCENDENTAL = ["dir_entropy", "time_of_day_sin", "time_of_day_cos"]


def _stable(m):
    return m.withColumns({c: stable_round(c, 9) for c in TRANSCENDENTAL})


def _zeek_rows(spark, sf):
    return fl.zeek_to_flow_rows(_zeek_parsed(spark, sf))


def _matrix_sql(rows_sql: str, key: str, src_ip: str, dst_ip: str, sport: str, dport: str, proto: str,
                start_epoch: str | None, dur: str, sp: str, cp: str, sb: str, cb: str,
                flags_sql: dict, handshake: str = "0") -> str:
    s_scope = scope_sql(f"({v4num(src_ip)})", src_ip)
    d_scope = scope_sql(f"({v4num(dst_ip)})", dst_ip)
    int_src = f"CAST(({s_scope['private']} OR {s_scope['loopback']} OR {s_scope['link_local']}) AS INTEGER)"
    int_dst = f"CAST(({d_scope['private']} OR {d_scope['loopback']} OR {d_scope['link_local']}) AS INTEGER)"
    if start_epoch:
        ts = f"make_timestamp(CAST(floor({start_epoch} * 1000000) AS BIGINT))"
        sec = f"(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"
        sin = f"sin(2 * pi() * ({sec} / 86400.0))"
        cos = f"cos(2 * pi() * ({sec} / 86400.0))"
    else:
        sin = cos = "0.0"
    flags = ", ".join(f"{flags_sql[n]} AS tcp_flag_{n}" for n, _ in fixed.TCP_FLAG_BITS)
    onehots = ", ".join(f"CAST(_dport = {p} AS INTEGER) AS dstp_{p}" for p in fixed.MATRIX_DST_PORTS)
    ports = ", ".join(str(p) for p in fixed.MATRIX_DST_PORTS)
    base = f"""m0 AS (
SELECT {key} AS _key, upper(CAST({proto} AS VARCHAR)) AS _proto, CAST({sport} AS INTEGER) AS _sport,
  CAST({dport} AS INTEGER) AS _dport,
  greatest(coalesce(CAST({dur} AS DOUBLE), 0.0), 0.0) AS duration_s,
  greatest(coalesce(CAST({sp} AS DOUBLE), 0.0), 0.0) AS pkts_toserver,
  greatest(coalesce(CAST({cp} AS DOUBLE), 0.0), 0.0) AS pkts_toclient,
  greatest(coalesce(CAST({sb} AS DOUBLE), 0.0), 0.0) AS bytes_toserver,
  greatest(coalesce(CAST({cb} AS DOUBLE), 0.0), 0.0) AS bytes_toclient,
  {int_src} AS is_internal_src, {int_dst} AS is_internal_dst,
  {sin} AS time_of_day_sin, {cos} AS time_of_day_cos, {flags}, {handshake} AS tcp_handshake_ok
FROM rows30),
m1 AS (
SELECT *, pkts_toserver + pkts_toclient AS pkts_total, bytes_toserver + bytes_toclient AS bytes_total FROM m0),
m2 AS (
SELECT _key, duration_s, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, pkts_total, bytes_total,
  pkts_total / greatest(duration_s, 1e-9) AS pps, 8 * bytes_total / greatest(duration_s, 1e-9) AS bps,
  bytes_total / greatest(pkts_total, 1) AS avg_pkt_size,
  pkts_toserver / greatest(pkts_toclient, 1) AS pkts_dir_ratio,
  bytes_toserver / greatest(bytes_toclient, 1) AS bytes_dir_ratio,
  (bytes_toserver - bytes_toclient) / greatest(bytes_total, 1) AS syn_asymmetry,
  (pkts_toserver - pkts_toclient) / greatest(pkts_total, 1) AS pkts_asymmetry,
  CASE WHEN bytes_toserver / greatest(bytes_total, 1) > 0 THEN -(bytes_toserver / greatest(bytes_total, 1)) * (ln(bytes_toserver / greatest(bytes_total, 1)) / ln(2.0)) ELSE 0 END
  + CASE WHEN bytes_toclient / greatest(bytes_total, 1) > 0 THEN -(bytes_toclient / greatest(bytes_total, 1)) * (ln(bytes_toclient / greatest(bytes_total, 1)) / ln(2.0)) ELSE 0 END AS dir_entropy,
  pkts_toserver / greatest(duration_s, 1e-9) AS server_pps, pkts_toclient / greatest(duration_s, 1e-9) AS client_pps,
  8 * bytes_toserver / greatest(duration_s, 1e-9) AS server_bps, 8 * bytes_toclient / greatest(duration_s, 1e-9) AS client_bps,
  bytes_toserver / greatest(pkts_toserver, 1) AS bytes_per_server_pkt,
  bytes_toclient / greatest(pkts_toclient, 1) AS bytes_per_client_pkt,
  CAST(_sport < 1024 AS INTEGER) AS l4_port_class_src, CAST(_dport < 1024 AS INTEGER) AS l4_port_class_dst,
  is_internal_src, is_internal_dst,
  CAST(is_internal_src = 1 AND is_internal_dst = 1 AS INTEGER) AS pat_int_int,
  CAST(is_internal_src = 1 AND is_internal_dst = 0 AS INTEGER) AS pat_int_ext,
  CAST(is_internal_src = 0 AND is_internal_dst = 1 AS INTEGER) AS pat_ext_int,
  CAST(is_internal_src = 0 AND is_internal_dst = 0 AS INTEGER) AS pat_ext_ext,
  time_of_day_sin, time_of_day_cos,
  CAST(_proto = 'TCP' AS INTEGER) AS proto_TCP, CAST(_proto = 'UDP' AS INTEGER) AS proto_UDP,
  CAST(_proto = 'ICMP' AS INTEGER) AS proto_ICMP,
  {", ".join(f"tcp_flag_{n}" for n, _ in fixed.TCP_FLAG_BITS)}, tcp_handshake_ok, {onehots},
  CAST(_dport NOT IN ({ports}) AS INTEGER) AS dstp_other,
  CAST(pkts_total <= 3 OR bytes_total <= 300 AS INTEGER) AS small_flow_flag,
  CAST(duration_s >= 600 AS INTEGER) AS long_flow_flag
FROM m1),
caps AS (
SELECT {", ".join(f"max(CASE WHEN r_{c} = floor(0.999 * (n - 1) + 0.5) THEN {c} END) AS cap_{c}" for c in mx.WINSORISED)}
FROM (SELECT *, count(*) OVER () AS n, {", ".join(f"row_number() OVER (ORDER BY {c}) - 1 AS r_{c}" for c in mx.WINSORISED)} FROM m2) z)"""
    cols = []
    for c in mx.MATRIX_COLUMNS:
        if c in mx.WINSORISED:
            cols.append(f"least(CAST({c} AS DOUBLE), cap_{c}) AS {c}")
        elif c in TRANSCENDENTAL:
            cols.append(f"{sql_round(f'CAST({c} AS DOUBLE)', 9)} AS {c}")
        else:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
    return f"""WITH rows30 AS ({rows_sql}),
{base}
SELECT _key, {", ".join(cols)} FROM m2, caps"""


def _hist_flags(h: str) -> dict:
    h = f"coalesce({h}, '')"
    return {"SYN": f"CAST(contains({h}, 'S') OR contains({h}, 'H') AS INTEGER)",
            "ACK": f"CAST(contains({h}, 'D') OR contains({h}, 'H') AS INTEGER)",
            "FIN": f"CAST(contains({h}, 'F') AS INTEGER)", "RST": f"CAST(contains({h}, 'R') AS INTEGER)",
            "PSH": f"CAST(contains({h}, 'P') AS INTEGER)", "URG": f"CAST(contains({h}, 'U') AS INTEGER)",
            "ECE": "0", "CWR": "0"}


ZEEK_FLAGS = _hist_flags("zeek_history")
NO_FLAGS = {n: "0" for n, _ in fixed.TCP_FLAG_BITS}

ZEEK_MATRIX_SQL = _matrix_sql(B05_SQL, "zeek_uid", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "start_ts",
                              "duration", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
                              ZEEK_FLAGS)

EVE_ROWS_SQL = with_layers([EVE_SRC], """
SELECT '1:' || CAST(flow_id AS VARCHAR) AS community_id, ts_unix, src_ip, src_port, dest_ip, dest_port,
  upper(proto) AS proto, duration, pkts_fwd, pkts_rev, bytes_fwd, bytes_rev FROM eve""")
EVE_MATRIX_SQL = _matrix_sql(EVE_ROWS_SQL, "community_id", "src_ip", "dest_ip", "src_port", "dest_port", "proto",
                             "ts_unix", "duration", "pkts_fwd", "pkts_rev", "bytes_fwd", "bytes_rev", NO_FLAGS)


@register("c_matrix_zeek", ZEEK_MATRIX_SQL)
def c_matrix_zeek(spark, sf):
    """C01-C19 on Zeek 30-column rows (aliases fixed, Zeek source inferred)."""
    m = mx.flow_matrix(_zeek_rows(spark, sf), keep=["zeek_uid"])
    return _stable(m.withColumnRenamed("zeek_uid", "_key"))


@register("c_matrix_eve", EVE_MATRIX_SQL)
def c_matrix_eve(spark, sf):
    """C01-C19 on EVE 30-column rows (time of day from the ISO timestamp)."""
    m = mx.flow_matrix(fl.eve_to_flow_rows(_eve_parsed(spark, sf)), keep=["community_id"])
    return _stable(m.withColumnRenamed("community_id", "_key"))


@register("c01_alias_resolution", with_layers([EVE_SRC], """
SELECT * FROM (
  SELECT 'zeek' AS schema_name, r AS role, c AS column_name, (SELECT count(*) FROM flows) AS n
  FROM (VALUES ('src_ip', 'src_ip'), ('dst_ip', 'dst_ip'), ('start', 'start_ts'), ('history', 'zeek_history'),
               ('duration', 'duration')) t(r, c)
  UNION ALL
  SELECT 'eve', r, c, CASE WHEN c IS NULL THEN 0 ELSE (SELECT count(*) FROM eve) END
  FROM (VALUES ('dst_ip', 'dest_ip'), ('dst_port', 'dest_port'), ('start', 'timestamp'), ('end', NULL),
               ('duration', 'duration')) t(r, c)) x"""))
def c01(spark, sf):
    """Alias resolution (plan time) and the non-null count of each resolved column."""
    z = _zeek_rows(spark, sf)
    e = fl.eve_to_flow_rows(_eve_parsed(spark, sf))
    out = None
    for name, frame, roles in (("zeek", z, ("src_ip", "dst_ip", "start", "history", "duration")),
                               ("eve", e, ("dst_ip", "dst_port", "start", "end", "duration"))):
        picked = {r: mx.pick(frame.columns, r) for r in roles}
        agg = frame.agg(*[(F.count(F.col(f"`{c}`")) if c else F.lit(0).cast("bigint")).alias(r)
                          for r, c in picked.items()])
        part = agg.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("schema_name"), F.lit(r).alias("role"),
                     F.lit(c).cast("string").alias("column_name"), F.col(r).cast("bigint").alias("n"))
            for r, c in picked.items()])).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out


@register("c02_source_inference", with_layers([EVE_SRC], """
SELECT * FROM (
  SELECT 'zeek_rows' AS frame, 'zeek' AS source, (SELECT count(*) FROM flows) AS n
  UNION ALL SELECT 'zeek_rows_reference_lists', 'suricata', (SELECT count(*) FROM flows)
  UNION ALL SELECT 'eve_rows', 'suricata', (SELECT count(*) FROM eve)
  UNION ALL SELECT 'zeek_conn', 'zeek', (SELECT count(*) FROM flows)) x"""))
def c02(spark, sf):
    """Source inference (plan time) per frame, with the frame's row count."""
    z = _zeek_rows(spark, sf)
    e = fl.eve_to_flow_rows(_eve_parsed(spark, sf))
    c = fixtures.zeek_conn(spark, sf)
    parts = [("zeek_rows", z, mx.infer_source(z.columns)),
             ("zeek_rows_reference_lists", z, mx.infer_source(z.columns, False)),
             ("eve_rows", e, mx.infer_source(e.columns)), ("zeek_conn", c, mx.infer_source(c.columns))]
    out = None
    for name, frame, src in parts:
        part = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("frame"),
                                                              F.lit(src).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("c03_epoch_seconds", with_layers([EVE_SRC], """
SELECT '1:' || CAST(flow_id AS VARCHAR) AS community_id, ts_unix AS start_epoch FROM eve"""))
def c03(spark, sf):
    rows = fl.eve_to_flow_rows(_eve_parsed(spark, sf))
    return rows.select("community_id", mx.to_epoch_seconds("timestamp").alias("start_epoch"))


TCP_FLAGS_TEXT = ("CASE WHEN flow_id % 3 = 0 THEN '0x' || lower(hex(flow_id % 256)) "
                  "WHEN flow_id % 3 = 1 THEN CAST(flow_id % 256 AS VARCHAR) ELSE 'zz' END")


@register("c13_tcp_flags_int", with_layers([FLOWS], f"""
SELECT flow_id, {", ".join(f"CAST((CASE WHEN flow_id % 3 = 2 THEN 0 ELSE flow_id % 256 END) & {bit} <> 0 AS INTEGER) AS tcp_flag_{name}" for name, bit in fixed.TCP_FLAG_BITS)}
FROM flows"""))
def c13(spark, sf):
    f = fixtures.flows(spark, sf)
    fid = F.col("flow_id")
    txt = (F.when(fid % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex(fid % 256))))
           .when(fid % 3 == 1, (fid % 256).cast("string")).otherwise(F.lit("zz")))
    return f.select("flow_id", *mx.tcp_flags_from_int(txt))


@register("c14_tcp_flags_history", with_layers([FLOWS], f"""
SELECT flow_id, {", ".join(f"{v} AS tcp_flag_{n}" for n, v in _hist_flags("h").items())}
FROM (SELECT flow_id, CASE flow_id % 5 WHEN 0 THEN 'ShADadFf' WHEN 1 THEN 'Dd' WHEN 2 THEN 'S' WHEN 3 THEN 'ShR' ELSE '-' END AS h FROM flows) x"""))
def c14(spark, sf):
    z = fixtures.zeek_conn(spark, sf)
    return z.select(F.col("uid").substr(2, 20).cast("bigint").alias("flow_id"), *mx.tcp_flags_from_history(F.col("history")))


@register("c19_winsorise_caps", with_layers([], f"""
SELECT {", ".join(f"max(CASE WHEN r_{c} = floor(0.999 * (n - 1) + 0.5) THEN {c} END) AS cap_{c}" for c in mx.WINSORISED)}
FROM (SELECT *, count(*) OVER () AS n, {", ".join(f"row_number() OVER (ORDER BY {c}) - 1 AS r_{c}" for c in mx.WINSORISED)}
      FROM ({ZEEK_MATRIX_SQL.replace("SELECT _key, ", "SELECT _key, ", 1)}) q) z"""))
def c19(spark, sf):
    """Exact nearest-rank 0.999 caps of the four rate columns (before clipping)."""
    m = mx.flow_matrix(_zeek_rows(spark, sf), winsorise=False)
    caps = mx.nearest_quantiles_stacked(m, mx.WINSORISED, 0.999)
    return spark.createDataFrame([tuple(float(caps[c]) for c in mx.WINSORISED)],
                                 ", ".join(f"cap_{c} double" for c in mx.WINSORISED))


# ---------------------------------------------------------------------------
# matrix on the raw conn log (Zeek names: id.* aliases, conn_state, history)
# ---------------------------------------------------------------------------
CONN_MATRIX_SQL = _matrix_sql(with_layers([ZEEK_SRC], "SELECT * FROM zeek_conn"), "uid", "orig_h", "resp_h", "orig_p",
                              "resp_p", "proto", "ts", "duration", "orig_pkts", "resp_pkts", "orig_ip_bytes",
                              "resp_ip_bytes", _hist_flags("history"),
                              handshake="CAST(coalesce(conn_state IN ('S1', 'SF'), false) AS INTEGER)")


def _conn_matrix(spark, sf):
    m = mx.flow_matrix(_zeek_parsed(spark, sf).drop("_file"), keep=["uid"])
    return _stable(m.withColumnRenamed("uid", "_key"))


register("c_matrix_conn", CONN_MATRIX_SQL)(_conn_matrix)

C_GROUPS = {
    "c04_duration_counters": ["duration_s", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient"],
    "c05_rates_ratios": ["pkts_total", "bytes_total", "pps", "bps", "avg_pkt_size", "pkts_dir_ratio",
                         "bytes_dir_ratio", "server_pps", "client_pps", "server_bps", "client_bps",
                         "bytes_per_server_pkt", "bytes_per_client_pkt"],
    "c06_asymmetry": ["syn_asymmetry", "pkts_asymmetry"],
    "c07_direction_entropy": ["dir_entropy"],
    "c08_port_class": ["l4_port_class_src", "l4_port_class_dst"],
    "c09_internal_patterns": ["is_internal_src", "is_internal_dst", "pat_int_int", "pat_int_ext", "pat_ext_int",
                              "pat_ext_ext"],
    "c11_time_of_day": ["time_of_day_sin", "time_of_day_cos"],
    "c12_proto_onehot": ["proto_TCP", "proto_UDP", "proto_ICMP"],
    "c15_handshake_ok": ["tcp_handshake_ok"],
    "c16_port_onehots": [f"dstp_{p}" for p in fixed.MATRIX_DST_PORTS] + ["dstp_other"],
    "c17_flow_flags": ["small_flow_flag", "long_flow_flag"],
    "c18_clean_identifiers": ["duration_s", "pps", "bps"],
}


def _group_query(cols):
    def q(spark, sf):
        return _conn_matrix(spark, sf).select("_key", *cols)
    return q


for _name, _cols in C_GROUPS.items():
    register(_name, f"SELECT _key, {', '.join(_cols)} FROM ({CONN_MATRIX_SQL}) q")(_group_query(_cols))
