"""Flow normalisation and row filters.

All operators are narrow projections/filters (no shuffle); they serve batch
jobs and the streaming job alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.context import low
from ..functions.ipscope import with_ip_scope
from ..sources.eve import iso_to_epoch

EVE_ROW_COLUMNS = [
    "timestamp", "flow_id", "community_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto",
    "app_proto", "flow_start", "flow_end", "flow_age", "flow_state", "flow_reason", "pkts_toserver",
    "pkts_toclient", "bytes_toserver", "bytes_toclient", "pkts_total", "bytes_total", "duration", "bps",
    "pps", "bytes_ratio_ts_over_tc", "pkts_ratio_ts_over_tc", "avg_bytes_per_pkt_ts",
    "avg_bytes_per_pkt_tc", "is_tcp", "is_udp", "is_icmp"]

ZEEK_ROW_COLUMNS = [
    "start_ts", "end_ts", "duration", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "app_proto",
    "state", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "pkts_total",
    "bytes_total", "bpp_toserver", "bpp_toclient", "pps_toserver", "pps_toclient", "byte_ratio_ts_tc",
    "pkt_ratio_ts_tc", "src2dst_rate", "dst2src_rate", "is_tcp", "is_udp", "is_icmp", "is_ipv6",
    "zeek_uid", "zeek_history"]

COMPACT_COLUMNS = fixed.COMPACT_FEATURES + ["label"]


def _text(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _eve_int(ev: DataFrame, name: str) -> Column:
    """An integer of an EVE field: whole text or number, a JSON number with a fraction cut off; else 0."""
    whole = F.col(name).cast("string").try_cast("bigint")
    if "numbers" not in ev.columns:
        return F.coalesce(whole, F.lit(0))
    return F.coalesce(whole, F.col(f"numbers.{name}").try_cast("bigint"), F.lit(0))


def _eve_port(ev: DataFrame, name: str) -> Column:
    return F.coalesce(_eve_int(ev, name).try_cast("int"), F.lit(0))


def _float_or(c, default=0.0) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(default))


# ---------------------------------------------------------------------------
# B02 / B03 / B04 helpers
# ---------------------------------------------------------------------------
def proto_name(proto_text: Column, is_number: Column) -> Column:
    """JSON integer 6/17/1 -> TCP/UDP/ICMP, other numbers as text; upper-cased."""
    t = F.coalesce(proto_text, F.lit(""))
    named = (F.when(t == "6", "TCP").when(t == "17", "UDP").when(t == "1", "ICMP").otherwise(t))
    return F.upper(F.when(is_number, named).otherwise(t))


def eve_duration(start_text: Column, end_text: Column, age: Column) -> Column:
    """End - start when both parse and the difference is >= 0, else age if
    >= 0, else 0."""
    s, e = iso_to_epoch(start_text), iso_to_epoch(end_text)
    delta = e - s
    return (F.when(s.isNotNull() & e.isNotNull() & (delta >= 0), delta)
            .when(age >= 0, age).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------------------
# B01 EVE flow -> 30-column row
# ---------------------------------------------------------------------------
def eve_to_flow_rows(ev: DataFrame) -> DataFrame:
    """B01 on parsed flow events (``parse_eve_lines``). ``bps`` is bytes/s here. A
    port outside INT counts as 0, like a port that is not a number."""
    f = ev.select(
        _text("timestamp").alias("timestamp"),
        _eve_int(ev, "flow_id").alias("flow_id"),
        _text("community_id").alias("community_id"),
        _text("src_ip").alias("src_ip"),
        _eve_port(ev, "src_port").alias("src_port"),
        _text("dest_ip").alias("dest_ip"),
        _eve_port(ev, "dest_port").alias("dest_port"),
        proto_name(F.col("proto"), F.col("proto_is_number")).alias("proto"),
        _text("app_proto").alias("app_proto"),
        F.coalesce(F.col("flow.start"), F.lit("")).alias("flow_start"),
        F.coalesce(F.col("flow.end"), F.lit("")).alias("flow_end"),
        F.coalesce(F.col("flow.age").try_cast("double"), F.lit(0.0)).alias("_age"),
        F.coalesce(F.col("flow.state"), F.lit("")).alias("flow_state"),
        F.coalesce(F.col("flow.reason"), F.lit("")).alias("flow_reason"),
        _eve_int(ev, "flow.pkts_toserver").alias("pkts_toserver"),
        _eve_int(ev, "flow.pkts_toclient").alias("pkts_toclient"),
        _eve_int(ev, "flow.bytes_toserver").alias("bytes_toserver"),
        _eve_int(ev, "flow.bytes_toclient").alias("bytes_toclient"),
    )
    f = f.withColumns({
        "pkts_total": F.col("pkts_toserver") + F.col("pkts_toclient"),
        "bytes_total": F.col("bytes_toserver") + F.col("bytes_toclient"),
        "_dur": eve_duration(F.col("flow_start"), F.col("flow_end"), F.col("_age")),
    })
    d = F.when(F.col("_dur") > 0, F.col("_dur")).otherwise(F.lit(1e-9))

    def r6(x):
        return F.round(x, 6)

    def nonneg1(c):
        return F.greatest(F.col(c), F.lit(1)).cast("double")

    f = f.withColumns({
        "flow_age": r6(F.col("_age")),
        "duration": F.round(F.col("_dur"), 9),
        "bps": r6(F.col("bytes_total") / d),
        "pps": r6(F.col("pkts_total") / d),
        "bytes_ratio_ts_over_tc": r6(F.col("bytes_toserver") / nonneg1("bytes_toclient")),
        "pkts_ratio_ts_over_tc": r6(F.col("pkts_toserver") / nonneg1("pkts_toclient")),
        "avg_bytes_per_pkt_ts": r6(F.col("bytes_toserver") / nonneg1("pkts_toserver")),
        "avg_bytes_per_pkt_tc": r6(F.col("bytes_toclient") / nonneg1("pkts_toclient")),
        "is_tcp": (F.col("proto") == "TCP").cast("int"),
        "is_udp": (F.col("proto") == "UDP").cast("int"),
        "is_icmp": (F.col("proto") == "ICMP").cast("int"),
    })
    return f.select(*EVE_ROW_COLUMNS)


# ---------------------------------------------------------------------------
# B06-B09 Zeek helpers
# ---------------------------------------------------------------------------
def nz_float(c: Column, default: float = 0.0) -> Column:
    """B06: '-', '' and null -> default; otherwise the number (bad text -> default)."""
    t = c.cast("string")
    v = F.when(t.isNull() | t.isin("-", ""), F.lit(None)).otherwise(t).try_cast("double")
    return F.coalesce(v, F.lit(float(default)))


def nz_int(c: Column, default: int = 0) -> Column:
    """Integer through float truncation; non-finite -> default."""
    v = nz_float(c, float(default))
    ok = ~F.isnan(v) & (F.abs(v) < F.lit(9.2e18))
    return F.when(ok, v.try_cast("bigint")).otherwise(F.lit(default).try_cast("bigint"))


def norm_proto(c: Column) -> Column:
    """Lower; tcp/udp/icmp else other."""
    p = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(p.isin("tcp", "udp", "icmp"), p).otherwise(F.lit("other"))


def conn_state_class(conn_state: Column, history: Column) -> Column:
    """First match wins; the history test is case-sensitive."""
    cs = F.upper(F.coalesce(conn_state.cast("string"), F.lit("")))
    h = F.coalesce(history.cast("string"), F.lit(""))
    return (F.when(cs == "S0", "attempted").when(cs == "REJ", "rejected")
            .when(cs.startswith("RST") | h.contains("R"), "reset")
            .when(h.contains("D"), "established").when(cs == "SF", "closed").otherwise("other"))


def is_ipv6_pair(a: Column, b: Column) -> Column:
    """B09: ':' in either address."""
    return (F.coalesce(a.contains(":"), F.lit(False)) | F.coalesce(b.contains(":"), F.lit(False))).try_cast("int")


def zeek_to_flow_rows(conn: DataFrame) -> DataFrame:
    """B05 on a parsed conn log (typed or text columns). Denominators: 1 for
    zero packets/bytes, 1e-9 for zero duration."""
    def col(name, default="-"):
        return F.col(f"`{name}`") if name in conn.columns else F.lit(default)

    def raw_text(name, default):
        if name not in conn.columns:
            return F.lit(default)
        c = F.col(f"`{name}`").cast("string")
        return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)

    x = conn.select(
        nz_float(col("ts", "0")).alias("ts"),
        nz_float(col("duration", "0")).alias("dur"),
        raw_text("uid", "-").alias("zeek_uid"),
        F.coalesce(col("id.orig_h", "").cast("string"), F.lit("-")).alias("src_ip"),
        F.coalesce(nz_int(col("id.orig_p", "0")).try_cast("int"), F.lit(0)).alias("src_port"),
        F.coalesce(col("id.resp_h", "").cast("string"), F.lit("-")).alias("dst_ip"),
        F.coalesce(nz_int(col("id.resp_p", "0")).try_cast("int"), F.lit(0)).alias("dst_port"),
        norm_proto(col("proto", "")).alias("proto"),
        raw_text("service", "-").alias("app_proto"),
        raw_text("history", "-").alias("zeek_history"),
        raw_text("conn_state", "-").alias("_cs"),
        nz_float(col("orig_bytes", "0")).alias("_ob"),
        nz_float(col("resp_bytes", "0")).alias("_rb"),
        nz_float(col("orig_pkts", "0")).alias("_opk"),
        nz_float(col("resp_pkts", "0")).alias("_rpk"),
    )
    dd = F.when(F.col("dur") > 0, F.col("dur")).otherwise(F.lit(1e-9))
    dop = F.when(F.col("_opk") > 0, F.col("_opk")).otherwise(F.lit(1.0))
    drp = F.when(F.col("_rpk") > 0, F.col("_rpk")).otherwise(F.lit(1.0))
    drb = F.when(F.col("_rb") > 0, F.col("_rb")).otherwise(F.lit(1.0))
    x = x.select(
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.when(F.col("dur") > 0, F.col("dur")).otherwise(F.lit(0.0))).alias("end_ts"),
        F.col("dur").alias("duration"),
        "src_ip", "src_port", "dst_ip", "dst_port", "proto", "app_proto",
        conn_state_class(F.col("_cs"), F.col("zeek_history")).alias("state"),
        F.col("_opk").try_cast("bigint").alias("pkts_toserver"),
        F.col("_rpk").try_cast("bigint").alias("pkts_toclient"),
        F.col("_ob").try_cast("bigint").alias("bytes_toserver"),
        F.col("_rb").try_cast("bigint").alias("bytes_toclient"),
        (F.col("_opk") + F.col("_rpk")).try_cast("bigint").alias("pkts_total"),
        (F.col("_ob") + F.col("_rb")).try_cast("bigint").alias("bytes_total"),
        (F.col("_ob") / dop).alias("bpp_toserver"),
        (F.col("_rb") / drp).alias("bpp_toclient"),
        (F.col("_opk") / dd).alias("pps_toserver"),
        (F.col("_rpk") / dd).alias("pps_toclient"),
        (F.col("_ob") / drb).alias("byte_ratio_ts_tc"),
        (F.col("_opk") / drp).alias("pkt_ratio_ts_tc"),
        (F.col("_ob") / dd).alias("src2dst_rate"),
        (F.col("_rb") / dd).alias("dst2src_rate"),
        (F.col("proto") == "tcp").try_cast("int").alias("is_tcp"),
        (F.col("proto") == "udp").try_cast("int").alias("is_udp"),
        (F.col("proto") == "icmp").try_cast("int").alias("is_icmp"),
        is_ipv6_pair(F.col("src_ip"), F.col("dst_ip")).alias("is_ipv6"),
        "zeek_uid", "zeek_history",
    )
    return x.select(*ZEEK_ROW_COLUMNS)


# ---------------------------------------------------------------------------
# B10-B13 labelled datasets -> compact schema
# ---------------------------------------------------------------------------
CIC_MARKERS = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets"]
UNSW_MARKERS = ["dur", "spkts", "dpkts", "sbytes", "dbytes"]


def detect_dataset_type(columns) -> str:
    """Plan-time check on the raw (case-sensitive) column names."""
    cols = set(columns)
    if all(c in cols for c in CIC_MARKERS):
        return "CICIDS2017"
    if all(c in cols for c in UNSW_MARKERS):
        return "UNSW_NB15"
    raise ValueError(f"unrecognised dataset columns: {sorted(cols)[:20]}")


def normalize_label(c: Column) -> Column:
    """Null -> 1; trimmed upper text in the benign tokens -> 0; else 1."""
    s = F.upper(F.trim(c.cast("string")))
    return (F.when(c.isNull(), F.lit(1))
            .when(s.isin(*fixed.BENIGN_LABEL_TOKENS), F.lit(0)).otherwise(F.lit(1))).cast("tinyint")


def _num(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _compact(pf, pr, bf, br, duration, rate_duration, proto, label) -> list[Column]:
    safe = F.when(rate_duration != 0, rate_duration)  # 0 -> null, NaN stays NaN
    tot_p, tot_b = pf + pr, bf + br

    def rate(tot):
        v = tot / safe
        return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)

    ratio = pf / F.when(pr != 0, pr)
    ratio = F.when(ratio.isNull() | F.isnan(ratio), pf).otherwise(ratio)
    return [pf.try_cast("bigint").alias("pkts_fwd"), pr.try_cast("bigint").alias("pkts_rev"),
            bf.try_cast("bigint").alias("bytes_fwd"), br.try_cast("bigint").alias("bytes_rev"),
            duration.cast("double").alias("duration"), rate(tot_p).alias("pkt_rate"),
            rate(tot_b).alias("byte_rate"), ratio.cast("double").alias("fwd_rev_ratio"),
            proto.try_cast("int").alias("proto"), label.alias("label")]


def map_cicids2017(df: DataFrame, keep=()) -> DataFrame:
    """Microseconds -> seconds; rates 0 when duration is 0 or unparsable;
    packet ratio falls back to forward packets; missing protocol -> -1;
    duration itself stays NaN when unparsable."""
    c = lambda n: F.col(f"`{n}`")
    dur = _num(c("Flow Duration")) / F.lit(1e6)
    dur = F.coalesce(dur, F.lit(float("nan")))
    z = lambda n: F.coalesce(_num(c(n)), F.lit(0.0))
    proto = F.coalesce(_num(c("Protocol")), F.lit(-1.0)) if "Protocol" in df.columns else F.lit(-1)
    if "Label" not in df.columns:
        raise ValueError("CIC-style data needs a 'Label' column")
    cols = _compact(z("Total Fwd Packets"), z("Total Backward Packets"), z("Total Length of Fwd Packets"),
                    z("Total Length of Bwd Packets"), dur, dur, proto, normalize_label(c("Label")))
    return df.select(*keep, *cols)


def map_unsw_nb15(df: DataFrame, keep=()) -> DataFrame:
    """Names trimmed and lower-cased; numeric proto as-is (null -> -1), text
    proto TCP 6 / UDP 17 / ICMP 1 else 0; no proto column -> -1; label from
    ``label`` or ``class``."""
    renamed = df.toDF(*[str(n).strip().lower() if n not in keep else n for n in df.columns])
    for n in UNSW_MARKERS:
        if n not in renamed.columns:
            raise KeyError(f"expected column '{n}'")
    c = lambda n: F.col(f"`{n}`")
    z = lambda n: F.coalesce(_num(c(n)), F.lit(0.0))
    dur = z("dur")
    if "proto" not in renamed.columns:
        proto = F.lit(-1)
    elif dict(renamed.dtypes)["proto"] in ("int", "bigint", "double", "float", "smallint", "tinyint") \
            or dict(renamed.dtypes)["proto"].startswith("decimal"):
        proto = F.coalesce(c("proto").cast("double"), F.lit(-1.0))
    else:
        u = F.upper(c("proto").cast("string"))
        proto = F.when(u == "TCP", 6).when(u == "UDP", 17).when(u == "ICMP", 1).otherwise(0)
    if "label" in renamed.columns:
        lab = c("label")
    elif "class" in renamed.columns:
        lab = c("class")
    else:
        raise ValueError("UNSW-style data needs a 'label' or 'class' column")
    cols = _compact(z("spkts"), z("dpkts"), z("sbytes"), z("dbytes"), dur, dur, proto, normalize_label(lab))
    return renamed.select(*keep, *cols)


def map_external(df: DataFrame, keep=()) -> DataFrame:
    kind = detect_dataset_type(df.columns)
    return map_cicids2017(df, keep) if kind == "CICIDS2017" else map_unsw_nb15(df, keep)


# ---------------------------------------------------------------------------
# B14-B17 live features from EVE events, D02 mDNS filter
# ---------------------------------------------------------------------------
def proto_number(proto_text: Column, is_number: Column) -> Column:
    """Icmp 1, tcp 6, udp 17, else 0; a JSON number passes through."""
    p = F.lower(F.trim(F.coalesce(proto_text, F.lit(""))))
    named = F.when(p == "icmp", 1).when(p == "tcp", 6).when(p == "udp", 17).otherwise(0)
    num = proto_text.try_cast("double").try_cast("int")
    return F.when(proto_text.isNull(), F.lit(0)).when(is_number, F.coalesce(num, F.lit(0))).otherwise(named)


def private_direction(src_private: Column, dst_private: Column) -> Column:
    """Outbound / inbound / lateral / unknown from private-ness of both ends."""
    return (F.when(src_private & ~dst_private, "outbound").when(~src_private & dst_private, "inbound")
            .when(src_private & dst_private, "lateral").otherwise("unknown"))


def flow_id_fallback(flow_id: Column, src_ip: Column, sport: Column, dest_ip: Column, dport: Column) -> Column:
    """``src:sport->dst:dport`` with '?' for missing addresses."""
    def q(a):
        return F.when(a.isNull() | (a == ""), F.lit("?")).otherwise(a)
    return F.coalesce(flow_id.cast("string"),
                      F.concat(q(src_ip), F.lit(":"), sport.cast("string"), F.lit("->"), q(dest_ip),
                               F.lit(":"), dport.cast("string")))


def is_mdns(sport: Column, dport: Column, dest_ip: Column) -> Column:
    return ((dport == fixed.MDNS_PORT) | (sport == fixed.MDNS_PORT)
            | F.coalesce(dest_ip.isin(*fixed.MDNS_ADDRESSES), F.lit(False)))


def live_flow_features(ev: DataFrame, filter_mdns: bool = True, min_duration: float = 0.01) -> DataFrame:
    """B14 (+B15-B17, D02) on parsed flow events: the 9 model features plus the
    request metadata. age > 0 wins, else end - start, else 0.01; floor 0.01 s;
    ratio (bytes_fwd + 1) / (bytes_rev + 1)."""
    x = ev.withColumns({
        "_sport": _eve_port(ev, "src_port"),
        "_dport": _eve_port(ev, "dest_port"),
    })
    if filter_mdns:
        x = x.filter(~is_mdns(F.col("_sport"), F.col("_dport"), F.col("dest_ip")))  # D02
    age = F.col("flow.age").try_cast("double")
    s, e = iso_to_epoch(F.col("flow.start")), iso_to_epoch(F.col("flow.end"))
    dur = (F.when(F.col("age_is_number") & (age > 0), age)
           .when(s.isNotNull() & e.isNotNull() & (e >= s), e - s).otherwise(F.lit(min_duration)))
    dur = F.greatest(dur, F.lit(min_duration))
    x = x.withColumns({
        "pkts_fwd": _eve_int(ev, "flow.pkts_toserver").cast("double"),
        "pkts_rev": _eve_int(ev, "flow.pkts_toclient").cast("double"),
        "bytes_fwd": _eve_int(ev, "flow.bytes_toserver").cast("double"),
        "bytes_rev": _eve_int(ev, "flow.bytes_toclient").cast("double"),
        "duration": dur,
    })
    x = x.withColumns({
        "pkt_rate": (F.col("pkts_fwd") + F.col("pkts_rev")) / F.col("duration"),
        "byte_rate": (F.col("bytes_fwd") + F.col("bytes_rev")) / F.col("duration"),
        "fwd_rev_ratio": (F.col("bytes_fwd") + 1.0) / (F.col("bytes_rev") + 1.0),
        "proto_num": proto_number(F.col("proto"), F.col("proto_is_number")).cast("double"),
    })
    x = with_ip_scope(with_ip_scope(x, "src_ip", "_ssc"), "dest_ip", "_dsc")
    x = x.withColumns({
        "flow_key": flow_id_fallback(F.col("flow_id"), F.col("src_ip"), F.col("_sport"),
                                     F.col("dest_ip"), F.col("_dport")),
        "direction": private_direction(F.col("_ssc.private"), F.col("_dsc.private")),
        "ts_unix": iso_to_epoch(F.col("timestamp")),
    })
    return x.select(
        F.col("flow_key").alias("flow_id"), "ts_unix", "src_ip", F.col("_sport").alias("src_port"),
        "dest_ip", F.col("_dport").alias("dest_port"), F.col("proto").alias("proto"), "app_proto",
        "direction", "pkts_fwd", "pkts_rev", "bytes_fwd", "bytes_rev", "duration", "pkt_rate",
        "byte_rate", "fwd_rev_ratio", F.col("proto_num").alias("proto_feature"))


def compact_from_flows(flows: DataFrame) -> DataFrame:
    """``compact`` fixture: ``flows`` through the B14 formulas without JSON."""
    dur = F.greatest(F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.lit(0.01)), F.lit(0.01))
    pf, pr = F.col("pkts_fwd").cast("double"), F.col("pkts_rev").cast("double")
    bf, br = F.col("bytes_fwd").cast("double"), F.col("bytes_rev").cast("double")
    p = F.lower(F.col("proto"))
    return flows.select(
        "flow_id", pf.alias("pkts_fwd"), pr.alias("pkts_rev"), bf.alias("bytes_fwd"), br.alias("bytes_rev"),
        dur.alias("duration"), ((pf + pr) / dur).alias("pkt_rate"), ((bf + br) / dur).alias("byte_rate"),
        ((bf + 1.0) / (br + 1.0)).alias("fwd_rev_ratio"),
        F.when(p == "icmp", 1.0).when(p == "tcp", 6.0).when(p == "udp", 17.0).otherwise(0.0).alias("proto"),
        F.col("label").try_cast("int").alias("label"))


# ---------------------------------------------------------------------------
# D03-D05
# ---------------------------------------------------------------------------
def normal_rows(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows with label 0 when the label exists and any row is normal,
    otherwise all rows; the label is dropped. One cheap existence probe."""
    if label_col not in df.columns:
        return df
    has_normal = df.filter(F.col(label_col) == 0).limit(1).count() > 0
    out = df.filter(F.col(label_col) == 0) if has_normal else df
    return out.drop(label_col)


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, drop=("label",)) -> list[str]:
    """Numeric columns by schema (decimal included), label excluded; error when none."""
    cols = [n for n, t in df.dtypes if (t in NUMERIC_TYPES or t.startswith("decimal")) and n not in drop]
    if not cols:
        raise ValueError("no numeric feature columns")
    return cols


def check_feature_contract(df: DataFrame, features_col: str = "features",
                           feature_names=tuple(fixed.COMPACT_FEATURES)) -> tuple[DataFrame, DataFrame]:
    """MAP<STRING,DOUBLE> or ARRAY<DOUBLE> features -> (accepted, rejected);
    rejected rows carry the reference's ``error`` text."""
    dtype = dict(df.dtypes)[features_col]
    names = list(feature_names)
    if dtype.startswith("map"):
        missing = F.filter(F.array(*[F.lit(n) for n in names]),
                           lambda n: ~F.map_contains_key(F.col(features_col), n))
        quoted = F.transform(F.slice(missing, 1, 8), lambda n: F.concat(F.lit("'"), n, F.lit("'")))
        err = F.when(F.size(missing) > 0,
                     F.concat(F.lit("missing_features="), F.size(missing).cast("string"), F.lit(" ex=["),
                              F.array_join(quoted, ", "), F.lit("]")))
    else:
        n = F.size(F.col(features_col))
        err = F.when(n != len(names), F.concat(F.lit("feature_length_mismatch got="), n.cast("string"),
                                               F.lit(f" expected={len(names)}")))
    x = df.withColumn("error", err)
    return x.filter(F.col("error").isNull()).drop("error"), x.filter(F.col("error").isNotNull())


__all__ = ["low"]
