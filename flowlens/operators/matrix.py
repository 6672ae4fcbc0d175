"""The 57-column numeric flow matrix.

Alias resolution and source inference (C01, C02) are plan-time decisions on
``df.columns``; every feature is a column expression in one pass; the only
extra pass is the exact 0.999 nearest-rank winsorisation of four rate columns
(C19), done with the rank helper on the four columns stacked together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ipscope import with_ip_scope
from ..session import ensure_checkpoint_dir
from .ranking import nearest_quantiles_stacked

EPS = 1e-9

# C01 alias lists (first existing column wins); ``FIXES`` adds the missing
# names so the Zeek and EVE 30-column rows resolve every field.
ALIASES = {
    "src_ip": ["src_ip", "id.orig_h"],
    "dst_ip": ["dst_ip", "id.resp_h"],
    "src_port": ["src_port", "id.orig_p"],
    "dst_port": ["dst_port", "id.resp_p"],
    "proto": ["proto", "transport"],
    "app": ["app_proto", "service"],
    "start": ["flow.start_ts", "flow_start_ts", "start", "ts", "timestamp"],
    "end": ["flow.end_ts", "flow_end_ts", "end"],
    "duration": ["flow.duration", "duration_s", "duration"],
    "pkts_srv": ["flow.pkts_toserver", "pkts_toserver", "orig_pkts"],
    "pkts_cli": ["flow.pkts_toclient", "pkts_toclient", "resp_pkts"],
    "bytes_srv": ["flow.bytes_toserver", "bytes_toserver", "orig_ip_bytes", "orig_bytes"],
    "bytes_cli": ["flow.bytes_toclient", "bytes_toclient", "resp_ip_bytes", "resp_bytes"],
    "tcp_flags": ["tcp.flags", "tcp_flags"],
    "history": ["history"],
    "conn_state": ["conn_state"],
}
FIXES = {
    "dst_ip": ["dest_ip"], "dst_port": ["dest_port"], "start": ["start_ts"], "history": ["zeek_history"],
}

MATRIX_COLUMNS = (
    ["duration_s", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "pkts_total",
     "bytes_total", "pps", "bps", "avg_pkt_size", "pkts_dir_ratio", "bytes_dir_ratio", "syn_asymmetry",
     "pkts_asymmetry", "dir_entropy", "server_pps", "client_pps", "server_bps", "client_bps",
     "bytes_per_server_pkt", "bytes_per_client_pkt", "l4_port_class_src", "l4_port_class_dst",
     "is_internal_src", "is_internal_dst", "pat_int_int", "pat_int_ext", "pat_ext_int", "pat_ext_ext",
     "time_of_day_sin", "time_of_day_cos", "proto_TCP", "proto_UDP", "proto_ICMP"]
    + [f"tcp_flag_{n}" for n, _ in fixed.TCP_FLAG_BITS]
    + ["tcp_handshake_ok"] + [f"dstp_{p}" for p in fixed.MATRIX_DST_PORTS]
    + ["dstp_other", "small_flow_flag", "long_flow_flag"])
WINSORISED = ["bps", "pps", "server_bps", "client_bps"]


def pick(columns, role: str, fix_aliases: bool = True):
    """First alias present in ``columns``."""
    opts = ALIASES[role] + (FIXES.get(role, []) if fix_aliases else [])
    return next((c for c in opts if c in columns), None)


def infer_source(columns, fix_aliases: bool = True) -> str:
    """EVE when ``flow.*`` or ``app_proto``; Zeek when history / conn_state /
    id.orig_h. With the fixes, Zeek markers (incl. ``zeek_history``) win."""
    cols = list(columns)
    zeek = any(c in cols for c in ("history", "conn_state", "id.orig_h")) or \
        (fix_aliases and "zeek_history" in cols)
    eve = any(c.startswith("flow.") for c in cols) or "app_proto" in cols
    if fix_aliases and zeek:
        return "zeek"
    if eve:
        return "suricata"
    return "zeek" if zeek else "suricata"


def _c(name):
    return F.col(f"`{name}`")


def _num(name) -> Column:
    return _c(name).cast("string").try_cast("double")


def to_epoch_seconds(name) -> Column:
    """Numeric text first, else a date-time parsed as UTC, else null."""
    raw = _c(name)
    txt = raw.cast("string")
    as_num = txt.try_cast("double")
    s = F.regexp_replace(F.regexp_replace(F.trim(txt), "Z$", "+00:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    as_ts = F.unix_micros(s.try_cast("timestamp")) / F.lit(1e6)
    return F.coalesce(as_num, as_ts)


def tcp_flags_from_int(text: Column) -> list[Column]:
    """Hex only with a ``0x`` prefix, else decimal; bad -> 0."""
    s = F.coalesce(text.cast("string"), F.lit("0"))
    is_hex = F.lower(s).startswith("0x")
    hex_val = F.conv(F.substring(s, 3, 64), 16, 10).try_cast("bigint")
    hex_ok = F.substring(s, 3, 64).rlike("^[0-9a-fA-F]+$")
    dec_val = F.when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(s).try_cast("bigint"))
    n = F.coalesce(F.when(is_hex, F.when(hex_ok, hex_val)).otherwise(dec_val), F.lit(0))
    return [(n.bitwiseAND(F.lit(bit)) != 0).cast("int").alias(f"tcp_flag_{name}")
            for name, bit in fixed.TCP_FLAG_BITS]


def tcp_flags_from_history(h: Column) -> list[Column]:
    """C14: SYN = S or H, ACK = D or H, FIN F, RST R, PSH P, URG U, ECE/CWR 0."""
    s = F.coalesce(h.cast("string"), F.lit(""))
    has = {ch: s.contains(ch) for ch in "SHDFRPU"}
    vals = {"SYN": has["S"] | has["H"], "ACK": has["D"] | has["H"], "FIN": has["F"], "RST": has["R"],
            "PSH": has["P"], "URG": has["U"], "ECE": F.lit(False), "CWR": F.lit(False)}
    return [vals[name].cast("int").alias(f"tcp_flag_{name}") for name, _ in fixed.TCP_FLAG_BITS]


def flow_matrix(df: DataFrame, source: str = "auto", fix_aliases: bool = True,
                winsorise: bool = True, keep: list[str] | None = None) -> DataFrame:
    """C01-C19 on Zeek or EVE rows -> 57 numeric columns (+ ``keep`` columns)."""
    cols = df.columns
    p = {role: pick(cols, role, fix_aliases) for role in ALIASES}
    src = source if source != "auto" else infer_source(cols, fix_aliases)
    keep = keep or []
    zero = F.lit(0.0)

    def num_or0(role):
        return F.greatest(F.coalesce(_num(p[role]), zero), zero) if p[role] else zero

    start = to_epoch_seconds(p["start"]) if p["start"] else F.lit(None).cast("double")
    end = to_epoch_seconds(p["end"]) if p["end"] else F.lit(None).cast("double")
    dur = _num(p["duration"]) if p["duration"] else (end - start)
    base = df.select(
        *[_c(k) for k in keep],
        (F.upper(_c(p["proto"]).cast("string")) if p["proto"] else F.lit("UNK")).alias("_proto"),
        (_c(p["src_ip"]).cast("string") if p["src_ip"] else F.lit("")).alias("_src_ip"),
        (_c(p["dst_ip"]).cast("string") if p["dst_ip"] else F.lit("")).alias("_dst_ip"),
        (F.coalesce(_num(p["src_port"]), zero).try_cast("int") if p["src_port"] else F.lit(0)).alias("_sport"),
        (F.coalesce(_num(p["dst_port"]), zero).try_cast("int") if p["dst_port"] else F.lit(0)).alias("_dport"),
        F.greatest(F.coalesce(dur, zero), zero).alias("duration_s"),
        start.alias("_start"),
        num_or0("pkts_srv").alias("pkts_toserver"), num_or0("pkts_cli").alias("pkts_toclient"),
        num_or0("bytes_srv").alias("bytes_toserver"), num_or0("bytes_cli").alias("bytes_toclient"),
        *(tcp_flags_from_int(_c(p["tcp_flags"])) if (src == "suricata" and p["tcp_flags"]) else
          tcp_flags_from_history(_c(p["history"])) if (src == "zeek" and p["history"]) else
          [F.lit(0).alias(f"tcp_flag_{n}") for n, _ in fixed.TCP_FLAG_BITS]),
        (F.coalesce(_c(p["conn_state"]).cast("string").isin("S1", "SF"), F.lit(False)).cast("int")
         if p["conn_state"] else F.lit(0)).alias("tcp_handshake_ok"),
    )
    sp, cp = F.col("pkts_toserver"), F.col("pkts_toclient")
    sb, cb = F.col("bytes_toserver"), F.col("bytes_toclient")
    x = base.withColumns({"pkts_total": sp + cp, "bytes_total": sb + cb})
    d = F.greatest(F.col("duration_s"), F.lit(EPS))
    pt = F.greatest(F.col("pkts_total"), F.lit(1.0))
    bt = F.greatest(F.col("bytes_total"), F.lit(1.0))
    p_srv, p_cli = sb / bt, cb / bt

    def h(pv):
        return F.when(pv > 0, -pv * F.log2(pv)).otherwise(zero)

    x = with_ip_scope(with_ip_scope(x, "_src_ip", "_ss"), "_dst_ip", "_ds")
    internal_src = (F.col("_ss.private") | F.col("_ss.loopback") | F.col("_ss.link_local")).cast("int")
    internal_dst = (F.col("_ds.private") | F.col("_ds.loopback") | F.col("_ds.link_local")).cast("int")
    # UTC seconds of the day (h * 3600 + m * 60 + s) without the session time zone
    sec = F.pmod(F.floor(F.col("_start")), F.lit(86400))
    theta = F.lit(2 * math.pi) * (sec / F.lit(86400.0))
    ports = [F.lit(v) for v in fixed.MATRIX_DST_PORTS]
    feats = {
        "pps": F.col("pkts_total") / d,
        "bps": F.lit(8.0) * F.col("bytes_total") / d,
        "avg_pkt_size": F.col("bytes_total") / pt,
        "pkts_dir_ratio": sp / F.greatest(cp, F.lit(1.0)),
        "bytes_dir_ratio": sb / F.greatest(cb, F.lit(1.0)),
        "syn_asymmetry": (sb - cb) / bt,
        "pkts_asymmetry": (sp - cp) / pt,
        "dir_entropy": h(p_srv) + h(p_cli),
        "server_pps": sp / d, "client_pps": cp / d,
        "server_bps": F.lit(8.0) * sb / d, "client_bps": F.lit(8.0) * cb / d,
        "bytes_per_server_pkt": sb / F.greatest(sp, F.lit(1.0)),
        "bytes_per_client_pkt": cb / F.greatest(cp, F.lit(1.0)),
        "l4_port_class_src": (F.col("_sport") < 1024).cast("int"),
        "l4_port_class_dst": (F.col("_dport") < 1024).cast("int"),
        "is_internal_src": internal_src, "is_internal_dst": internal_dst,
        "time_of_day_sin": F.sin(theta) if p["start"] else zero,
        "time_of_day_cos": F.cos(theta) if p["start"] else zero,
        "proto_TCP": (F.col("_proto") == "TCP").cast("int"),
        "proto_UDP": (F.col("_proto") == "UDP").cast("int"),
        "proto_ICMP": (F.col("_proto") == "ICMP").cast("int"),
        **{f"dstp_{v}": (F.col("_dport") == v).cast("int") for v in fixed.MATRIX_DST_PORTS},
        "dstp_other": (~F.col("_dport").isin(*ports)).cast("int"),
        "small_flow_flag": ((F.col("pkts_total") <= 3) | (F.col("bytes_total") <= 300)).cast("int"),
        "long_flow_flag": (F.col("duration_s") >= 600).cast("int"),
    }
    x = x.withColumns(feats)
    x = x.withColumns({
        "pat_int_int": ((F.col("is_internal_src") == 1) & (F.col("is_internal_dst") == 1)).cast("int"),
        "pat_int_ext": ((F.col("is_internal_src") == 1) & (F.col("is_internal_dst") == 0)).cast("int"),
        "pat_ext_int": ((F.col("is_internal_src") == 0) & (F.col("is_internal_dst") == 1)).cast("int"),
        "pat_ext_ext": ((F.col("is_internal_src") == 0) & (F.col("is_internal_dst") == 0)).cast("int"),
    })
    # Identifiers dropped; +-inf / NaN / null -> 0
    clean = []
    for c in MATRIX_COLUMNS:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        clean.append(F.when(bad, zero).otherwise(v).alias(c))
    out = x.select(*[_c(k) for k in keep], *clean)
    if winsorise:
        out = winsorise_columns(out, WINSORISED, 0.999)
    return out


def winsorise_columns(df: DataFrame, cols: list[str], q: float = 0.999, materialise: bool = True) -> DataFrame:
    """Clip each column at its nearest-rank ``q`` quantile (exact).

    The counting passes and the final clip read the finished columns several
    times; with ``materialise`` the frame is written once to the reliable checkpoint folder so the upstream
    parse and feature expressions run once."""
    if materialise:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    caps = nearest_quantiles_stacked(df, cols, q)
    return df.withColumns({c: F.least(F.col(c), F.lit(float(caps[c]))) for c in cols if caps.get(c) is not None})
