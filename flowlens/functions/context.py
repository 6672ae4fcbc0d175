"""Severity bands, direction, traffic class, benign context, tags.

Every rule table is one ordered ``when`` chain: the order of the branches is
the semantics (first match wins). Inputs are normalised once into helper
columns (``_p`` protocol, ``_a`` application, ``_sp``/``_dp`` ports, scope
structs) so the chains stay short and codegen-friendly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .ipscope import is_broadcast, localish, with_ip_scope


def low(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def nz(c: Column) -> Column:
    """Null-safe boolean."""
    return F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------------------
# G01 / G10 severity
# ---------------------------------------------------------------------------
def severity_from(score, bands: dict | None) -> Column:
    """Band lookup; no bands -> UNKNOWN; NaN falls through to CRIT."""
    s = F.col(score) if isinstance(score, str) else score
    if not bands:
        return F.lit("UNKNOWN")
    return (F.when(s < F.lit(float(bands["ok"])), "OK")
            .when(s < F.lit(float(bands["warn"])), "WARN")
            .when(s < F.lit(float(bands["crit"])), "MED")
            .otherwise("CRIT"))


def escalate_one_level(sev) -> Column:
    """OK->WARN->MED->CRIT (CRIT stays); other text is returned upper-cased."""
    s = F.upper(F.coalesce((F.col(sev) if isinstance(sev, str) else sev).cast("string"), F.lit("")))
    return (F.when(s == "OK", "WARN").when(s == "WARN", "MED")
            .when(s.isin("MED", "CRIT"), "CRIT").otherwise(s))


def normalize_severity(sev) -> Column:
    """crit/critical, med/medium, warn/warning; anything else (UNKNOWN, '') -> ok."""
    s = low(sev)
    return (F.when(s.isin("crit", "critical"), "crit").when(s.isin("med", "medium"), "med")
            .when(s.isin("warn", "warning"), "warn").otherwise("ok"))


def severity_num(norm: Column) -> Column:
    return (F.when(norm == "crit", 3).when(norm == "med", 2)
            .when(norm == "warn", 1).otherwise(0))


def num_to_severity(num: Column) -> Column:
    return (F.when(num >= 3, "CRIT").when(num == 2, "MED")
            .when(num == 1, "WARN").otherwise("OK"))


# ---------------------------------------------------------------------------
# G03 direction
# ---------------------------------------------------------------------------
def normalize_direction(direction: Column, src_localish: Column, dst_localish: Column) -> Column:
    d = low(direction)
    return (F.when(d.isin("outbound", "egress"), "outbound")
            .when(d.isin("inbound", "ingress"), "inbound")
            .when(d.isin("internal", "local", "lan", "lateral"), "internal")
            .when(src_localish & ~dst_localish, "outbound")
            .when(~src_localish & dst_localish, "inbound")
            .when(src_localish & dst_localish, "internal")
            .otherwise(""))


# ---------------------------------------------------------------------------
# helpers shared by G04-G08
# ---------------------------------------------------------------------------
def with_context_inputs(df: DataFrame) -> DataFrame:
    """Normalised inputs of the context rules, computed once per row."""
    df = with_ip_scope(with_ip_scope(df, "src_ip", "_ss"), "dest_ip", "_ds")
    return df.withColumns({
        "_p": low("proto"),
        "_a": low("app_proto"),
        "_sp": F.col("src_port").try_cast("int"),
        "_dp": F.col("dest_port").try_cast("int"),
        "_sl": localish(F.col("_ss")),
        "_dl": localish(F.col("_ds")),
        "_db": is_broadcast("dest_ip"),
        "_lb": F.col("_ss")["loopback"] | F.col("_ds")["loopback"],
        "_dm": F.col("_ds")["multicast"],
    }).withColumn("_dir", normalize_direction(F.col("direction"), F.col("_sl"), F.col("_dl")))


def in_ports(ports) -> Column:
    """Either port in the set (the reference's {src_port, dest_port} test)."""
    lits = [F.lit(p) for p in ports]
    return nz(F.col("_sp").isin(*lits)) | nz(F.col("_dp").isin(*lits))


def dest_port_in(ports) -> Column:
    return nz(F.col("_dp").isin(*[F.lit(p) for p in ports]))


CONTEXT_HELPERS = ["_ss", "_ds", "_p", "_a", "_sp", "_dp", "_sl", "_dl", "_db", "_lb", "_dm", "_dir"]


# ---------------------------------------------------------------------------
# G04 traffic class (rule order = semantics)
# ---------------------------------------------------------------------------
def traffic_class_expr() -> Column:
    p, a = F.col("_p"), F.col("_a")
    weak = a.isin(*fixed.WEAK_APP_PROTOS)
    d = F.col("_dir")
    return (
        F.when((a == "dns") | in_ports([53]), "dns")
        .when((a == "ntp") | in_ports([123]), "time_sync")
        .when(p.contains("icmp"), "local_discovery")
        .when(a.isin(*fixed.LOCAL_DISCOVERY_APPS), "local_discovery")
        .when(in_ports(fixed.LOCAL_DISCOVERY_PORTS), "local_discovery")
        .when(F.col("_dm") | F.col("_db"), "local_discovery")
        .when((p == "udp") & F.col("_sl") & F.col("_dl") & weak, "local_discovery")
        .when(a.isin(*fixed.REMOTE_ACCESS_APPS) | in_ports(fixed.REMOTE_ACCESS_PORTS), "remote_access")
        .when((a == "http") | nz(F.col("_dp") == 80), "web_http")
        .when(a.isin(*fixed.HTTPS_APPS), "web_https")
        .when(dest_port_in(fixed.HTTPS_PORTS), "web_https")
        # (udp and dest 443 -> web_https is shadowed by the previous rule)
        .when(a.isin(*fixed.CHAT_APPS) | in_ports(fixed.CHAT_PORTS), "chat_messaging")
        .when(a.isin(*fixed.STREAMING_APPS) | in_ports(fixed.STREAMING_PORTS), "streaming")
        # (local UDP media -> streaming and tcp 443 -> software_update are shadowed
        #  by the local_discovery and web_https rules above)
        .when(p.isin("tcp", "udp") & nz(F.col("_dp") >= 1024) & d.isin("outbound", "internal"),
              "background_service")
        .otherwise("unknown"))


# ---------------------------------------------------------------------------
# G06 context tags
# ---------------------------------------------------------------------------
def context_tags_expr(class0: Column) -> Column:
    p, a, d = F.col("_p"), F.col("_a"), F.col("_dir")
    ss, ds = F.col("_ss"), F.col("_ds")
    both_private = ss["private"] & ds["private"]
    scope_tag = (F.when(both_private, "private_lan")
                 .when(F.col("_sl") & F.col("_dl"), "local_network")
                 .when((d == "outbound") & ~F.col("_dl"), "internet_outbound"))
    tags = F.array(
        F.when(p != "", p),
        F.when((a != "") & ~a.isin("unknown", "failed"), a),
        F.when(d != "", d),
        F.when(F.col("_lb"), F.lit("loopback")),
        F.when(F.col("_dm"), F.lit("multicast")),
        F.when(F.col("_db"), F.lit("broadcast")),
        scope_tag,
        F.when(ds["link_local"], F.lit("link_local")),
        F.when(class0 != "", class0),
    )
    return F.array_distinct(F.filter(tags, lambda x: x.isNotNull()))


# ---------------------------------------------------------------------------
# G07 benign context: struct(traffic_class, likely_benign, benign_reason)
# ---------------------------------------------------------------------------
def _ctx(cls: Column, benign: bool, reason_key: str) -> Column:
    return F.struct(cls.alias("traffic_class"), F.lit(benign).alias("likely_benign"),
                    F.lit(fixed.BENIGN_REASONS[reason_key]).alias("benign_reason"))


def benign_context_expr(class0: Column) -> Column:
    p, d = F.col("_p"), F.col("_dir")
    unk = class0 == "unknown"
    as_bg = F.when(unk, F.lit("background_service")).otherwise(class0)
    as_ld = F.when(unk, F.lit("local_discovery")).otherwise(class0)
    dns_common = p.isin("udp", "tcp") & in_ports([53]) & d.isin("outbound", "internal", "")
    https_common = (dest_port_in(fixed.HTTPS_PORTS) & d.isin("outbound", "")
                    & ~F.col("_dm") & ~F.col("_db"))
    weak = F.col("_a").isin(*fixed.WEAK_APP_PROTOS)
    return (
        F.when(F.col("_lb"), _ctx(as_bg, True, "loopback"))
        .when(F.col("_db"), _ctx(as_ld, True, "broadcast"))
        .when((p == "udp") & nz(F.col("dest_ip") == fixed.SSDP_ADDRESS) & in_ports([1900]),
              _ctx(F.lit("local_discovery"), True, "ssdp"))
        .when(F.col("_dm"), _ctx(as_ld, True, "multicast"))
        .when(class0 == "local_discovery", _ctx(class0, True, "local_discovery"))
        .when(class0 == "time_sync", _ctx(class0, True, "time_sync"))
        .when((class0 == "dns") & dns_common, _ctx(class0, True, "dns_common"))
        .when(class0 == "dns", _ctx(class0, False, "dns_other"))
        .when((class0 == "web_https") & https_common, _ctx(class0, True, "https_common"))
        .when(class0 == "web_https", _ctx(class0, False, "https_other"))
        .when(class0 == "web_http", _ctx(class0, False, "http"))
        .when(class0 == "streaming", _ctx(class0, True, "streaming"))
        # rule 10 (private-LAN UDP with weak app) is shadowed by class rule 7
        .when((p == "udp") & F.col("_sl") & F.col("_dl") & weak, _ctx(as_bg, True, "lan_udp"))
        .otherwise(_ctx(class0, False, "fallback")))


# ---------------------------------------------------------------------------
# G05 traffic note
# ---------------------------------------------------------------------------
def traffic_note_expr(cls: Column, raw_severity: Column, is_anom: Column) -> Column:
    c = low(cls)
    sev = low(raw_severity)
    normal = F.create_map(*[x for k, v in fixed.TRAFFIC_NOTES.items() for x in (F.lit(k), F.lit(v[0]))])
    anomalous = F.create_map(*[x for k, v in fixed.TRAFFIC_NOTES.items() for x in (F.lit(k), F.lit(v[1]))])
    known = F.when(F.coalesce(is_anom, F.lit(False)), F.try_element_at(anomalous, c))\
        .otherwise(F.try_element_at(normal, c))
    return F.coalesce(known, F.when(sev == "crit", F.lit(fixed.UNKNOWN_NOTE_CRIT))
                      .when(sev.isin("warn", "med"), F.lit(fixed.UNKNOWN_NOTE_MODERATE))
                      .otherwise(F.lit(fixed.UNKNOWN_NOTE)))


# ---------------------------------------------------------------------------
# G08 common-desktop predicate
# ---------------------------------------------------------------------------
def common_desktop_expr(cls: Column, protocol: Column, dport: Column,
                        explicit: Column | None = None) -> Column:
    rule = (cls.isin(*fixed.COMMON_DESKTOP_CLASSES)
            | nz(dport.isin(*[F.lit(p) for p in fixed.COMMON_DESKTOP_PORTS]))
            | protocol.isin(*fixed.COMMON_DESKTOP_PROTOCOLS))
    if explicit is None:
        return rule
    return F.when(explicit.isNotNull(), explicit.cast("boolean")).otherwise(rule)


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------
def raw_event(df: DataFrame, bands: dict | None = None, score_col: str = "ae_score") -> DataFrame:
    """Raw event projection with severity and model flag (bands default: live bands)."""
    bands = fixed.LIVE_BANDS if bands is None else bands
    sev = severity_from(score_col, bands)
    return df.withColumns({
        "raw_severity": sev,
        "src_ip": F.coalesce(F.col("src_ip").cast("string"), F.lit("")),
        "dest_ip": F.coalesce(F.col("dest_ip").cast("string"), F.lit("")),
        "proto": F.upper(F.coalesce(F.col("proto").cast("string"), F.lit(""))),
        "app_proto": F.coalesce(F.col("app_proto").cast("string"), F.lit("")),
        "direction": F.coalesce(F.col("direction").cast("string"), F.lit("")),
    }).withColumn("is_anom", ~F.col("raw_severity").isin("OK", "UNKNOWN"))


def enrich_context(df: DataFrame, keep_helpers: bool = False) -> DataFrame:
    """G03-G07 on a raw event frame: traffic_class, likely_benign, benign_reason,
    context_tags, traffic_note (and the normalised direction as ``direction_norm``)."""
    out = with_context_inputs(df)
    out = out.withColumn("_class0", traffic_class_expr())
    out = out.withColumns({
        "_ctx": benign_context_expr(F.col("_class0")),
        "context_tags": context_tags_expr(F.col("_class0")),
        "direction_norm": F.col("_dir"),
    })
    out = out.withColumns({
        "traffic_class": F.col("_ctx.traffic_class"),
        "likely_benign": F.col("_ctx.likely_benign"),
        "benign_reason": F.col("_ctx.benign_reason"),
    })
    out = out.withColumn("traffic_note", traffic_note_expr(
        F.col("traffic_class"), F.col("raw_severity"), F.col("is_anom")))
    drop = ["_ctx"] if keep_helpers else CONTEXT_HELPERS + ["_ctx", "_class0"]
    return out.drop(*drop)
