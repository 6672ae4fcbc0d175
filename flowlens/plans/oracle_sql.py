"""Independent DuckDB SQL formulations of the registered queries.

The SQL is assembled from named CTE layers (``flows`` -> ``ev`` -> scopes ->
class -> context -> repetition -> decision -> text) so each oracle query only
states its final SELECT. Nothing here is executed by Spark.
"""

from __future__ import annotations

from ..functions import fixed

# ---------------------------------------------------------------------------
# base views
# ---------------------------------------------------------------------------
FLOWS = """flows AS (
SELECT event_id AS flow_id,
       CAST(1704067200.0 + event_id * 0.5 AS DOUBLE) AS ts_unix,
       concat(CASE WHEN user_id % 7 = 0 THEN '8.8.4.' ELSE '192.168.1.' END, CAST(10 + user_id % 4 AS VARCHAR)) AS src_ip,
       CAST(1024 + (user_id * 37) % 60000 AS INT) AS src_port,
       CASE k % 8 WHEN 0 THEN '192.168.1.1' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '239.255.255.250' WHEN 3 THEN '255.255.255.255'
                  WHEN 4 THEN '2a00:1450::1' WHEN 5 THEN 'fe80::1' WHEN 6 THEN '127.0.0.1' ELSE '1.1.1.1' END AS dest_ip,
       CASE (k + user_id) % 12 WHEN 0 THEN 53 WHEN 1 THEN 443 WHEN 2 THEN 80 WHEN 3 THEN 123 WHEN 4 THEN 22 WHEN 5 THEN 1900
                  WHEN 6 THEN 4444 WHEN 7 THEN 3478 WHEN 8 THEN 554 WHEN 9 THEN 8443 WHEN 10 THEN 31337 ELSE 700 END AS dest_port,
       CASE WHEN k % 10 < 6 THEN 'TCP' WHEN k % 10 < 9 THEN 'UDP' ELSE 'ICMP' END AS proto,
       CASE event_type WHEN 'click' THEN 'tls' WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'quic' WHEN 'error' THEN 'failed' ELSE '' END AS app_proto,
       CASE WHEN event_id % 5 = 0 THEN 'lateral' WHEN event_id % 5 = 1 THEN 'egress' ELSE 'unknown' END AS direction,
       CAST(1 + CAST(floor(value) AS BIGINT) % 50 AS BIGINT) AS pkts_fwd,
       CAST(event_id % 40 AS BIGINT) AS pkts_rev,
       CAST((1 + CAST(floor(value) AS BIGINT) % 50) * (60 + k) AS BIGINT) AS bytes_fwd,
       CAST((event_id % 40) * (40 + user_id % 100) AS BIGINT) AS bytes_rev,
       CAST((event_id % 400) * 0.25 AS DOUBLE) AS duration,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       CAST(value / 15.0 AS DOUBLE) AS ae_score
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
)"""


def _ints(values) -> str:
    return ", ".join(str(v) for v in values)


def _strs(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# address scope in SQL (IPv4 exact; IPv6 by textual prefix, enough for the fixture)
# ---------------------------------------------------------------------------
_OCT = "(0|[1-9][0-9]{0,2})"
V4_RE = "^" + "\\.".join([_OCT] * 4) + "$"


def _v4(text):
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _rng(net):
    lo = _v4(net[0])
    return lo, lo + (1 << (32 - net[1])) - 1


def v4num(a: str) -> str:
    parts = [f"TRY_CAST(regexp_extract({a}, '{V4_RE}', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = " AND ".join(f"{p} <= 255" for p in parts)
    return (f"CASE WHEN regexp_matches(coalesce({a}, ''), '{V4_RE}') AND {ok} THEN "
            f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END")


def _between(n, net):
    lo, hi = _rng(net)
    return f"({n} BETWEEN {lo} AND {hi})"


def scope_sql(n: str, a: str) -> dict:
    """SQL boolean expressions for private/loopback/link_local/multicast/unspecified."""
    la = f"lower(coalesce({a}, ''))"
    v6 = f"contains(coalesce({a}, ''), ':')"
    v6_private = (f"({la} IN ('::1', '::') OR {la} LIKE 'fe8%' OR {la} LIKE 'fe9%' OR {la} LIKE 'fea%' "
                  f"OR {la} LIKE 'feb%' OR {la} LIKE 'fc%' OR {la} LIKE 'fd%' OR {la} LIKE '2001:db8:%' "
                  f"OR {la} LIKE '2002:%')")
    v4_private = " OR ".join(_between(n, net) for net in fixed.IPV4_PRIVATE_NETS)
    v4_exc = " OR ".join(_between(n, net) for net in fixed.IPV4_PRIVATE_EXCEPTIONS)
    return {
        "private": f"CASE WHEN {v6} THEN {v6_private} ELSE coalesce(({v4_private}) AND NOT ({v4_exc}), false) END",
        "loopback": f"CASE WHEN {v6} THEN {la} = '::1' ELSE coalesce({_between(n, fixed.IPV4_LOOPBACK_NET)}, false) END",
        "link_local": (f"CASE WHEN {v6} THEN ({la} LIKE 'fe8%' OR {la} LIKE 'fe9%' OR {la} LIKE 'fea%' OR {la} LIKE 'feb%') "
                       f"ELSE coalesce({_between(n, fixed.IPV4_LINK_LOCAL_NET)}, false) END"),
        "multicast": f"CASE WHEN {v6} THEN {la} LIKE 'ff%' ELSE coalesce({_between(n, fixed.IPV4_MULTICAST_NET)}, false) END",
        "unspecified": f"CASE WHEN {v6} THEN {la} = '::' ELSE coalesce({n} = 0, false) END",
    }


# ---------------------------------------------------------------------------
# decision chain layers
# ---------------------------------------------------------------------------
def _in_ports(ports) -> str:
    return f"(coalesce(_sp IN ({_ints(ports)}), false) OR coalesce(_dp IN ({_ints(ports)}), false))"


def _dport_in(ports) -> str:
    return f"coalesce(_dp IN ({_ints(ports)}), false)"


def ev_layers(score_bands=None) -> list[str]:
    b = fixed.LIVE_BANDS if score_bands is None else score_bands
    s_scope = scope_sql("_sn", "src_ip")
    d_scope = scope_sql("_dn", "dest_ip")
    ev = f"""ev AS (
SELECT flow_id, ts_unix, coalesce(src_ip, '') AS src_ip, src_port, coalesce(dest_ip, '') AS dest_ip, dest_port,
       upper(coalesce(proto, '')) AS proto, coalesce(app_proto, '') AS app_proto, coalesce(direction, '') AS direction,
       ae_score, label,
       CASE WHEN ae_score < {b['ok']} THEN 'OK' WHEN ae_score < {b['warn']} THEN 'WARN'
            WHEN ae_score < {b['crit']} THEN 'MED' ELSE 'CRIT' END AS raw_severity
FROM flows)"""
    ev_n = f"""ev_n AS (
SELECT *, raw_severity NOT IN ('OK', 'UNKNOWN') AS is_anom,
       lower(trim(proto)) AS _p, lower(trim(app_proto)) AS _a,
       TRY_CAST(src_port AS INTEGER) AS _sp, TRY_CAST(dest_port AS INTEGER) AS _dp,
       {v4num('src_ip')} AS _sn, {v4num('dest_ip')} AS _dn
FROM ev)"""
    ev_s = f"""ev_s AS (
SELECT *,
       {s_scope['private']} AS s_private, {s_scope['loopback']} AS s_loopback, {s_scope['link_local']} AS s_link_local,
       {s_scope['multicast']} AS s_multicast, {s_scope['unspecified']} AS s_unspecified,
       {d_scope['private']} AS d_private, {d_scope['loopback']} AS d_loopback, {d_scope['link_local']} AS d_link_local,
       {d_scope['multicast']} AS d_multicast, {d_scope['unspecified']} AS d_unspecified,
       coalesce(trim(dest_ip) = '255.255.255.255', false) AS _db
FROM ev_n)"""
    ev_l = """ev_l AS (
SELECT *, (s_private OR s_loopback OR s_link_local) AS _sl, (d_private OR d_loopback OR d_link_local) AS _dl,
       (s_loopback OR d_loopback) AS _lb, d_multicast AS _dm
FROM ev_s)"""
    ev_d = """ev_d AS (
SELECT *, CASE WHEN lower(trim(direction)) IN ('outbound', 'egress') THEN 'outbound'
               WHEN lower(trim(direction)) IN ('inbound', 'ingress') THEN 'inbound'
               WHEN lower(trim(direction)) IN ('internal', 'local', 'lan', 'lateral') THEN 'internal'
               WHEN _sl AND NOT _dl THEN 'outbound'
               WHEN NOT _sl AND _dl THEN 'inbound'
               WHEN _sl AND _dl THEN 'internal' ELSE '' END AS _dir
FROM ev_l)"""
    weak = f"_a IN ({_strs(fixed.WEAK_APP_PROTOS)})"
    cls = f"""cls AS (
SELECT *, CASE
  WHEN _a = 'dns' OR {_in_ports([53])} THEN 'dns'
  WHEN _a = 'ntp' OR {_in_ports([123])} THEN 'time_sync'
  WHEN contains(_p, 'icmp') THEN 'local_discovery'
  WHEN _a IN ({_strs(fixed.LOCAL_DISCOVERY_APPS)}) THEN 'local_discovery'
  WHEN {_in_ports(fixed.LOCAL_DISCOVERY_PORTS)} THEN 'local_discovery'
  WHEN _dm OR _db THEN 'local_discovery'
  WHEN _p = 'udp' AND _sl AND _dl AND {weak} THEN 'local_discovery'
  WHEN _a IN ({_strs(fixed.REMOTE_ACCESS_APPS)}) OR {_in_ports(fixed.REMOTE_ACCESS_PORTS)} THEN 'remote_access'
  WHEN _a = 'http' OR coalesce(_dp = 80, false) THEN 'web_http'
  WHEN _a IN ({_strs(fixed.HTTPS_APPS)}) THEN 'web_https'
  WHEN {_dport_in(fixed.HTTPS_PORTS)} THEN 'web_https'
  WHEN _a IN ({_strs(fixed.CHAT_APPS)}) OR {_in_ports(fixed.CHAT_PORTS)} THEN 'chat_messaging'
  WHEN _a IN ({_strs(fixed.STREAMING_APPS)}) OR {_in_ports(fixed.STREAMING_PORTS)} THEN 'streaming'
  WHEN _p IN ('tcp', 'udp') AND coalesce(_dp >= 1024, false) AND _dir IN ('outbound', 'internal') THEN 'background_service'
  ELSE 'unknown' END AS class0
FROM ev_d)"""
    R = fixed.BENIGN_REASONS
    dns_common = f"(_p IN ('udp', 'tcp') AND {_in_ports([53])} AND _dir IN ('outbound', 'internal', ''))"
    https_common = f"({_dport_in(fixed.HTTPS_PORTS)} AND _dir IN ('outbound', '') AND NOT _dm AND NOT _db)"
    ssdp = f"(_p = 'udp' AND coalesce(dest_ip = '{fixed.SSDP_ADDRESS}', false) AND {_in_ports([1900])})"
    lan_udp = f"(_p = 'udp' AND _sl AND _dl AND {weak})"
    rule = f"""CASE WHEN _lb THEN 1 WHEN _db THEN 2 WHEN {ssdp} THEN 3 WHEN _dm THEN 4
  WHEN class0 = 'local_discovery' THEN 5 WHEN class0 = 'time_sync' THEN 6
  WHEN class0 = 'dns' AND {dns_common} THEN 7 WHEN class0 = 'dns' THEN 8
  WHEN class0 = 'web_https' AND {https_common} THEN 9 WHEN class0 = 'web_https' THEN 10
  WHEN class0 = 'web_http' THEN 11 WHEN class0 = 'streaming' THEN 12
  WHEN {lan_udp} THEN 13 ELSE 14 END"""
    ctx0 = f"""ctx0 AS (SELECT *, {rule} AS _rule FROM cls)"""
    reasons = [R["loopback"], R["broadcast"], R["ssdp"], R["multicast"], R["local_discovery"], R["time_sync"],
               R["dns_common"], R["dns_other"], R["https_common"], R["https_other"], R["http"], R["streaming"],
               R["lan_udp"], R["fallback"]]
    reason_case = "CASE _rule " + " ".join(f"WHEN {i + 1} THEN {q(r)}" for i, r in enumerate(reasons)) + " END"
    tags_list = """[CASE WHEN _p <> '' THEN _p END,
        CASE WHEN _a <> '' AND _a NOT IN ('unknown', 'failed') THEN _a END,
        CASE WHEN _dir <> '' THEN _dir END,
        CASE WHEN _lb THEN 'loopback' END,
        CASE WHEN _dm THEN 'multicast' END,
        CASE WHEN _db THEN 'broadcast' END,
        CASE WHEN s_private AND d_private THEN 'private_lan' WHEN _sl AND _dl THEN 'local_network'
             WHEN _dir = 'outbound' AND NOT _dl THEN 'internet_outbound' END,
        CASE WHEN d_link_local THEN 'link_local' END,
        CASE WHEN class0 <> '' THEN class0 END]"""
    ctx = f"""ctx AS (
SELECT *,
  CASE WHEN _rule IN (1, 13) AND class0 = 'unknown' THEN 'background_service'
       WHEN _rule IN (2, 4) AND class0 = 'unknown' THEN 'local_discovery'
       WHEN _rule = 3 THEN 'local_discovery' ELSE class0 END AS traffic_class,
  _rule IN (1, 2, 3, 4, 5, 6, 7, 9, 12, 13) AS likely_benign,
  {reason_case} AS benign_reason,
  list_filter(list_filter({tags_list}, lambda x: x IS NOT NULL),
              lambda x, i: list_position(list_filter({tags_list}, lambda y: y IS NOT NULL), x) = i) AS _tags
FROM ctx0)"""
    notes_n = " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in fixed.TRAFFIC_NOTES.items())
    notes_a = " ".join(f"WHEN {q(k)} THEN {q(v[1])}" for k, v in fixed.TRAFFIC_NOTES.items())
    note = f"""note AS (
SELECT *, array_to_string(_tags, ',') AS context_tags_text,
  coalesce(CASE WHEN is_anom THEN (CASE lower(trim(traffic_class)) {notes_a} END)
                ELSE (CASE lower(trim(traffic_class)) {notes_n} END) END,
           CASE WHEN lower(raw_severity) = 'crit' THEN {q(fixed.UNKNOWN_NOTE_CRIT)}
                WHEN lower(raw_severity) IN ('warn', 'med') THEN {q(fixed.UNKNOWN_NOTE_MODERATE)}
                ELSE {q(fixed.UNKNOWN_NOTE)} END) AS traffic_note
FROM ctx)"""
    W, CAP = fixed.REPEAT_WINDOW_S, fixed.REPEAT_MAX_EVENTS_PER_KEY
    rkey = """rkey AS (
SELECT *,
  CASE WHEN is_anom THEN CASE WHEN src_ip = '' THEN '?' ELSE src_ip END END AS k_src,
  CASE WHEN is_anom THEN CASE WHEN dest_ip = '' THEN '?' ELSE dest_ip END END AS k_dst,
  CASE WHEN is_anom THEN upper(CASE WHEN proto = '' THEN '?' ELSE proto END) END AS k_proto,
  CASE WHEN is_anom THEN lower(CASE WHEN traffic_class = '' THEN 'unknown' ELSE traffic_class END) END AS k_class,
  CASE WHEN is_anom THEN CASE WHEN lower(CASE WHEN traffic_class = '' THEN 'unknown' ELSE traffic_class END)
                                  IN ('local_discovery', 'dns') THEN 0
                             ELSE coalesce(TRY_CAST(CAST(dest_port AS VARCHAR) AS INTEGER), 0) END END AS k_port
FROM note)"""
    rep = f"""rep AS (
SELECT *, CASE WHEN is_anom THEN least(
    count(*) OVER (PARTITION BY k_src, k_dst, k_proto, k_class, k_port, is_anom ORDER BY ts_unix
                   RANGE BETWEEN {W} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY k_src, k_dst, k_proto, k_class, k_port, is_anom, ts_unix)
    + row_number() OVER (PARTITION BY k_src, k_dst, k_proto, k_class, k_port, is_anom, ts_unix ORDER BY flow_id) - 1,
    {CAP}) ELSE 0 END AS repeat_previous_count
FROM rkey)"""
    rep2 = f"""rep2 AS (
SELECT *, CASE WHEN is_anom THEN least(repeat_previous_count + 1, {CAP}) ELSE 0 END AS repeat_count,
  CASE WHEN repeat_previous_count <= 0 THEN 'single' WHEN repeat_previous_count < 2 THEN 'repeated'
       ELSE 'persistent' END AS repeat_level
FROM rep)"""
    return [FLOWS, ev, ev_n, ev_s, ev_l, ev_d, cls, ctx0, ctx, note, rkey, rep, rep2]


def decision_layers() -> list[str]:
    P = _ints(fixed.COMMON_DESKTOP_PORTS)
    adj0 = f"""adj0 AS (
SELECT *,
  CASE WHEN lower(trim(traffic_class)) = '' THEN 'unknown' ELSE lower(trim(traffic_class)) END AS _c,
  CASE WHEN lower(trim(raw_severity)) IN ('crit', 'critical') THEN 3 WHEN lower(trim(raw_severity)) IN ('med', 'medium') THEN 2
       WHEN lower(trim(raw_severity)) IN ('warn', 'warning') THEN 1 ELSE 0 END AS _rn,
  CASE WHEN lower(trim(proto)) = '' THEN 'unknown' ELSE lower(trim(proto)) END AS _proto_n
FROM rep2)"""
    adj1 = f"""adj1 AS (
SELECT *,
  (_c IN ({_strs(fixed.COMMON_DESKTOP_CLASSES)}) OR coalesce(_dp IN ({P}), false)
   OR _proto_n IN ({_strs(fixed.COMMON_DESKTOP_PROTOCOLS)})) AS common_desktop,
  _c IN ({_strs(fixed.UNKNOWN_CLASSES)}) AS _unk,
  _c IN ({_strs(fixed.STRONGLY_BENIGN_CLASSES)}) AS _strong,
  _c IN ({_strs(fixed.SOFT_BENIGN_CLASSES)}) AS _soft,
  (_c = 'local_discovery' AND likely_benign) AS _sld
FROM adj0)"""
    adj2 = f"""adj2 AS (
SELECT *,
  CASE WHEN common_desktop AND NOT _unk AND _strong THEN greatest(_rn - 2, 0)
       WHEN common_desktop AND NOT _unk THEN greatest(_rn - 1, 0) ELSE _rn END AS _s1,
  CASE WHEN common_desktop AND NOT _unk AND _strong THEN {q(fixed.REASON_STRONG)}
       WHEN common_desktop AND NOT _unk AND _soft THEN {q(fixed.REASON_SOFT)}
       WHEN common_desktop AND NOT _unk THEN {q(fixed.REASON_KNOWN)} END AS _r1,
  (repeat_level = 'persistent' AND NOT _sld) AS _bump
FROM adj1)"""
    adj3 = f"""adj3 AS (
SELECT *,
  CASE WHEN (CASE WHEN _bump THEN least(_s1 + 1, 3) ELSE _s1 END) >= 3 THEN 'CRIT'
       WHEN (CASE WHEN _bump THEN least(_s1 + 1, 3) ELSE _s1 END) = 2 THEN 'MED'
       WHEN (CASE WHEN _bump THEN least(_s1 + 1, 3) ELSE _s1 END) = 1 THEN 'WARN' ELSE 'OK' END
    AS final_severity_after_context,
  list_filter([_r1, CASE WHEN _bump THEN {q(fixed.REASON_PERSISTENT)} END], lambda x: x IS NOT NULL) AS _reasons
FROM adj2)"""
    esc = ("CASE {c} WHEN 'OK' THEN 'WARN' WHEN 'WARN' THEN 'MED' WHEN 'MED' THEN 'CRIT' "
           "WHEN 'CRIT' THEN 'CRIT' ELSE {c} END")
    cur = "final_severity_after_context"
    rv0 = f"""rv0 AS (
SELECT *,
  lower(trim(traffic_class)) IN ('', 'unknown', 'other', 'failed') AS _unk2,
  (_dp IS NOT NULL AND NOT coalesce(_dp IN ({P}), false)) AS _uncommon
FROM adj3)"""
    rv1 = f"""rv1 AS (
SELECT *, (_unk2 OR _uncommon) AS _odd,
  (lower(trim(traffic_class)) = 'local_discovery' AND likely_benign AND NOT _unk2) AS _sld2,
  (NOT is_anom OR repeat_level = 'single') AS _untouched
FROM rv0)"""
    rv2 = f"""rv2 AS (
SELECT *,
  CASE WHEN _untouched OR _sld2 THEN {cur}
       WHEN repeat_level = 'repeated' THEN
         CASE WHEN likely_benign THEN {cur} WHEN _odd THEN {esc.format(c=cur)}
              WHEN {cur} = 'OK' THEN 'WARN' ELSE {cur} END
       ELSE
         CASE WHEN likely_benign THEN CASE WHEN {cur} = 'OK' THEN 'WARN' ELSE {cur} END
              WHEN _odd THEN CASE WHEN {cur} = 'OK' THEN 'MED' WHEN {cur} = 'WARN' THEN 'CRIT' ELSE {esc.format(c=cur)} END
              ELSE {esc.format(c=cur)} END END AS _mid,
  CASE WHEN _untouched OR _sld2 THEN NULL
       WHEN repeat_level = 'repeated' THEN
         CASE WHEN likely_benign THEN {q(fixed.REVIEW_REPEATED_BENIGN)} WHEN _odd THEN {q(fixed.REVIEW_REPEATED_UNKNOWN)}
              WHEN {cur} = 'OK' THEN {q(fixed.REVIEW_REPEATED_OK)} END
       ELSE
         CASE WHEN likely_benign THEN {q(fixed.REVIEW_PERSISTENT_BENIGN)} WHEN _odd THEN {q(fixed.REVIEW_PERSISTENT_UNKNOWN)}
              ELSE {q(fixed.REVIEW_PERSISTENT_OTHER)} END END AS _mid_reason
FROM rv1)"""
    rv3 = f"""rv3 AS (
SELECT *, {cur} AS final_severity_before_repeat,
  CASE WHEN NOT _untouched AND NOT _sld2 AND _mid IN ('OK', 'WARN') THEN 'MED' ELSE _mid END AS final_severity_review,
  CASE WHEN NOT _untouched AND _sld2 THEN {q(fixed.REVIEW_LOCAL_DISCOVERY)}
       WHEN NOT _untouched AND NOT _sld2 AND _mid IN ('OK', 'WARN') THEN
            concat_ws('; ', _mid_reason, {q(fixed.REVIEW_FLOOR)})
       ELSE coalesce(_mid_reason, '') END AS final_severity_reason
FROM rv2)"""
    lab0 = f"""lab0 AS (
SELECT *,
  CASE WHEN lower(trim(raw_severity)) IN ('crit', 'critical') THEN 'crit' WHEN lower(trim(raw_severity)) IN ('med', 'medium') THEN 'med'
       WHEN lower(trim(raw_severity)) IN ('warn', 'warning') THEN 'warn' ELSE 'ok' END AS _raw,
  CASE WHEN lower(trim(final_severity_review)) IN ('crit', 'critical') THEN 'crit' WHEN lower(trim(final_severity_review)) IN ('med', 'medium') THEN 'med'
       WHEN lower(trim(final_severity_review)) IN ('warn', 'warning') THEN 'warn' ELSE 'ok' END AS _fin0
FROM rv3)"""
    lab1 = f"""lab1 AS (
SELECT *,
  (_raw = 'crit' AND _fin0 IN ('ok', 'warn') AND NOT (lower(trim(traffic_class)) = 'local_discovery' AND likely_benign)) AS _floor
FROM lab0)"""
    lab2 = f"""lab2 AS (
SELECT *, CASE WHEN _floor THEN 'med' ELSE _fin0 END AS _fin,
  CASE WHEN _floor THEN list_append(_reasons, {q(fixed.REASON_CRIT_FLOOR)}) ELSE _reasons END AS adjustment_reasons
FROM lab1)"""
    lab3 = """lab3 AS (
SELECT *, upper(_fin) AS final_severity,
  CASE _fin WHEN 'ok' THEN 'OK' WHEN 'warn' THEN 'BENIGN' WHEN 'med' THEN 'REVIEW' ELSE 'CRITICAL' END AS final_label
FROM lab2)"""
    lab4 = """lab4 AS (
SELECT *,
  CASE final_label WHEN 'OK' THEN 'The raw model score did not cross the anomaly threshold.'
       WHEN 'BENIGN' THEN concat('Model flagged the flow (', upper(_raw), '), but context suggests likely benign ', coalesce(traffic_class, 'traffic'), '.')
       WHEN 'REVIEW' THEN concat('Unusual flow kept for review (', upper(_raw), ' raw, ', final_severity, ' adjusted).')
       ELSE concat('Critical anomaly detected (', upper(_raw), ' raw, ', final_severity, ' adjusted), requires immediate attention.') END
  || CASE WHEN len(adjustment_reasons) > 0 THEN concat(' Reason: ', array_to_string(adjustment_reasons, ', '), '.') ELSE '' END
  AS display_label_reason
FROM lab3)"""
    return [adj0, adj1, adj2, adj3, rv0, rv1, rv2, rv3, lab0, lab1, lab2, lab3, lab4]


def _map_case(col: str, table: dict, default: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def text_layers() -> list[str]:
    t0 = """t0 AS (
SELECT *,
  CASE WHEN lower(trim(coalesce(traffic_class, ''))) = '' THEN 'unknown' ELSE lower(trim(traffic_class)) END AS _tc,
  CASE WHEN lower(trim(coalesce(repeat_level, ''))) = '' THEN 'single' ELSE lower(trim(repeat_level)) END AS _tl,
  CASE lower(trim(final_label)) WHEN 'critical' THEN 'critical' WHEN 'benign' THEN 'benign' WHEN 'ok' THEN 'ok' ELSE 'review' END AS _tb,
  CASE WHEN k_dst IS NULL OR trim(k_dst) = '' THEN 'unknown' ELSE trim(k_dst) END || ':' || CAST(k_port AS VARCHAR) || '/' || upper(k_proto) AS _target
FROM lab4)"""
    rep_text = f"""CASE WHEN NOT is_anom THEN {{other}}
       WHEN _tl = 'single' THEN concat('This event appears isolated. Only ', CAST(repeat_count AS VARCHAR), ' matching anomalous flow toward ', _target, ' was seen in the last 45 seconds.')
       WHEN _tl = 'repeated' THEN concat('Similar anomalous behavior was seen ', CAST(repeat_count AS VARCHAR), ' times toward ', _target, ' in the last 45 seconds. Repetition makes it more worth checking.')
       ELSE concat('Similar anomalous behavior appears persistent. ', CAST(repeat_count AS VARCHAR), ' matching anomalous flows toward ', _target, ' were seen in the last 45 seconds. Persistent repetition is more concerning than a one-off deviation.') END"""
    t1 = f"""t1 AS (
SELECT *,
  {rep_text.format(other="''")} AS repeat_explanation,
  {rep_text.format(other=q(fixed.NOT_ANOMALOUS_REPEAT))} AS _rep_full,
  list_distinct_ordered AS _dummy
FROM t0)""".replace("  list_distinct_ordered AS _dummy\n", "  NULL AS _dummy\n")
    # adjustment reason text
    reasons_all = ("list_filter(list_concat(list_transform(adjustment_reasons, lambda r: trim(r)), "
                   "[CASE WHEN trim(coalesce(final_severity_reason, '')) <> '' THEN trim(final_severity_reason) END]), "
                   "lambda r: r IS NOT NULL AND r <> '')")
    t2 = f"""t2 AS (
SELECT *, list_filter({reasons_all}, lambda x, i: list_position({reasons_all}, x) = i) AS _clean,
  CASE _raw WHEN 'crit' THEN 3 WHEN 'med' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS _rawnum,
  CASE _fin WHEN 'crit' THEN 3 WHEN 'med' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS _finnum
FROM t1)"""
    t3 = """t3 AS (
SELECT *,
  CASE WHEN _raw = _fin THEN CASE WHEN len(_clean) > 0 THEN 'Technical severity remained at the same visible level after contextual checks: ' || array_to_string(_clean, '; ') || '.'
                                  ELSE 'Technical severity remained unchanged after contextual checks.' END
       WHEN _finnum < _rawnum THEN CASE WHEN len(_clean) > 0 THEN 'Technical severity was reduced after contextual checks: ' || array_to_string(_clean, '; ') || '.'
                                  ELSE 'Technical severity was reduced after contextual checks.' END
       ELSE CASE WHEN len(_clean) > 0 THEN 'Technical severity was increased after contextual checks: ' || array_to_string(_clean, '; ') || '.'
                 ELSE 'Technical severity was increased after contextual checks.' END END AS adjustment_reason
FROM t2)"""
    summary_raw = """trim(CASE _tb WHEN 'ok' THEN 'No operationally relevant anomaly detected.'
    WHEN 'benign' THEN concat('Model flagged the flow (', upper(_raw), '), but context suggests likely benign ', _tc, ' traffic.')
    WHEN 'review' THEN concat('Unusual flow kept for review (', upper(_raw), ' raw', CASE WHEN _fin <> _raw THEN concat(', ', upper(_fin), ' adjusted') ELSE ', still visible' END, ').')
    ELSE concat('High-priority anomalous flow (', upper(_raw), ' raw', CASE WHEN _fin <> _raw THEN concat(', ', upper(_fin), ' adjusted') ELSE '' END, ').') END
  || CASE _tl WHEN 'repeated' THEN ' Seen again recently.' WHEN 'persistent' THEN ' Persistent short-term repetition observed.' ELSE '' END)"""
    t4 = f"""t4 AS (
SELECT *,
  CASE WHEN length({summary_raw}) > 220 THEN rtrim(substring({summary_raw}, 1, 217)) || '...' ELSE {summary_raw} END AS summary,
  CASE _tb WHEN 'ok' THEN 'The model did not detect an operationally meaningful anomaly for this flow.'
    WHEN 'benign' THEN concat('The model flagged this flow at raw severity ', upper(_raw), ', but the surrounding context looks consistent with normal desktop activity, so it is treated as BENIGN.',
                              CASE WHEN _tl IN ('repeated', 'persistent') THEN ' Even so, repeated behavior should still be watched.' ELSE '' END)
    WHEN 'review' THEN concat('The flow was flagged by the model and is not clearly normal, so it remains under REVIEW. The adjusted technical severity is ', upper(_fin), '.',
                              CASE WHEN _tc IN ({_strs(fixed.UNKNOWN_CLASSES)}) THEN ' It is especially worth checking because the traffic category is unknown.' ELSE '' END,
                              CASE _tl WHEN 'repeated' THEN ' Similar behavior was seen again recently.' WHEN 'persistent' THEN ' Similar behavior was persistent in the short-term window.' ELSE '' END)
    ELSE concat('The flow remains CRITICAL after combining the raw anomaly signal with contextual checks. The adjusted technical severity is ', upper(_fin), '.') END AS interpretation,
  CASE WHEN _tb IN ('review', 'critical') THEN
    {_map_case('_tc', fixed.POSSIBLE_EXPLANATIONS, fixed.POSSIBLE_EXPLANATION_DEFAULT)}
    || CASE _tl WHEN 'repeated' THEN ' Similar behavior was seen again recently.' WHEN 'persistent' THEN ' Similar behavior was persistent in the short-term window.' ELSE '' END
    ELSE '' END AS possible_explanation,
  CASE WHEN _tb IN ('review', 'critical') THEN {_map_case('_tc', fixed.WHAT_TO_CHECK, fixed.WHAT_TO_CHECK_DEFAULT)} ELSE '' END AS what_to_check
FROM t3)"""
    p = "CASE WHEN lower(trim(proto)) = '' THEN 'unknown' ELSE lower(trim(proto)) END"
    a = "CASE WHEN lower(trim(app_proto)) = '' THEN 'unknown' ELSE lower(trim(app_proto)) END"
    p_text = f"CASE WHEN {p} IN ('', 'unknown') THEN 'unknown protocol' ELSE upper({p}) END"
    a_text = f"CASE WHEN {a} IN ('', 'unknown', 'failed') THEN '' ELSE upper({a}) END"
    clean_src = "CASE WHEN trim(coalesce(src_ip, '')) = '' THEN 'unknown' ELSE trim(src_ip) END"
    clean_dst = "CASE WHEN trim(coalesce(dest_ip, '')) = '' THEN 'unknown' ELSE trim(dest_ip) END"
    label_text = "CASE _tb WHEN 'ok' THEN 'OK' WHEN 'benign' THEN 'BENIGN' WHEN 'review' THEN 'REVIEW' ELSE 'CRITICAL' END"
    parts = [
        f"concat('The autoencoder assigned anomaly score ', printf('%.6f', coalesce(ae_score, 0.0)), ', which maps to raw severity ', upper(_raw), '. ', {_map_case('_raw', fixed.SCORE_PHRASES, fixed.SCORE_PHRASES['ok'])})",
        f"concat('Flow: ', {clean_src}, coalesce(':' || CAST(_sp AS VARCHAR), ''), ' -> ', {clean_dst}, coalesce(':' || CAST(_dp AS VARCHAR), ''), '.')",
        f"CASE WHEN {a_text} <> '' AND {a_text} <> {p_text} THEN concat('Protocol context: ', {p_text}, ' / ', {a_text}, '.') ELSE concat('Protocol context: ', {p_text}, '.') END",
        f"concat('Traffic class: ', _tc, '. ', {_map_case('_tc', fixed.CLASS_PHRASES, fixed.CLASS_PHRASE_DEFAULT)})",
        f"CASE WHEN _dp IS NULL THEN 'The destination port is not available.' WHEN common_desktop OR coalesce(_dp IN ({_ints(fixed.COMMON_DESKTOP_PORTS)}), false) THEN concat('The destination port is ', CAST(_dp AS VARCHAR), ', which is common in routine desktop traffic.') ELSE concat('The destination port is ', CAST(_dp AS VARCHAR), ', which is less typical for routine desktop traffic.') END",
        f"CASE WHEN likely_benign THEN {q(fixed.BENIGN_PHRASE)} END",
        f"concat('After contextual analysis, the adjusted technical severity is ', upper(_fin), ' and the dashboard label is ', {label_text}, '.')",
        "adjustment_reason",
        "concat('Dashboard label reason: ', CASE WHEN trim(coalesce(display_label_reason, '')) = '' THEN 'No extra dashboard-label reason was recorded.' ELSE trim(display_label_reason) END)",
        "_rep_full",
        _map_case("_tb", fixed.LABEL_CLOSING, fixed.LABEL_CLOSING["ok"]),
    ]
    parts_sql = ", ".join(f"CASE WHEN trim({x}) <> '' THEN trim({x}) END" for x in parts)
    t5 = f"""t5 AS (SELECT *, concat_ws(' ', {parts_sql}) AS explanation FROM t4)"""
    return [t0, t1, t2, t3, t4, t5]


def with_layers(layers: list[str], select: str) -> str:
    if not layers:
        return select.strip()
    return "WITH " + ",\n".join(layers) + "\n" + select


def chain(upto: str = "rep2") -> list[str]:
    layers = ev_layers()
    if upto in ("rep2", "ev_base"):
        return layers
    layers = layers + decision_layers()
    if upto == "lab4":
        return layers
    return layers + text_layers()
