"""One literal row per reachable rule of the class / benign tables, in rule order."""
import math

import pytest

from flowlens.functions.context import enrich_context, raw_event, severity_from
from flowlens.sources.bands import bands_from_object

COLS = "src_ip string, src_port int, dest_ip string, dest_port int, proto string, app_proto string, direction string, ae_score double"


def run(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return enrich_context(raw_event(df), keep_helpers=True).collect()


CLASS_CASES = [
    # (row, expected rule class, expected final class, benign)
    (("192.168.1.2", 5000, "8.8.8.8", 53, "UDP", "", "", 9.0), "dns", "dns", True),
    (("8.8.4.4", 5000, "8.8.8.8", 40000, "TCP", "dns", "inbound", 9.0), "dns", "dns", False),
    (("192.168.1.2", 123, "8.8.8.8", 40000, "UDP", "", "", 9.0), "time_sync", "time_sync", True),
    (("8.8.4.4", 5000, "1.1.1.1", 80, "ICMP", "http", "", 9.0), "local_discovery", "local_discovery", True),
    (("8.8.4.4", 5000, "1.1.1.1", 9999, "UDP", "ssdp", "", 9.0), "local_discovery", "local_discovery", True),
    (("8.8.4.4", 5000, "1.1.1.1", 5355, "UDP", "", "", 9.0), "local_discovery", "local_discovery", True),
    (("8.8.4.4", 5000, "239.1.2.3", 9999, "UDP", "", "", 9.0), "local_discovery", "local_discovery", True),
    (("192.168.1.2", 5000, "192.168.1.3", 9999, "UDP", "failed", "", 9.0), "local_discovery", "local_discovery", True),
    (("8.8.4.4", 5000, "1.1.1.1", 22, "TCP", "", "", 9.0), "remote_access", "remote_access", False),
    (("8.8.4.4", 5000, "1.1.1.1", 8080, "TCP", "http", "", 9.0), "web_http", "web_http", False),
    (("192.168.1.2", 5000, "1.1.1.1", 443, "TCP", "", "", 9.0), "web_https", "web_https", True),
    (("8.8.4.4", 5000, "1.1.1.1", 9999, "TCP", "quic", "inbound", 9.0), "web_https", "web_https", False),
    (("8.8.4.4", 5000, "1.1.1.1", 3478, "UDP", "", "", 9.0), "chat_messaging", "chat_messaging", False),
    (("8.8.4.4", 5000, "1.1.1.1", 554, "TCP", "", "", 9.0), "streaming", "streaming", True),
    (("192.168.1.2", 40000, "1.1.1.1", 31337, "TCP", "", "", 9.0), "background_service", "background_service", False),
    (("8.8.4.4", 40000, "1.1.1.1", 700, "TCP", "", "", 9.0), "unknown", "unknown", False),
    # benign-context overrides
    (("127.0.0.1", 40000, "8.8.8.8", 700, "TCP", "", "", 9.0), "unknown", "background_service", True),
    (("8.8.4.4", 40000, "255.255.255.255", 700, "TCP", "", "", 9.0), "local_discovery", "local_discovery", True),
    (("8.8.4.4", 1900, "239.255.255.250", 1900, "UDP", "", "", 9.0), "local_discovery", "local_discovery", True),
]


@pytest.mark.parametrize("row,rule,final,benign", CLASS_CASES)
def test_class_and_context(spark, row, rule, final, benign):
    r = run(spark, [row])[0]
    assert r["_class0"] == rule
    assert r["traffic_class"] == final
    assert r["likely_benign"] is benign


def test_rule_order_dns_before_remote(spark):
    r = run(spark, [("8.8.4.4", 53, "1.1.1.1", 22, "TCP", "", "", 1.0)])[0]
    assert r["_class0"] == "dns"


def test_tags_ordered_distinct(spark):
    r = run(spark, [("192.168.1.2", 5000, "192.168.1.1", 53, "UDP", "dns", "", 2.0)])[0]
    assert r["context_tags"] == ["udp", "dns", "internal", "private_lan"]


def test_direction_normalise(spark):
    rows = [("10.0.0.1", 1, "8.8.8.8", 1, "TCP", "", d, 1.0) for d in ("egress", "ingress", "lan", "", "weird")]
    got = [r["direction_norm"] for r in run(spark, rows)]
    assert got == ["outbound", "inbound", "internal", "outbound", "outbound"]


@pytest.mark.parametrize("score,sev", [(1.4999, "OK"), (1.5, "WARN"), (3.0, "MED"), (7.99, "MED"), (8.0, "CRIT"),
                                       (float("nan"), "CRIT")])
def test_severity_band_edges(spark, score, sev):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(severity_from("s", {"ok": 1.5, "warn": 3.0, "crit": 8.0})).collect()[0][0] == sev


def test_band_shapes(spark):
    assert bands_from_object({"bands": {"ok": 1, "warn": 2, "crit": 3}}) == {"ok": 1.0, "warn": 2.0, "crit": 3.0}
    assert bands_from_object({"threshold": 2}) == {"ok": 2.0, "warn": 3.0, "crit": 4.0}
    assert bands_from_object(0.5) == {"ok": 0.5, "warn": 0.75, "crit": 1.0}
    assert bands_from_object("x") is None
    df = spark.createDataFrame([(1.0,)], "s double")
    assert df.select(severity_from("s", None)).collect()[0][0] == "UNKNOWN"
    assert math.isnan(float("nan"))
