"""Address scopes equal Python's ipaddress for IPv4 (Catalyst path) and IPv6 (both in Catalyst)."""
import ipaddress

from flowlens.functions.ipscope import SCOPE_FIELDS, annotate_ip_scope

ADDRS = [
    "10.0.0.1", "9.255.255.255", "11.0.0.0", "127.0.0.1", "128.0.0.1", "169.254.3.4", "169.255.0.1",
    "172.16.0.1", "172.31.255.255", "172.32.0.0", "192.168.1.10", "192.169.0.1", "192.0.0.9", "192.0.0.10",
    "192.0.0.8", "192.0.0.170", "192.0.0.171", "192.0.0.172", "192.0.2.5", "198.18.0.1", "198.20.0.1",
    "198.51.100.7", "203.0.113.9", "100.64.0.1", "224.0.0.251", "239.255.255.250", "240.0.0.1",
    "255.255.255.255", "0.0.0.0", "0.1.2.3", "8.8.8.8", "1.1.1.1", "01.2.3.4", "256.1.1.1", "1.2.3",
    " 10.0.0.1", "", "junk", "::1", "::", "fe80::1", "fc00::1", "fd12::3", "ff02::fb", "::ffff:10.0.0.1",
    "::ffff:8.8.8.8", "2002::1", "2001:db8::1", "2a00:1450::1", "64:ff9b:1::5", "gggg::1",
]

from flowlens.functions import ipscope


def _expected(a):
    try:
        ip = ipaddress.ip_address(a)
    except ValueError:
        return (False,) * 5
    return (ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_multicast, ip.is_unspecified)


def test_scope_matches_ipaddress(spark):
    df = spark.createDataFrame([(a,) for a in ADDRS], "addr string")
    out = annotate_ip_scope(df, ["addr"]).collect()
    for r in out:
        got = tuple(r[f"addr_{f}"] for f in SCOPE_FIELDS)
        assert got == _expected(r["addr"]), r["addr"]
        assert r["addr_broadcast"] == (r["addr"].strip() == "255.255.255.255")


def test_null_address(spark):
    df = spark.createDataFrame([(None,)], "addr string")
    r = annotate_ip_scope(df, ["addr"]).collect()[0]
    assert not any(r[f"addr_{f}"] for f in SCOPE_FIELDS)


def test_ipv6_equals_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(6)
    texts = ["::", "::1", ":::", "::1::", ":1::", "1:", "1::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:10.0.0.1",
             "::ffff:8.8.8.8", "::ffff:127.0.0.1", "::ffff:0.0.0.0", "::ffff:a00:1", "::10.0.0.1", "::ffff:10.0.0.256", "1.2.3.4::",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:1.2.3.4",
             "12345::", "g::", "2001:1::1", "2001:1::3", "2001:20::5", "2001:db8::", "2002:1::", "2003::", "64:ff9b:1::7",
             "100::1", "fc00::", "fdff:ffff::", "fe80::", "febf::1", "fec0::", "ff02::fb", "FF02::FB", "a:b", ":", "", " ::1"]
    for _ in range(1500):
        n = rng.getrandbits(128) if rng.random() < 0.5 else rng.choice([0x2001, 0xfe80, 0xff02, 0xfc00, 0]) << 112 | rng.getrandbits(
            rng.choice([4, 32, 100]))
        t = str(ipaddress.IPv6Address(n))
        t = rng.choice([t, t.upper(), ipaddress.IPv6Address(n).exploded])
        if rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice([":", "::", "", "0", "f", ".", "g"]) + t[k + 1:]
        texts.append(t)

    def want(t):
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            return (False,) * 5
        return ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_multicast, ip.is_unspecified

    df = spark.createDataFrame([(t,) for t in texts], "a string")
    out = ipscope.with_ip_scope(df, "a", "s")
    wrong = [(r["a"], tuple(r["s"]), want(r["a"])) for r in out.collect() if tuple(r["s"]) != want(r["a"])]
    assert not wrong, wrong[:5]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
