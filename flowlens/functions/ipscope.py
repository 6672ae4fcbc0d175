"""Address scope flags as column expressions.

Both kinds of address are decided in Catalyst. A dotted quad is validated and turned
into a BIGINT, an IPv6 address (with ``::``, an IPv4 ending or a zone) into its 32
hexadecimal digits, whose order as text is that of the numbers; both are compared
against the fixed network ranges. The IPv6 expressions run for text that contains
``:`` only. Anything else has no scope.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SCOPE_FIELDS = ["private", "loopback", "link_local", "multicast", "unspecified"]

_OCTET = r"(0|[1-9][0-9]{0,2})"
IPV4_PATTERN = r"^" + r"\.".join([_OCTET] * 4) + r"$"


def _v4_int(text: str) -> int:
    return int(ipaddress.IPv4Address(text))


def _range(net: tuple[str, int]) -> tuple[int, int]:
    start = _v4_int(net[0])
    return start, start + (1 << (32 - net[1])) - 1


def ipv4_number(addr: Column) -> Column:
    """BIGINT value of a canonical dotted quad, null for anything else."""
    # one validating regex, then a single-character split (no regex groups)
    parts = F.split(addr, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    ok = addr.rlike(IPV4_PATTERN)
    for o in octets:
        ok = ok & (o <= 255)
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ok, value)


_GROUPS = "^([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?$"


def _n_groups(text: Column) -> Column:
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(colons + 1)


def _padded(text: Column) -> Column:
    """Groups of four digits each, without the colons."""
    longer = F.regexp_replace(F.concat(F.lit(":"), text), ":([0-9A-Fa-f]+)", ":000$1")
    return F.when(text == "", text).otherwise(F.regexp_replace(longer, ":[0-9A-Fa-f]*([0-9A-Fa-f]{4})(?=:|$)", "$1"))


def with_ipv6_digits(df, addr_col: str, out_col: str):
    """Add ``out_col``: the 32 lower-case hexadecimal digits of an IPv6 address, null for anything
    else. Done in steps, so that no expression is repeated inside another."""
    addr = F.col(addr_col).cast("string")
    quad, body, left, right = (f"{out_col}_{k}" for k in ("q", "b", "l", "r"))
    zone_ok = ~addr.contains("%") | addr.rlike("^[^%]*%[^%]+$")
    df = df.withColumn(body, F.when(addr.contains(":") & zone_ok, F.substring_index(addr, "%", 1)))
    # an IPv4 ending counts as two groups
    dotted = F.col(body).contains(".")
    df = df.withColumn(quad, ipv4_number(F.when(dotted, F.substring_index(F.col(body), ":", -1))))
    two = F.concat(F.regexp_replace(body, "[^:]*$", ""), F.hex(F.shiftright(quad, 16)), F.lit(":"),
                   F.hex(F.col(quad).bitwiseAND(65535)))
    df = df.withColumn(body, F.when(dotted, two).otherwise(F.col(body)))
    df = df.withColumn(left, F.substring_index(F.col(body), "::", 1))
    short = F.col(body).contains("::")
    df = df.withColumn(right, F.when(short, F.substring(F.col(body), F.length(left) + 3, F.length(body))).otherwise(F.lit("")))
    groups = _n_groups(F.col(left)) + _n_groups(F.col(right))
    ok = F.col(left).rlike(_GROUPS) & F.col(right).rlike(_GROUPS) & F.when(short, groups <= 7).otherwise(groups == 8)
    low, high = _padded(F.col(left)), _padded(F.col(right))
    df = df.withColumn(out_col, F.when(ok, F.concat(low, F.lit(":"), high)))
    zeros = F.repeat(F.lit("0"), F.lit(33) - F.length(out_col))
    return df.withColumn(out_col, F.lower(F.replace(F.col(out_col), F.lit(":"), zeros))).drop(quad, body, left, right)


def _v6_range(net: tuple[str, int]) -> tuple[str, str]:
    start = int(ipaddress.IPv6Address(net[0]))
    return f"{start:032x}", f"{start + (1 << (128 - net[1])) - 1:032x}"


def _scope_sql(n: str, x: str) -> str:
    """Scope struct as one SQL expression (parsed once by Catalyst instead of being assembled call
    by call) over the IPv4 number in column ``n`` and the IPv6 digits in ``x``. An IPv4-mapped
    address, whose number is in ``n`` too, is as private and as much a loopback as that."""
    def v4(net):
        lo, hi = _range(net)
        return f"(`{n}` BETWEEN {lo} AND {hi})"

    def v6(net):
        lo, hi = _v6_range(net)
        return f"(`{x}` BETWEEN '{lo}' AND '{hi}')"

    def v4_any(nets):
        return "(" + " OR ".join(map(v4, nets)) + ")"

    def v6_any(nets):  # a constant list and a lambda: little generated code, and run for IPv6 rows only
        ranges = ", ".join("named_struct('lo', '{}', 'hi', '{}')".format(*_v6_range(net)) for net in nets)
        return f"exists(array({ranges}), r -> `{x}` BETWEEN r.lo AND r.hi)"
    own, mapped = f"`{x}` IS NULL", f"(`{x}` IS NULL OR `{n}` IS NOT NULL)"
    flags = {
        "private": (mapped, f"({v4_any(fixed.IPV4_PRIVATE_NETS)} AND NOT {v4_any(fixed.IPV4_PRIVATE_EXCEPTIONS)})",
                    f"({v6_any(fixed.IPV6_PRIVATE_NETS)} AND NOT {v6_any(fixed.IPV6_PRIVATE_EXCEPTIONS)})"),
        "loopback": (mapped, v4(fixed.IPV4_LOOPBACK_NET), v6((fixed.IPV6_LOOPBACK, 128))),
        "link_local": (own, v4(fixed.IPV4_LINK_LOCAL_NET), v6(fixed.IPV6_LINK_LOCAL_NET)),
        "multicast": (own, v4(fixed.IPV4_MULTICAST_NET), v6(fixed.IPV6_MULTICAST_NET)),
        "unspecified": (own, f"(`{n}` = {_v4_int(fixed.IPV4_UNSPECIFIED)})", v6((fixed.IPV6_UNSPECIFIED, 128))),
    }
    return "named_struct(" + ", ".join(f"'{f}', coalesce(if({c}, {a}, {b}), false)" for f, (c, a, b) in flags.items()) + ")"


def with_ip_scope(df, addr_col: str, out_col: str):
    """Add ``out_col`` = scope struct of ``addr_col`` (parse once, then range tests)."""
    num_col, v6_col = f"_{out_col}_n", f"_{out_col}_v6"
    df = with_ipv6_digits(df.withColumn(num_col, ipv4_number(F.col(addr_col).cast("string"))), addr_col, v6_col)
    lo, hi = _v6_range(fixed.IPV6_MAPPED_NET)
    mapped = F.when(F.col(v6_col).between(lo, hi), F.conv(F.substring(v6_col, 25, 8), 16, 10).cast("bigint"))
    df = df.withColumn(num_col, F.coalesce(num_col, mapped))
    return df.withColumn(out_col, F.expr(_scope_sql(num_col, v6_col))).drop(num_col, v6_col)


def is_broadcast(addr) -> Column:
    a = F.col(addr) if isinstance(addr, str) else addr
    return F.coalesce(F.trim(a.cast("string")) == F.lit(fixed.BROADCAST_ADDRESS), F.lit(False))


def localish(scope: Column) -> Column:
    return scope["private"] | scope["loopback"] | scope["link_local"]


def annotate_ip_scope(df, cols):
    """Add ``<col>_private``, ``<col>_loopback`` ... flag columns for each address column."""
    out = df
    for c in cols:
        out = with_ip_scope(out, c, f"_scope_{c}")
    exprs = {}
    for c in cols:
        for f in SCOPE_FIELDS:
            exprs[f"{c}_{f}"] = F.col(f"_scope_{c}")[f]
        exprs[f"{c}_broadcast"] = is_broadcast(c)
    return out.withColumns(exprs).drop(*[f"_scope_{c}" for c in cols])
