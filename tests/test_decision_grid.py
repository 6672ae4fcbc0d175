"""The severity x level x benign x class-group x port grid against a
plain-Python statement of the ladder (SURVEY section 9.4)."""
import itertools

from flowlens.functions import fixed
from flowlens.functions.decision import decide

ORDER = ["OK", "WARN", "MED", "CRIT"]
CLASSES = {"strong": "dns", "soft": "streaming", "other": "remote_access", "unknown": "unknown"}
PORTS = {"common": 443, "uncommon": 4444}


def ladder(raw, level, benign, cls, port):
    r = ORDER.index(raw)
    common = cls in fixed.COMMON_DESKTOP_CLASSES or port in fixed.COMMON_DESKTOP_PORTS
    unknown = cls in fixed.UNKNOWN_CLASSES
    reasons = []
    f = r
    if common and not unknown:
        if cls in fixed.STRONGLY_BENIGN_CLASSES:
            f, why = max(0, r - 2), fixed.REASON_STRONG
        elif cls in fixed.SOFT_BENIGN_CLASSES:
            f, why = max(0, r - 1), fixed.REASON_SOFT
        else:
            f, why = max(0, r - 1), fixed.REASON_KNOWN
        reasons.append(why)
    strong_ld = cls == "local_discovery" and benign
    if level == "persistent" and not strong_ld:
        f = min(3, f + 1)
        reasons.append(fixed.REASON_PERSISTENT)
    cur = ORDER[f]
    anom = raw not in ("OK",)
    odd = unknown or port not in fixed.COMMON_DESKTOP_PORTS
    new = cur
    if anom and level != "single" and not strong_ld:
        esc = ORDER[min(ORDER.index(cur) + 1, 3)]
        if level == "repeated":
            new = cur if benign else (esc if odd else ("WARN" if cur == "OK" else cur))
        else:
            if benign:
                new = "WARN" if cur == "OK" else cur
            elif odd:
                new = {"OK": "MED", "WARN": "CRIT"}.get(cur, esc)
            else:
                new = esc
        if new in ("OK", "WARN"):
            new = "MED"
    fin = new
    if raw == "CRIT" and fin in ("OK", "WARN") and not strong_ld:
        fin = "MED"
    label = {"OK": "OK", "WARN": "BENIGN", "MED": "REVIEW", "CRIT": "CRITICAL"}[fin]
    return cur, fin, label


def test_grid(spark):
    rows, exp = [], {}
    for i, (raw, level, benign, grp, pk) in enumerate(itertools.product(
            ORDER, ["single", "repeated", "persistent"], [True, False], CLASSES, PORTS)):
        cls, port = CLASSES[grp], PORTS[pk]
        rows.append((i, raw, level, benign, cls, port, "TCP", raw != "OK"))
        exp[i] = ladder(raw, level, benign, cls, port)
    assert len(rows) == 192
    df = spark.createDataFrame(rows, "id int, raw_severity string, repeat_level string, likely_benign boolean, "
                                     "traffic_class string, dest_port int, proto string, is_anom boolean")
    for r in decide(df).collect():
        got = (r["final_severity_after_context"], r["final_severity"], r["final_label"])
        assert got == exp[r["id"]], (r["id"], got, exp[r["id"]])
