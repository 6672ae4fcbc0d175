"""Severity ladder (context adjust, repeat review, display label).

The ladder works on numbers ok 0, warn 1, med 2, crit 3. Each step is a
column expression; ``decide`` chains them with intermediate ``withColumns`` so
no single generated method grows past the codegen limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .context import (common_desktop_expr, escalate_one_level, low, normalize_severity,
                      num_to_severity, severity_num)


def _class_or_unknown(c: str = "traffic_class") -> Column:
    v = low(c)
    return F.when(v == "", F.lit("unknown")).otherwise(v)


def _dport(c: str = "dest_port") -> Column:
    return F.col(c).cast("string").try_cast("int")


def _protocol(c: str = "proto") -> Column:
    v = low(c)
    return F.when(v == "", F.lit("unknown")).otherwise(v)


def _compact(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def adjust_for_context(df: DataFrame) -> DataFrame:
    """Context-adjusted severity -> ``final_severity_after_context``,
    ``adjustment_reasons`` (array), ``common_desktop`` (G08)."""
    cls = _class_or_unknown()
    raw_n = severity_num(normalize_severity("raw_severity"))
    common = common_desktop_expr(cls, _protocol(), _dport())
    unknown = cls.isin(*fixed.UNKNOWN_CLASSES)
    strong = cls.isin(*fixed.STRONGLY_BENIGN_CLASSES)
    soft = cls.isin(*fixed.SOFT_BENIGN_CLASSES)
    lowered = common & ~unknown
    step1 = (F.when(lowered & strong, F.greatest(raw_n - 2, F.lit(0)))
             .when(lowered, F.greatest(raw_n - 1, F.lit(0))).otherwise(raw_n))
    reason1 = (F.when(lowered & strong, F.lit(fixed.REASON_STRONG))
               .when(lowered & soft, F.lit(fixed.REASON_SOFT))
               .when(lowered, F.lit(fixed.REASON_KNOWN)))
    # The "strong local discovery" exemption is defined for every row here
    # (the reading of the intent: local_discovery and likely benign).
    strong_ld = (cls == "local_discovery") & F.coalesce(F.col("likely_benign"), F.lit(False))
    bump = (F.col("repeat_level") == "persistent") & ~strong_ld
    step2 = F.when(bump, F.least(step1 + 1, F.lit(3))).otherwise(step1)
    reason2 = F.when(bump, F.lit(fixed.REASON_PERSISTENT))
    return df.withColumns({
        "common_desktop": common,
        "final_severity_after_context": num_to_severity(step2),
        "adjustment_reasons": _compact(F.array(reason1, reason2)),
    })


def repeat_review(df: DataFrame) -> DataFrame:
    """Repeat review + MED floor -> ``final_severity_review``,
    ``final_severity_reason``, ``final_severity_before_repeat``."""
    cur = F.col("final_severity_after_context")
    level = low("repeat_level")
    benign = F.coalesce(F.col("likely_benign"), F.lit(False))
    cls = low("traffic_class")
    anom = F.coalesce(F.col("is_anom"), F.lit(False))
    dport = _dport()
    unknown = cls.isin("", "unknown", "other", "failed")
    uncommon = dport.isNotNull() & ~dport.isin(*[F.lit(p) for p in fixed.COMMON_DESKTOP_PORTS])
    odd = unknown | uncommon
    strong_ld = (cls == "local_discovery") & benign & ~unknown
    untouched = ~anom | (level == "single")
    active = ~untouched & ~strong_ld

    rep_sev = (F.when(benign, cur).when(odd, escalate_one_level(cur))
               .when(cur == "OK", F.lit("WARN")).otherwise(cur))
    rep_reason = (F.when(benign, F.lit(fixed.REVIEW_REPEATED_BENIGN))
                  .when(odd, F.lit(fixed.REVIEW_REPEATED_UNKNOWN))
                  .when(cur == "OK", F.lit(fixed.REVIEW_REPEATED_OK)))
    per_sev = (F.when(benign, F.when(cur == "OK", F.lit("WARN")).otherwise(cur))
               .when(odd, F.when(cur == "OK", F.lit("MED")).when(cur == "WARN", F.lit("CRIT"))
                     .otherwise(escalate_one_level(cur)))
               .otherwise(escalate_one_level(cur)))
    per_reason = (F.when(benign, F.lit(fixed.REVIEW_PERSISTENT_BENIGN))
                  .when(odd, F.lit(fixed.REVIEW_PERSISTENT_UNKNOWN))
                  .otherwise(F.lit(fixed.REVIEW_PERSISTENT_OTHER)))
    mid_sev = F.when(level == "repeated", rep_sev).otherwise(per_sev)
    mid_reason = F.when(level == "repeated", rep_reason).otherwise(per_reason)
    out = df.withColumns({
        "final_severity_before_repeat": cur,
        "_mid_sev": F.when(active, mid_sev).otherwise(cur),
        "_mid_reason": F.when(active, mid_reason),
        "_active": active,
        "_strong_ld_review": ~untouched & strong_ld,
    })
    floor = F.col("_active") & F.col("_mid_sev").isin("OK", "WARN")
    reason = (F.when(F.col("_strong_ld_review"), F.lit(fixed.REVIEW_LOCAL_DISCOVERY))
              .when(floor, F.concat_ws("; ", F.col("_mid_reason"), F.lit(fixed.REVIEW_FLOOR)))
              .otherwise(F.coalesce(F.col("_mid_reason"), F.lit(""))))
    out = out.withColumns({
        "final_severity_review": F.when(floor, F.lit("MED")).otherwise(F.col("_mid_sev")),
        "final_severity_reason": reason,
    })
    return out.drop("_mid_sev", "_mid_reason", "_active", "_strong_ld_review")


def display_label(df: DataFrame) -> DataFrame:
    """Critical floor, label and its reason -> ``final_severity``,
    ``final_label``, ``display_label_reason``; ``adjustment_reasons`` gains the floor reason."""
    raw = normalize_severity("raw_severity")
    fin = normalize_severity("final_severity_review")
    strong_ld = (low("traffic_class") == "local_discovery") & F.coalesce(F.col("likely_benign"), F.lit(False))
    floor = (raw == "crit") & fin.isin("ok", "warn") & ~strong_ld
    out = df.withColumns({
        "_fin": F.when(floor, F.lit("med")).otherwise(fin),
        "adjustment_reasons": F.when(
            floor, F.concat(F.col("adjustment_reasons"), F.array(F.lit(fixed.REASON_CRIT_FLOOR))))
        .otherwise(F.col("adjustment_reasons")),
        "_raw_u": F.upper(raw),
    })
    fin_u = F.upper(F.col("_fin"))
    label = (F.when(F.col("_fin") == "ok", "OK").when(F.col("_fin") == "warn", "BENIGN")
             .when(F.col("_fin") == "med", "REVIEW").otherwise("CRITICAL"))
    out = out.withColumns({"final_label": label, "final_severity": fin_u})
    cls_text = F.coalesce(F.col("traffic_class").cast("string"), F.lit("traffic"))
    base = (F.when(F.col("final_label") == "OK",
                   F.lit("The raw model score did not cross the anomaly threshold."))
            .when(F.col("final_label") == "BENIGN",
                  F.concat(F.lit("Model flagged the flow ("), F.col("_raw_u"),
                           F.lit("), but context suggests likely benign "), cls_text, F.lit(".")))
            .when(F.col("final_label") == "REVIEW",
                  F.concat(F.lit("Unusual flow kept for review ("), F.col("_raw_u"), F.lit(" raw, "),
                           fin_u, F.lit(" adjusted).")))
            .otherwise(F.concat(F.lit("Critical anomaly detected ("), F.col("_raw_u"), F.lit(" raw, "),
                                fin_u, F.lit(" adjusted), requires immediate attention."))))
    reasons = F.col("adjustment_reasons")
    reason_txt = F.when(F.size(reasons) > 0,
                        F.concat(F.lit(" Reason: "), F.array_join(reasons, ", "), F.lit("."))
                        ).otherwise(F.lit(""))
    out = out.withColumn("display_label_reason", F.concat(base, reason_txt))
    return out.drop("_fin", "_raw_u")


def decide(df: DataFrame) -> DataFrame:
    """G09 -> G11 -> G12 in the reference order (repetition must be attached first)."""
    return display_label(repeat_review(adjust_for_context(df)))
