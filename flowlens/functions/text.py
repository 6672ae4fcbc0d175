"""Report text columns, built from the decision columns.

Text is the last stage of the alert job; all phrases are fixed values from
``fixed`` and the assembly is ``concat`` / ``format_string`` / ``when``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .context import low, normalize_severity


def _lit_map(c: Column, table: dict, default: str) -> Column:
    """Constant map lookup (folded to one literal map; small generated code)."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def _class_or_unknown() -> Column:
    return F.col("_t_cls")


def _level() -> Column:
    return F.col("_t_lvl")


def _label() -> Column:
    return F.col("_t_lbl")


def _raw_norm() -> Column:
    return F.col("_t_raw")


def _fin_norm() -> Column:
    return F.col("_t_fin")


def with_text_inputs(df: DataFrame) -> DataFrame:
    """Normalised inputs of the text columns, computed once per row."""
    cls = low("traffic_class")
    lvl = low("repeat_level")
    lbl = low("final_label")
    return df.withColumns({
        "_t_cls": F.when(cls == "", F.lit("unknown")).otherwise(cls),
        "_t_lvl": F.when(lvl == "", F.lit("single")).otherwise(lvl),
        "_t_lbl": (F.when(lbl == "critical", "critical").when(lbl == "benign", "benign")
                   .when(lbl == "ok", "ok").otherwise("review")),
        "_t_raw": normalize_severity("raw_severity"),
        "_t_fin": normalize_severity("final_severity"),
    })


TEXT_HELPERS = ["_t_cls", "_t_lvl", "_t_lbl", "_t_raw", "_t_fin"]


def _sev_display(norm: Column) -> Column:
    return F.upper(norm)


def _clean_ip(c: Column) -> Column:
    v = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(v == "", F.lit("unknown")).otherwise(v)


# ---------------------------------------------------------------------------
# H01 repeat explanation
# ---------------------------------------------------------------------------
def repeat_explanation_expr(anom_text: bool = True) -> Column:
    """Text for anomalous events; non-anomalous rows get the fixed sentence
    (``anom_text=False`` gives '' instead, as stored on the raw event)."""
    key = F.col("repetition_key")
    target = F.concat(_clean_ip(key["dest_ip"]), F.lit(":"), key["dest_port"].cast("string"),
                      F.lit("/"), F.upper(key["proto"]))
    n = F.col("repeat_count").cast("string")
    w = F.col("repeat_window_s").cast("string")
    single = F.concat(F.lit("This event appears isolated. Only "), n,
                      F.lit(" matching anomalous flow toward "), target,
                      F.lit(" was seen in the last "), w, F.lit(" seconds."))
    repeated = F.concat(F.lit("Similar anomalous behavior was seen "), n, F.lit(" times toward "), target,
                        F.lit(" in the last "), w,
                        F.lit(" seconds. Repetition makes it more worth checking."))
    persistent = F.concat(F.lit("Similar anomalous behavior appears persistent. "), n,
                          F.lit(" matching anomalous flows toward "), target,
                          F.lit(" were seen in the last "), w,
                          F.lit(" seconds. Persistent repetition is more concerning than a one-off deviation."))
    lvl = _level()
    text = F.when(lvl == "single", single).when(lvl == "repeated", repeated).otherwise(persistent)
    other = F.lit(fixed.NOT_ANOMALOUS_REPEAT) if anom_text else F.lit("")
    return F.when(F.coalesce(F.col("is_anom"), F.lit(False)), text).otherwise(other)


# ---------------------------------------------------------------------------
# H02 adjustment reason
# ---------------------------------------------------------------------------
def adjustment_reason_expr() -> Column:
    raw = _raw_norm()
    fin = _fin_norm()
    extra = F.trim(F.coalesce(F.col("final_severity_reason"), F.lit("")))
    reasons = F.concat(F.transform(F.col("adjustment_reasons"), lambda r: F.trim(r)),
                       F.array(F.when(extra != "", extra)))
    reasons = F.array_distinct(F.filter(reasons, lambda r: r.isNotNull() & (r != "")))
    joined = F.concat(F.array_join(reasons, "; "), F.lit("."))
    has = F.size(reasons) > 0
    rn, fn = _num(raw), _num(fin)

    def pick(prefix: str, bare: str) -> Column:
        return F.when(has, F.concat(F.lit(prefix), joined)).otherwise(F.lit(bare))

    return (F.when(raw == fin, pick("Technical severity remained at the same visible level after contextual checks: ",
                                    "Technical severity remained unchanged after contextual checks."))
            .when(fn < rn, pick("Technical severity was reduced after contextual checks: ",
                                "Technical severity was reduced after contextual checks."))
            .otherwise(pick("Technical severity was increased after contextual checks: ",
                            "Technical severity was increased after contextual checks.")))


def _num(norm: Column) -> Column:
    return (F.when(norm == "crit", 3).when(norm == "med", 2).when(norm == "warn", 1).otherwise(0))


# ---------------------------------------------------------------------------
# H03 interpretation
# ---------------------------------------------------------------------------
def interpretation_expr() -> Column:
    label = _label()
    raw_t = _sev_display(_raw_norm())
    fin_t = _sev_display(_fin_norm())
    lvl = _level()
    cls = _class_or_unknown()
    benign = F.concat(
        F.lit("The model flagged this flow at raw severity "), raw_t,
        F.lit(", but the surrounding context looks consistent with normal desktop activity, so it is treated as BENIGN."),
        F.when(lvl.isin("repeated", "persistent"),
               F.lit(" Even so, repeated behavior should still be watched.")).otherwise(F.lit("")))
    review = F.concat(
        F.lit("The flow was flagged by the model and is not clearly normal, so it remains under REVIEW. "
              "The adjusted technical severity is "), fin_t, F.lit("."),
        F.when(cls.isin(*fixed.UNKNOWN_CLASSES),
               F.lit(" It is especially worth checking because the traffic category is unknown.")).otherwise(F.lit("")),
        F.when(lvl == "repeated", F.lit(" Similar behavior was seen again recently."))
        .when(lvl == "persistent", F.lit(" Similar behavior was persistent in the short-term window."))
        .otherwise(F.lit("")))
    critical = F.concat(
        F.lit("The flow remains CRITICAL after combining the raw anomaly signal with contextual checks. "
              "The adjusted technical severity is "), fin_t, F.lit("."))
    return (F.when(label == "ok", F.lit("The model did not detect an operationally meaningful anomaly for this flow."))
            .when(label == "benign", benign).when(label == "review", review).otherwise(critical))


# ---------------------------------------------------------------------------
# H04 summary (220 characters at most)
# ---------------------------------------------------------------------------
def summary_expr(limit: int = 220) -> Column:
    label = _label()
    raw_t = _sev_display(_raw_norm())
    fin_t = _sev_display(_fin_norm())
    lvl = _level()
    head = (F.when(label == "ok", F.lit("No operationally relevant anomaly detected."))
            .when(label == "benign",
                  F.concat(F.lit("Model flagged the flow ("), raw_t,
                           F.lit("), but context suggests likely benign "), _class_or_unknown(),
                           F.lit(" traffic.")))
            .when(label == "review",
                  F.concat(F.lit("Unusual flow kept for review ("), raw_t, F.lit(" raw"),
                           F.when(fin_t != raw_t, F.concat(F.lit(", "), fin_t, F.lit(" adjusted")))
                           .otherwise(F.lit(", still visible")), F.lit(").")))
            .otherwise(F.concat(F.lit("High-priority anomalous flow ("), raw_t, F.lit(" raw"),
                                F.when(fin_t != raw_t, F.concat(F.lit(", "), fin_t, F.lit(" adjusted")))
                                .otherwise(F.lit("")), F.lit(")."))))
    tail = (F.when(lvl == "repeated", F.lit(" Seen again recently."))
            .when(lvl == "persistent", F.lit(" Persistent short-term repetition observed."))
            .otherwise(F.lit("")))
    text = F.trim(F.concat(head, tail))
    cut = limit - 3
    return F.when(F.length(text) > limit,
                  F.concat(F.rtrim(F.substring(text, 1, cut)), F.lit("..."))).otherwise(text)


# ---------------------------------------------------------------------------
# H05 full explanation
# ---------------------------------------------------------------------------
def _proto_phrase() -> Column:
    p = low("proto")
    p = F.when(p == "", F.lit("unknown")).otherwise(p)
    a = low("app_proto")
    a = F.when(a == "", F.lit("unknown")).otherwise(a)
    p_text = F.when(p.isin("", "unknown"), F.lit("unknown protocol")).otherwise(F.upper(p))
    a_text = F.when(a.isin("", "unknown", "failed"), F.lit("")).otherwise(F.upper(a))
    return F.when((a_text != "") & (a_text != p_text),
                  F.concat(F.lit("Protocol context: "), p_text, F.lit(" / "), a_text, F.lit(".")))\
        .otherwise(F.concat(F.lit("Protocol context: "), p_text, F.lit(".")))


def _port_phrase(common: Column) -> Column:
    dport = F.col("dest_port").cast("string").try_cast("int")
    in_set = dport.isin(*[F.lit(p) for p in fixed.COMMON_DESKTOP_PORTS])
    d = dport.cast("string")
    return (F.when(dport.isNull(), F.lit("The destination port is not available."))
            .when(common | F.coalesce(in_set, F.lit(False)),
                  F.concat(F.lit("The destination port is "), d,
                           F.lit(", which is common in routine desktop traffic.")))
            .otherwise(F.concat(F.lit("The destination port is "), d,
                                F.lit(", which is less typical for routine desktop traffic."))))


def _flow_text() -> Column:
    sport = F.col("src_port").cast("string").try_cast("int").cast("string")
    dport = F.col("dest_port").cast("string").try_cast("int").cast("string")
    return F.concat(F.lit("Flow: "), _clean_ip(F.col("src_ip")),
                    F.coalesce(F.concat(F.lit(":"), sport), F.lit("")),
                    F.lit(" -> "), _clean_ip(F.col("dest_ip")),
                    F.coalesce(F.concat(F.lit(":"), dport), F.lit("")), F.lit("."))


def explanation_expr() -> Column:
    raw = _raw_norm()
    fin = _fin_norm()
    label = _label()
    cls = _class_or_unknown()
    score = F.coalesce(F.col("ae_score").cast("double"), F.lit(0.0))
    label_text = (F.when(label == "ok", "OK").when(label == "benign", "BENIGN")
                  .when(label == "review", "REVIEW").otherwise("CRITICAL"))
    parts = [
        F.concat(F.lit("The autoencoder assigned anomaly score "), F.format_string("%.6f", score),
                 F.lit(", which maps to raw severity "), F.upper(raw), F.lit(". "),
                 _lit_map(raw, fixed.SCORE_PHRASES, fixed.SCORE_PHRASES["ok"])),
        _flow_text(),
        _proto_phrase(),
        F.concat(F.lit("Traffic class: "), cls, F.lit(". "),
                 _lit_map(cls, fixed.CLASS_PHRASES, fixed.CLASS_PHRASE_DEFAULT)),
        _port_phrase(F.coalesce(F.col("common_desktop"), F.lit(False))),
        F.when(F.coalesce(F.col("likely_benign"), F.lit(False)), F.lit(fixed.BENIGN_PHRASE)),
        F.concat(F.lit("After contextual analysis, the adjusted technical severity is "), F.upper(fin),
                 F.lit(" and the dashboard label is "), label_text, F.lit(".")),
        F.col("adjustment_reason"),
        F.concat(F.lit("Dashboard label reason: "),
                 F.when(F.trim(F.coalesce(F.col("display_label_reason"), F.lit(""))) == "",
                        F.lit("No extra dashboard-label reason was recorded."))
                 .otherwise(F.trim(F.col("display_label_reason")))),
        repeat_explanation_expr(anom_text=True),
        _lit_map(label, fixed.LABEL_CLOSING, fixed.LABEL_CLOSING["ok"]),
    ]
    parts = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return F.concat_ws(" ", *parts)


# ---------------------------------------------------------------------------
# H06 possible explanation / what to check
# ---------------------------------------------------------------------------
def possible_explanation_expr() -> Column:
    cls = _class_or_unknown()
    lvl = _level()
    text = F.concat(_lit_map(cls, fixed.POSSIBLE_EXPLANATIONS, fixed.POSSIBLE_EXPLANATION_DEFAULT),
                    F.when(lvl == "repeated", F.lit(" Similar behavior was seen again recently."))
                    .when(lvl == "persistent", F.lit(" Similar behavior was persistent in the short-term window."))
                    .otherwise(F.lit("")))
    return F.when(_label().isin("review", "critical"), text).otherwise(F.lit(""))


def what_to_check_expr() -> Column:
    cls = _class_or_unknown()
    return F.when(_label().isin("review", "critical"),
                  _lit_map(cls, fixed.WHAT_TO_CHECK, fixed.WHAT_TO_CHECK_DEFAULT)).otherwise(F.lit(""))


# ---------------------------------------------------------------------------
# H07 bundle
# ---------------------------------------------------------------------------
def attach_explanations(df: DataFrame) -> DataFrame:
    out = with_text_inputs(df).withColumns({
        "repeat_explanation": repeat_explanation_expr(anom_text=False),
        "adjustment_reason": adjustment_reason_expr(),
        "summary": summary_expr(),
        "interpretation": interpretation_expr(),
        "possible_explanation": possible_explanation_expr(),
        "what_to_check": what_to_check_expr(),
    })
    out = out.withColumn("explanation", explanation_expr())
    return out.withColumns({"short_summary": F.col("summary"),
                            "full_explanation": F.col("explanation")}).drop(*TEXT_HELPERS)
