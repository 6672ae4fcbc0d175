"""Plan shape: one exchange for the repetition, top-k for the views, no
row-at-a-time Python in the decision chain, entry contract."""
import __spark_entry__ as entry

from flowlens.operators import views
from flowlens.plans import fixtures
from flowlens.plans.q_decision import _dec, _rep

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repetition_shuffles_no_row_by_key(spark):
    p = plan(_rep(spark, SF))
    assert "repetition_key" not in "".join(x for x in p.split("\n") if "Exchange" in x)
    assert p.count("Window") == 1                # the first rows of each partition only
    assert "BatchEvalPython" not in p            # only Arrow-batched Python (IPv6 scope)


def test_views_are_top_k(spark):
    p = plan(views.recent(_dec(spark, SF), 50))
    assert "TakeOrderedAndProject" in p


def test_flows_prunes_columns(spark):
    p = fixtures.flows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ts:" not in p.split("ReadSchema:")[1].split("\n")[0] if "ReadSchema:" in p else True


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["traffic_class", "raw_severity", "repeat_level", "n"]
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


def test_alert_record_sections(spark):
    """The nested record carries the reference's sections; with the
    throughput option the timing section holds the rolling rate."""
    from flowlens.operators.alerts import assemble_alert, decide_events
    rec = assemble_alert(decide_events(fixtures.prediction_log(spark, SF), with_throughput=True))
    fields = {f.name: f for f in rec.schema.fields}
    for name in ("ts_unix", "flow_id", "raw_severity", "raw_model_flag", "traffic_class", "context_tags",
                 "repetition_key", "final_label", "summary", "explanation", "timing", "model", "debug"):
        assert name in fields, name
    timing = [f.name for f in fields["timing"].dataType.fields]
    assert timing == ["infer_ms", "total_ms", "throughput_fps"]
    row = rec.orderBy("ts_unix").collect()[-1]
    assert row["timing"]["throughput_fps"] > 0 and row["model"]["bands"]["crit"] == 8.0
    assert row["display_label"] == row["final_label"] and row["severity"] == row["final_severity"]


def test_queries_run_their_own_repetition(spark):
    """No query takes over the rows that another one had counted."""
    first, second = _rep(spark, SF), _rep(spark, SF)
    assert not set(first.inputFiles()) & {f for f in second.inputFiles() if "flowlens-repetition" in f}


def test_long_rule_chains_are_not_one_method(spark):
    """The JVM compiles no method of more than 8,000 bytes."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
