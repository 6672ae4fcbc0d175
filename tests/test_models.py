"""Gradient check, falling loss, scoring shape, isolation-forest properties."""
import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import autoencoder as ae
from flowlens.operators import iforest as iso


def test_gradient_check(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 5))
    ws, bs = ae.init_weights([5, 4, 3, 5], seed=1)
    model = ae.Model([f"f{i}" for i in range(5)], [(f"f{i}", 0.0, 1.0) for i in range(5)], ws, bs)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    loss, grads = ae.gradient_pass(df, model)
    params = ws + bs
    eps = 1e-6
    for p_i in (0, 1, 3, 5):
        idx = tuple(0 for _ in params[p_i].shape)
        old = params[p_i][idx]
        params[p_i][idx] = old + eps
        up = ae.loss_and_grads(x, params[:3], params[3:])[0]
        params[p_i][idx] = old - eps
        down = ae.loss_and_grads(x, params[:3], params[3:])[0]
        params[p_i][idx] = old
        assert abs((up - down) / (2 * eps) - grads[p_i][idx]) < 1e-6
    assert abs(loss - ae.loss_and_grads(x, params[:3], params[3:])[0]) < 1e-12


def test_training_loss_falls_and_scores(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 2))
    x = np.column_stack([base, base @ np.array([[1.0, 2.0], [0.5, -1.0]])])
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    model, hist = ae.train_autoencoder(df, ["a", "b", "c", "d"], "k", hidden=[8, 2, 8], epochs=15, batch=32)
    h = hist.orderBy("epoch").collect()
    assert len(h) == 15 and h[-1]["loss"] < h[0]["loss"]
    scored = ae.score_autoencoder(df, model).collect()
    assert all(r["ae_score"] >= 0 for r in scored)
    top = ae.score_autoencoder_detail(df, model).select(
        ae.top_feature_errors(F.col("ae"), model.features, [F.col(f) for f in model.features], 3).alias("t")).first()
    errs = [t["err"] for t in top["t"]]
    assert errs == sorted(errs, reverse=True) and len(errs) == 3


def test_model_tables_roundtrip(spark, tmp_path):
    ws, bs = ae.init_weights([3, 2, 3], seed=2)
    m = ae.Model(["a", "b", "c"], [("a", 1.0, 2.0), ("b", 0.0, 1.0), ("c", 3.0, 4.0)], ws, bs)
    m.save(spark, str(tmp_path / "m"))
    back = ae.Model.load(spark, str(tmp_path / "m"))
    assert back.features == m.features and np.allclose(back.ws[0], m.ws[0]) and back.scaler == m.scaler


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(2000, 2)).tolist() + [[12.0, 12.0]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k long, a double, b double")
    nodes = iso.train_isolation_forest(df, ["a", "b"], "k", n_trees=50)
    stats = nodes.groupBy("tree").agg(F.max("depth").alias("d"), F.max("size").alias("s")).collect()
    assert len(stats) == 50 and all(r["d"] <= 8 and r["s"] == 256 for r in stats)
    scored = iso.score_isolation_forest(df, nodes, ["a", "b"]).collect()
    s = {r["k"]: r["if_score"] for r in scored}
    assert all(0 < v <= 1 for v in s.values())
    assert s[2000] > np.percentile(list(s.values()), 99.9)
    off = iso.fit_offset(iso.score_isolation_forest(df, nodes, ["a", "b"]), contamination=0.05)
    flagged = iso.decision(iso.score_isolation_forest(df, nodes, ["a", "b"]), off).filter("if_flag = 1").count()
    assert abs(flagged - 0.05 * 2001) <= 3


def test_forest_does_not_depend_on_partitions(spark):
    """Equal rows give the same node table from 4 and from 7 partitions, whether or not the
    thresholds keep all rows."""
    from flowlens.operators import iforest as iso
    rng = np.random.default_rng(3)
    rows = [(int(i), *map(float, x)) for i, x in enumerate(rng.normal(size=(6000, 3)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    for frame, trees in ((df, 2), (df.limit(300), 3)):
        tables = [sorted(map(tuple, iso.train_isolation_forest(frame.repartition(p), ["a", "b", "c"], "k", trees, 64)
                             .select("tree", "node", "feature", F.coalesce(F.nanvl("threshold", F.lit(0.0)), F.lit(0.0)), "size").collect()))
                  for p in (4, 7)]
        assert tables[0] == tables[1] and len({r[0] for r in tables[0]}) == trees


def test_forest_tables_and_preview(spark, tmp_path):
    from flowlens.operators import iforest as iso
    nodes = iso.demo_forest(spark, ["a", "b", "c", "d", "e"])
    iso.save_forest(nodes, str(tmp_path / "f"))
    again = iso.load_forest(spark, str(tmp_path / "f"))
    df = spark.createDataFrame([(i, *[float((i * k) % 5) for k in range(1, 6)]) for i in range(9)],
                               "k long, a double, b double, c double, d double, e double")
    one, two = (iso.preview(df, "k", t, ["a", "b", "c", "d", "e"], -0.5, 4).collect() for t in (nodes, again))
    assert one == two and [r["k"] for r in one] == [0, 1, 2, 3] and "label" not in one[0]
    scaled = iso.preview(df, "k", nodes, ["a", "b", "c", "d", "e"], -0.5, 4, "a",
                         [(c, 1.0, 2.0) for c in "abcde"]).collect()
    assert [r["if_score"] for r in scaled] != [r["if_score"] for r in one]
