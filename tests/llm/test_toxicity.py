import random

import numpy as np

from flowlens.llm import toxicity as X


def texts_of(rng, n):
    bad = ["grubvex", "snarlop", "miredunk"]
    rows = []
    for _ in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        grade = rng.choice([0, 0, 0, 0, 1, 2, 3])
        for _ in range(grade * 3):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "ing"]))
        rows.append((" ".join(words), grade))
    return rows


def test_held_out_accuracy(spark, make):
    rng = random.Random(9)
    rows = texts_of(rng, 900)
    labels = spark.createDataFrame([(i, int(g > 0)) for i, (_, g) in enumerate(rows[:600])], "doc_id long, toxic int")
    scores, model = X.toxicity(make([t for t, _ in rows]), labels)
    got = {r["doc_id"]: r for r in scores.collect()}
    assert model.held_out["f1"] >= 0.95
    assert sum(got[i]["toxic"] == (rows[i][1] > 0) for i in range(600, 900)) >= 294
    mean = [np.mean([got[i]["expected_severity"] for i in range(900) if rows[i][1] == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[0] < 0.2 and mean[3] > 1.5
    for r in got.values():
        p = [r[f"p_above_{k}"] for k in range(3)]
        assert p == sorted(p, reverse=True) and abs(sum(p) - r["expected_severity"]) < 1e-5


def test_given_grades_and_shared_weights(spark, make):
    rng = random.Random(3)
    rows = texts_of(rng, 400)
    graded = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "doc_id long, grade int")
    model = X.train(make([t for t, _ in rows]), graded)
    assert len(model.weights) == len(model.chosen) <= X.FEATURES
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == 3


def test_gradient_reaches_the_likelihood_optimum():
    # one feature, two grades: the model is a logistic regression with a known optimum
    doc = np.arange(50)
    feature = np.zeros(50, dtype=np.int64)
    grade = np.array([1] * 40 + [0] * 10 + [1] * 10 + [0] * 40)
    w, cuts = X.fit(doc, feature, grade, 1, 2, steps=3000, penalty=0.0)
    assert abs(-cuts[0] - np.log(0.25)) < 0.02 and abs(w[0] - cuts[0] - np.log(4)) < 0.02


def test_defined_results(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores, model = X.toxicity(make([None, "", "a b", "a b"], ids=[None, 1, 2, 2]), none)
    assert model is None and sorted((r["n_words"], r["expected_severity"], r["toxic"]) for r in scores.collect()) == [
        (0, 0.0, False)] * 2 + [(2, 0.0, False)] * 2
    assert X.toxicity(make([]), none)[0].collect() == []
    rows = texts_of(random.Random(9), 300)
    labels = spark.createDataFrame([(i, int(g > 0)) for i, (_, g) in enumerate(rows)] * 2 + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    texts = [t for t, _ in rows] + [None, "", "zz"]
    got = {r["doc_id"]: r for r in X.toxicity(make(texts), labels)[0].collect()}
    assert all(got[k]["expected_severity"] == 0 and not got[k]["toxic"] for k in (300, 301, 302))
