import hashlib
import re

import pytest

from flowlens.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for a in range(max(1, len(v) - window + 1) if v else 0):
            part = v[a:a + window]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.update(() if key is None else [str(key)])
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(0, " ".join(f"q{i}" for i in range(30))), (1, "short item here"), (2, None), (3, "..."), (4, "Short ITEM, here!"),
         (10, "é " + " ".join(f"q{i}" for i in range(5, 20))), (None, "no key at all"), (7, "")]


def texts():
    q = [f"q{i}" for i in range(30)]
    return [None, "", "...", " ".join(q), "x " * 400 + " ".join(q[3:18]) + " y" * 10, " ".join(q[:12]),
            "A Short-Item here, and short item here", "shortitem here", " ".join(q[5:20]) + " É " + ", ".join(q[5:19]),
            "é " + "; ".join(q[5:20]).upper(), "w " * 20000 + "short item here", "here short item", "there is NO KEY, at all", "no key at all short item here"]


@pytest.mark.parametrize("block,together", [(1 << 20, 16), (40, 16), (40, 2)])
def test_equals_brute_force(spark, make, monkeypatch, block, together):
    monkeypatch.setattr(D, "TOGETHER", together)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.scan(make(texts()), bench, block_bytes=block).collect()
    for r in rows:
        t = texts()[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(t, ITEMS)
        raw = (t or "").encode()
        spans = [words(raw[a:b].decode()) for a, b in r["hit_bytes"]]
        assert [words(t)[a:b] for a, b in r["hit_words"]] == spans


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(make([]), none).collect() == []
    assert {r["n_hit"] for r in D.scan(make(["a b", None]), none).collect()} == {0}


def test_many_blocks_have_the_plan_of_a_few(spark, make):
    bench = spark.createDataFrame([(i, f"item number {i} of the benchmark") for i in range(200)], "item_id long, text string")
    found = D.scan(make(["item number 7 of the benchmark", "nothing"]), bench, block_bytes=60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= D.TOGETHER + 1
    assert {r["doc_id"]: r["n_items"] for r in found.collect()} == {0: 1, 1: 0}


def test_a_task_needs_one_python_worker(spark, make):
    """Each Python step of a stage is a worker process of its own in every task."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1 << 20, 40):  # one block, several
        plan = D.scan(make(texts()), bench, block_bytes=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
