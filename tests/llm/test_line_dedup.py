import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.llm import line_dedup

SPACES = " \t\n\v\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, chars=40, documents=5):
    held = defaultdict(list)
    for i, t in rows:
        for key in {lower(x).strip(SPACES) for x in (t or "").split("\n")}:
            held[key].append(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            key = lower(x).strip(SPACES)
            ids = [j for j in held[key] if j is not None]
            top = max(ids) if ids else None
            if len(key) < chars or len(held[key]) < documents or i == top:
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = line_dedup.deduplicated(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("s"))
    return sorted(map(tuple, rows.collect()), key=str)


LONG = "This line has more than forty code points in it, é日"


def test_against_brute_force(make, corpus):
    rng = random.Random(3)
    shared = [LONG + str(k) for k in range(6)] + ["short one", "é" * 40, "é" * 39]
    texts = []
    for t in corpus:
        lines = [] if t is None else t.split("\n")
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(shared)
            lines.insert(rng.randint(0, len(lines)), rng.choice([x, x.upper(), "  " + x, x + "\t\r", "\x0b" + x + " "]))
        texts.append("\n".join(lines) if lines else t)
    got = result(make(texts))
    assert got == brute(list(enumerate(texts)))
    assert sum(r[2] for r in got) > 20


@pytest.mark.parametrize("ids", [[7] * 6, [None] * 6, [1, 2, 2, None, 9, 9], [1, 2, 3, 4, 5, 6]])
def test_repeated_and_null_ids(make, ids):
    texts = [f"{LONG}\nown {k}\n{LONG}" for k in range(5)] + [LONG]
    assert result(make(texts, ids)) == brute(list(zip(ids, texts)))


def test_threshold_and_length(make):
    exact, under = "x" * 40, "y" * 39
    texts = [exact + "\n" + under] * 4
    assert all(r[2] == 0 for r in result(make(texts)))
    assert [r[2] for r in result(make(texts + [exact]))] == [1, 1, 1, 1, 0]


def test_a_third_of_equal_rows_and_a_very_long_text(make):
    long = "\n".join([LONG, "other"] * 40_000)
    texts = [LONG] * 200 + ["alone"] * 300 + [long]
    ids = list(range(500)) + [600]
    got = result(make(texts, ids))
    assert got == brute(list(zip(ids, texts)))
    texts = [LONG + "\nsame"] * 200
    assert result(make(texts, [3] * 200)) == brute([(3, texts[0])] * 200)


def test_empty_table(make):
    assert result(make([])) == []
    assert result(make([None, ""])) == brute([(0, None), (1, "")])


def test_names_are_added_up_before_the_shuffle(make):
    lines = make(["a"]).selectExpr("doc_id as _id", "1L as _a", "2L as _b", "true as new")
    plan = line_dedup.common_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_empty_lines_and_documents_side_by_side(make):
    texts = ["", LONG, "", "", f"\n\n{LONG}\n", None, f"{LONG}\n\n", "\n", f"\r\n{LONG}\r\n", LONG, "x", LONG]
    assert result(make(texts, parts=1)) == brute(list(enumerate(texts)))
    assert result(make(texts, parts=3)) == brute(list(enumerate(texts)))
