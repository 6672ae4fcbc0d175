import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import collocations as C
from flowlens.llm.text import forget


@pytest.fixture(scope="module")
def table(spark):
    def build(rows, parts=5):
        df = spark.createDataFrame([(*r, 1, "own") for r in rows], "lang string, text string, a int, phrase string")
        return df.repartition(parts) if rows else df
    return build


def brute(rows, least, top, share=50):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in some.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rest = []
        for p, a in some.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= share * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            phrase = " ".join(p)
            rest.append((-score, -a, phrase.encode(), (phrase, a, c[p[:k]], c[p[k:]], n[lang], score)))
        out += [(lang, i, *r[-1]) for i, r in enumerate(sorted(rest)[:top], 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


def corpus(seed, docs=60, vocabulary=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abécd日") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(6)]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, weights)[0])
            parts.append(rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "!"]))
        text = "".join(parts)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(table, seed):
    rows = corpus(seed) + [("en", None), (None, ""), ("fr", "only once"), ("en", " ".join(["long text"] * 30_000))]
    want = brute(rows, 3, 25)
    assert result(table(rows), least=3, top=25) == want and len(want) > 60


def test_the_frontier_grows_until_the_last_rank_is_settled(table, monkeypatch):
    monkeypatch.setattr(C, "FIRST", 1)
    monkeypatch.setattr(C, "GROWTH", 2)
    passes = []
    count = C._triple_counts
    monkeypatch.setattr(C, "_triple_counts", lambda *a: passes.append(1) or count(*a))
    rows = corpus(3, 80)
    for least, top in ((2, 12), (3, 1000)):
        assert result(table(rows), least=least, top=top) == brute(rows, least, top)
    assert len(passes) > 2  # two calls


def test_ties_and_dropped_pairs(table):
    rows = [("en", "aa bb cc")] * 12 + [("en", "aa bb")] * 12 + [("en", "aa bb, xx yy; zz xx yy. xx yy")]
    rows += [("de", "b a. d c. f e")] * 10
    want = brute(rows, 10, 2)
    assert result(table(rows), top=2) == want
    assert [r[2] for r in want] == ["b a", "d c", "aa bb cc"] or len(want) >= 3


def test_one_text_is_a_third_of_all_rows(table):
    rows = [("en", "same words again and again")] * 400 + corpus(4, 800, 60)
    assert result(table(rows, 16)) == brute(rows, 10, 2000)


def test_filters_hold_what_was_put_in(spark):
    ids = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(x),) for x in ids], "id long")
    bits = C._Bits(df, "id", len(ids))
    assert bits.has(ids.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 5000).view(np.uint64)
    assert bits.has(others).mean() < 0.1
    assert len(C._Bits(df, "id", 10**12).bits) == 1 << (C.MOST_BITS - 3)


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**12 + 7, 3 * 10**12)], "a long, l long, r long")
    got = df.select(C._score("a", "l", "r")).first()[0]
    assert got == 10**6 * 10**24 // ((10**12 + 7) * 3 * 10**12)


def test_empty_tables(table):
    assert result(table([])) == []
    assert result(table([(None, None), ("en", "one"), ("en", " ., ")])) == []


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows], pa.string())],
                                      names=["lang", "text"])


@pytest.mark.parametrize("texts", [["plain words. " * 20] * 8000, ["plain words. " * 160_000]])
def test_naming_takes_little_memory(texts):
    batch = _batch([("en", t) for t in texts])
    forget()
    tracemalloc.start()
    try:
        found = sum(len(w.ids) for w, _ in C._blocks_of(batch, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == sum(2 * t.count(".") for t in texts)
    assert peak < 40 << 20  # 2 MB of text, a word for each 6.5 bytes


@pytest.mark.parametrize("seed", [5, 6])
def test_names_do_not_depend_on_the_steps(monkeypatch, seed):
    batch = _batch([("en", ""), *corpus(seed), (None, None)])
    monkeypatch.setattr(C, "NAMED", 1 << 30)
    (want, _), = C._blocks_of(batch, seed)
    for step in (1, 7, 100):
        monkeypatch.setattr(C, "NAMED", step)
        (got, _), = C._blocks_of(batch, seed)
        for name in ("starts", "ends", "first", "ids", "linked"):
            assert np.array_equal(getattr(got, name), getattr(want, name))
