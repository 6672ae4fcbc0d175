import random
import re
from collections import Counter

from flowlens.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i:i + 3])] > 1}
    seen, dup, lines = set(), 0, 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            lines += 1
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), lines,
            sum("A" <= c <= "Z" for c in t))


def test_measures_equal_brute_force(make, corpus):
    texts = corpus + ["a b c a b c", "a a a a", "x\n\x0bx\nx\n \n \n", "\x1c a\x85b c #*$%&|<>", "l\nl\nl\n", "日本 É ABC\tdef\r\n"]
    for r in Q.measured(make(texts)).collect():
        assert tuple(int(r[m]) for m in Q.MEASURES) == brute(texts[r["doc_id"]]), r["doc_id"]


def sample(rng, n):
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        bad = rng.random() < 0.2
        if bad and i % 2:
            words = [w + "***" for w in words]
        elif bad:
            words = [w.upper() for w in words]
        texts.append(" ".join(words))
        labels.append((i, 0 if bad else 1))
    return texts, labels


def test_learned_list_on_unseen_documents(spark, make):
    rng = random.Random(4)
    texts, labels = sample(rng, 600)
    known = spark.createDataFrame(labels[:400] + [(5, None), (10**6, 0)], "doc_id long, quality int")
    rows, rules = Q.judged(make(texts), known)
    assert 2 <= len(rules) <= Q.MAX_RULES and all(r.rejected >= Q.PRECISION * (r.rejected + r.kept) for r in rules)
    got = {r["doc_id"]: r["kept"] for r in rows.collect()}
    assert sum(got[i] == bool(q) for i, q in labels[400:]) >= 0.97 * 200


def test_rules_hold_in_order(spark, make):
    rng = random.Random(4)
    texts, labels = sample(rng, 300)
    rows, rules = Q.judged(make(texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    for r in rows.collect():
        v = {"n_words": r["n_words"], "symbols_per_word": r["n_symbols"] / r["n_words"],
             "dup_line_share": r["n_dup_lines"] / r["n_lines"], "repeat_share": r["n_repeat_words"] / r["n_words"],
             "mean_word_chars": r["word_chars"] / r["n_words"], "upper_share": r["n_upper"] / r["word_chars"]}
        first = next((k for k, rule in enumerate(rules, 1) if all(
            (v[t.value] >= t.threshold) == t.above for t in rule.tests)), None)
        assert r["rule"] == first and r["kept"] == (not r["base_failed"] and first is None)


def test_order_of_cells_does_not_matter():
    rng = random.Random(1)
    cells = [{**{f"bin_{n}": rng.randint(0, len(t)) for n, t in Q.GRID.items()}, "fold": rng.randint(0, 2),
              "bad": rng.randint(0, 9), "good": rng.randint(0, 3)} for _ in range(300)]
    one = Q.learn(cells, precision=0.7)
    rng.shuffle(cells)
    assert one and Q.learn(cells, precision=0.7) == one


def test_without_labels_the_base_decides(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows, rules = Q.judged(make([None, "", "w " * 60, " ".join(f"w{i}" for i in range(60)), "few words"],
                                ids=[None, 1, 2, 3, 3]), none)
    assert rules == []
    assert sorted((str(r["doc_id"]), r["base_failed"], r["kept"]) for r in rows.collect()) == [
        ("1", True, False), ("2", True, False), ("3", False, True), ("3", True, False), ("None", True, False)]
    assert Q.judged(make([]), none)[0].collect() == []
