import re

import numpy as np
import pytest

from flowlens.llm import near_dedup as N


def sets_of(texts):
    out = []
    for t in texts:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    s, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(s)):
        groups.setdefault(find(i), []).append(ids[i])
    return [(ids[i], len(s[i]), min((k for k in groups[find(i)] if k is not None), default=None)) for i in range(len(s))]


def run(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                   for r in N.near_duplicates(df).collect()), key=str)


def test_equals_brute_force(make, corpus):
    want = sorted(((i, n, c, i == c) for i, n, c in brute(corpus)), key=str)
    assert run(make(corpus)) == want


def test_deeper_regions_keep_the_links(make, corpus, monkeypatch):
    monkeypatch.setattr(N, "REGION", 2)
    want = sorted(((i, n, c, i == c) for i, n, c in brute(corpus)), key=str)
    assert run(make(corpus, parts=9)) == want


def test_chains_and_large_groups(make):
    base = [f"w{i}" for i in range(120)]
    chain = []
    for k in range(30):  # each differs from the next by one word more
        base[(k * 7) % 120] = f"new{k}"
        chain.append(" ".join(base))
    texts = chain + [" ".join(f"z{k}x{i}" for i in range(40)) for k in range(20)] + ["copy this text of six words"] * 50
    want = sorted(((i, n, c, i == c) for i, n, c in brute(texts)), key=str)
    assert run(make(texts, parts=13)) == want


def test_one_appended_word_in_crowded_regions(make):
    base = " ".join(f"w{i}" for i in range(300))
    got = run(make([f"{base} end{k}" for k in range(2000)], parts=7))
    assert [r for r in got if r[3]] == [(0, 297, 0, True)] and {r[2] for r in got} == {0}


def test_links_across_blocks_of_a_split_region(spark, monkeypatch):
    """Components of 5 and 4 and two classes alone share the root values and were dealt
    apart; only one pair over the components links."""
    monkeypatch.setattr(N, "REGION", 2)
    sets = [np.arange(1, 41, dtype=np.uint64) * 1000003 + (k << 40) for k in range(11)]
    for k in range(1, 5):
        sets[k] = np.concatenate([sets[0][:39], sets[k][39:]])
        sets[5 + k] = np.concatenate([sets[5][:39], sets[5 + k][39:]])
    sets[9] = np.concatenate([sets[3][:36], sets[9][36:]])  # links with the first five
    full = [np.unique(s << np.uint64(20)) for s in sets]
    sig = N.signatures(full)
    ids = [bytes([k]) for k in range(11)]
    classes = spark.createDataFrame([(i, len(s), x.tobytes()) for i, s, x in zip(ids, full, sig)],
                                    "digest binary, n long, signature binary")
    rows = [(i, s.tobytes(), np.unique((s >> np.uint64(32)).astype("<u4")).tobytes()) for i, s in zip(ids, full)]
    sets_df = spark.createDataFrame(rows, "digest binary, shingles binary, short binary")
    regions = spark.createDataFrame([(0, b"12345678" + bytes([5, k]), 0, i) for k, i in enumerate(ids)],
                                    "tree int, region binary, deal int, digest binary")
    parts = spark.createDataFrame([(ids[k], ids[0] if k < 5 else ids[5]) for k in range(9)], "node binary, root binary")
    told = N._across(regions, classes, sets_df, parts, 75)
    links = {frozenset((bytes(r["u"]), bytes(r["v"]))) for r in N.confirmed(told, sets_df, 75).collect()}
    assert links and all(ids[9] in x and (x - {ids[9]}) <= set(ids[:5]) for x in links)


def test_repeated_and_null_keys(make):
    texts = ["a b c d e f g", "a b c d e f g", "A b c d e f g", None, "q r s", "q r s"]
    got = run(make(texts, ids=[3, 3, None, 9, None, None]))
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (9, 0, 9, True),
                          (None, 1, None, True), (None, 1, None, True)], key=str)


def test_empty_table(make):
    assert run(make([])) == []


@pytest.mark.parametrize("edges", [[], [(b"a", b"b")], [(bytes([i]), bytes([i + 1])) for i in range(40)],
                                   [(b"\x00", bytes([i])) for i in range(1, 30)] + [(b"x", b"y")]])
def test_components(spark, edges):
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "u binary, v binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in N.components(df).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
