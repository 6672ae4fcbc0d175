import hashlib
from collections import Counter

import pytest

from flowlens.llm import suffix_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def run(df, **kw):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
            for r in S.repeated_spans(df, **kw).collect()}


def test_equals_brute_force(make, corpus):
    got = run(make(corpus))
    assert [got[i] for i in range(len(corpus))] == brute(corpus, 200)


@pytest.mark.parametrize("limits", [{"CROWDED_RUN": 2}, {"CROWDED": 2}, {"CROWDED": 1, "CHUNK": 2}, {"RUN": 50}])
def test_crowded_paths_give_the_same(make, corpus, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(S, k, v)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(S)
    try:
        got = run(make(corpus))
    finally:
        cloudpickle.unregister_pickle_by_value(S)
    assert [got[i] for i in range(len(corpus))] == brute(corpus, 200)


def test_short_length_and_repeated_ids(make):
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789", "xxabcdefghijklmnopqrstuv", "abcdefghijklmnopqrstuvwxyz0123456789", None]
    got = S.repeated_spans(make(texts, ids=[7, None, 7, None]), length=20, spread=8, gram=4).collect()
    want = brute(texts, 20)
    assert sorted((r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == sorted(want)
    assert "_text" not in got[0].asDict() and got[0]["lang"] == "en"


def test_empty_table(make):
    assert S.repeated_spans(make([])).collect() == []
