import zlib

import numpy as np
import pytest

from flowlens.llm import token_store as T
from flowlens.llm.tokens import encoder


def ids_of(text):
    return np.array(encoder(T.VOCABULARY).lib.encode(text or "", add_special_tokens=False).ids + [T.END_ID], dtype="<u4")


def test_round_trip_in_key_order(make, corpus, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 8000)
    ids = [3 * i + 1 for i in range(len(corpus))]
    rows = {r["doc_id"]: r for r in T.stored_documents(make(corpus, ids=ids)).collect()}
    start = 0
    for i, t in sorted(zip(ids, corpus)):
        want = ids_of(t)
        r = rows[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len({r["shard"] for r in rows.values()}) > 1


def test_keyed_access(spark, make, corpus, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 8000)
    monkeypatch.setattr(T, "BUCKET_KEYS", 9)
    path, entries, index, n, width = T.store(make(corpus))
    assert index.count() > 1 and index.agg({"n_keys": "sum"}).first()[0] == len(corpus)
    asked = spark.createDataFrame([(k,) for k in (0, 6, 8, 20, len(corpus) - 1, 10**6, -5)], "doc_id long")
    got = {r["doc_id"]: bytes(r["ids"]) for r in T.fetch(spark, path, index, asked, n, width).collect()}
    assert got == {k: ids_of(corpus[k]).tobytes() for k in (0, 6, 8, 20, len(corpus) - 1)}
    unknown = spark.range(10**6, 10**6 + 3000).withColumnRenamed("id", "doc_id")
    assert T.lookup(index, unknown, n).count() == 0  # turned away by fingerprints


def test_null_and_repeated_keys(make):
    texts = ["a", "b b", None, "c c c", "d", ""]
    got = T.stored_documents(make(texts, ids=[5, None, 5, 2, None, 5], parts=2)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted(
        (str(i), len(ids_of(t))) for i, t in zip([5, None, 5, 2, None, 5], texts))
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_empty_table(make):
    assert T.stored_documents(make([])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys, repeat = np.arange(n, dtype=np.int64) * 7 - 3, np.zeros(n, dtype=np.int64)
    levels = T.perfect_hash(keys, repeat)
    assert sorted(T.perfect_slot(levels, keys, repeat)) == list(range(n))
