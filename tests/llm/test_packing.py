import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import packing as P
from flowlens.llm.tokens import encoder


def best_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [(room, k) for k, room in enumerate(bins) if room >= x]
        if fit:
            bins[min(fit)[1]] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))] + [1] * rng.randint(0, 9)
    segments, bins = P.plan(dict(Counter(lengths)), capacity)
    fill, places = Counter(), {}
    for x, steps in segments.items():
        ranks = []
        for rank, n, first, each, offset in steps:
            for d in range(n):
                ranks.append(rank + d)
                b, at = first + d // each, offset + d % each * x
                assert places.setdefault((b, at), x) == x
                fill[b] += x
        assert ranks == list(range(Counter(lengths)[x]))
    assert sorted(capacity - fill[b] for b in range(bins)) == best_fit_decreasing(lengths, capacity)
    for b in range(bins):  # gapless
        end = 0
        for at in sorted(a for k, a in places if k == b):
            assert at == end
            end += places[b, at]


def check(docs, rows, capacity):
    enc = encoder(P.VOCABULARY)
    want = Counter()
    for i, t in docs:
        ids = enc.lib.encode(t or "", add_special_tokens=False).ids + [P.END_ID]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for a, n in sorted(places):
            assert a == end
            end += n
        assert end <= capacity
    assert len(by) == len(best_fit_decreasing([r["length"] for r in rows], capacity))


def test_documents(make, corpus):
    rows = P.packed(make(corpus)).collect()
    check(list(enumerate(corpus)), rows, 1024)


def test_small_capacity_null_and_repeated_keys(make):
    texts = ["a b c d e f g h i j k", None, "", "x", "x", "word " * 70]
    ids = [1, None, 1, 4, 4, None]
    check(list(zip(ids, texts)), P.packed(make(texts, ids=ids), capacity=16).collect(), 16)


def test_empty_table(make):
    assert P.packed(make([])).collect() == []


def test_the_encoder_gets_as_many_texts_as_it_names_together():
    """Each step of the encoder splits and names the cuts of its texts anew."""
    from flowlens.llm import packing, tokens

    enc, steps = tokens.Encoder(tokens.vocabulary_path(packing.VOCABULARY)), []
    cut = enc._cut
    enc._cut = lambda texts: steps.append(len(texts)) or cut(texts)
    texts = [f"text {i}" for i in range(1000)]
    for i in range(0, len(texts), packing.STEP):
        enc.encode(texts[i:i + packing.STEP])
    assert steps == [400, 400, 200]
