import random

import numpy as np
import pyarrow as pa

from flowlens.llm import token_counts as C
from flowlens.llm.tokens import encoder, prefix_bpe

PARTS = ["a", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "'", "''", "é", "ñ", "日本", "<|endoftext|>", "<|endof", "!!!",
         "123", " 12", "ing", " ", "😀", "é", "x" * 30, "    ", "\r\n", "'v", "\x1c", " \x1c", "\xa0"]


def count(text):
    return len(encoder(C.VOCABULARY).lib.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_exact():
    rng = random.Random(5)
    bpe = prefix_bpe(C.VOCABULARY)
    for _ in range(300):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert bpe.counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t


def test_encoder_equals_library():
    rng = random.Random(6)
    enc = encoder(C.VOCABULARY)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    enc.memo.clear()
    assert enc.encode(texts[::-1]) == want[::-1]


def test_documents(make, corpus):
    rows = {r["doc_id"]: r for r in C.prefix_counts(make(corpus)).collect()}
    for i, t in enumerate(corpus):
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"]) == (len((t or "").encode()), count(t or ""))
    assert rows[0]["n_words"] == "own" and "_text" not in rows[0].asDict()


def test_budget_questions(make, corpus):
    stored = C.prefix_counts(make(corpus))
    for r in C.truncations(stored, 40).collect():
        t, k = corpus[r["doc_id"]] or "", r["budget_chars"]
        assert count(t[:k]) <= 40 and all(count(t[:j]) > 40 for j in range(k + 1, min(len(t), k + 60) + 1))
    from pyspark.sql import functions as F
    for r in stored.select("doc_id", C.tokens_of_prefix(25).alias("n"), C.tokens_of_prefix(F.lit(0)).alias("z")).collect():
        t = corpus[r["doc_id"]] or ""
        assert r["z"] == 0 and r["n"] == (count(t[:25]) if len(t) >= 25 else None)


def test_empty_table_and_repeated_rows(make):
    assert C.prefix_counts(make([])).collect() == []
    assert [r["n_tokens"] for r in C.prefix_counts(make(["a b", "a b"], ids=[1, 1])).collect()] == [2, 2]


def test_long_parts_without_a_space():
    bpe = prefix_bpe(C.VOCABULARY)
    for part in ("鿿龘" * 20_000, "😀" * 35_000):
        assert count(part) > 65_535
        for t in (part, "a " + part + " b", part + " b"):
            got = bpe.counts(t)
            assert len(got) == len(t) + 1 and got[-1] == count(t)
            assert [got[k] for k in (1, 999, 16_384)] == [count(t[:k]) for k in (1, 999, 16_384)]


def test_lines_words_and_marks_are_exact():
    rng = random.Random(8)
    bpe = prefix_bpe(C.VOCABULARY)
    parts = ["word", "Ünïcode", "naïve.", "end.\n", "\n", " ", "x?!", "ªº", "ɐɑ", "don't", "n'", "l1", "\n\n", "ß;", "日本.", "a" * 25 + "é" * 9]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9)))
        assert bpe.counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t


def test_lines_share_what_their_words_cost():
    """Words at the ends of lines are not counted anew for every pair of neighbours."""
    bpe = prefix_bpe(C.VOCABULARY)
    bpe.forget()
    words = [chr(97 + i) + "ber" for i in range(20)]
    for a in words:
        for b in words:
            assert bpe.counts(f"x {a}\n{b} y")[-1] == count(f"x {a}\n{b} y")
    assert len(bpe.pieces) <= 2 * len(words) + 1


def test_cuts_encoded_together_and_forgotten(monkeypatch):
    from flowlens.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 60)
    monkeypatch.setattr(tokens, "MEMO_CHARS", 9)
    enc = tokens.Encoder(tokens.vocabulary_path(C.VOCABULARY))
    rng, calls, library = random.Random(4), [], enc._library
    enc._library = lambda texts: calls.append(len(texts)) or library(texts)
    some = ["a", "B", "é", "日本", "'re", "don't", "x.,!", "12", "<|endoftext|>", "<|endo", "\r", "\x1c", "\u00a0", "\x00"]
    cuts = ["".join(rng.choice(some) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    for _ in range(60):
        texts = ["".join(rng.choice(cuts[:40] if rng.random() < 0.7 else cuts) + rng.choice([" "] * 9 + ["\n", "  ", " \n", "\t"])
                         for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 8))]
        assert enc.encode(texts) == library(texts)
        assert len(enc.memo) < 60 + 300 and enc.places <= len(enc.begin)
    # plain new words: one call for all of them, however many, one for the heads and one for whole texts
    calls.clear()
    enc.encode([" ".join(f"word{i},{j}" for j in range(1000)) for i in range(9)])
    assert len(calls) <= 4 and sum(calls) < 60


def test_cuts_asked_for_again_stay(monkeypatch):
    from flowlens.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 100)
    enc = tokens.Encoder(tokens.vocabulary_path(C.VOCABULARY))
    often = [f"often{i}" for i in range(30)]
    for k in range(40):
        texts = [" ".join(["x", *often, *(f"once{k}n{i}" for i in range(20))])]
        assert enc.encode(texts) == enc._library(texts)
        assert k == 0 or all(x in enc.memo for x in often)
        assert len(enc.memo) < 100 + 50


def test_new_words_are_counted_together(monkeypatch):
    """New words take no step of their own: a batch with thousands of them fills one table."""
    from flowlens.llm import tokens

    bpe = prefix_bpe(C.VOCABULARY)
    bpe.forget()
    alone, piece = [], tokens.PrefixBPE.piece
    monkeypatch.setattr(tokens.PrefixBPE, "piece", lambda self, data: alone.append(data) or piece(self, data))
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß日" + "."[:k % 2]) for _ in range(rng.randint(2, 12))) for k in range(3000)]
    batch = pa.record_batch({"_text": ["x " + " ".join(words[i:i + 100]) + "\nend" for i in range(0, 3000, 100)]})
    got = next(C._each([batch], C.VOCABULARY, C._Store())).to_pydict()
    for t, n, stored in zip(batch["_text"].to_pylist(), got["n_tokens"], got["prefix_tokens"]):
        assert n == count(t) and np.frombuffer(stored, dtype="<i4")[:200].tolist() == [count(t[:i]) for i in range(200)]
    assert len(alone) < 10


def test_batches_equal_texts_alone(monkeypatch):
    """Whatever is remembered, forgotten, odd or long: counts of a batch are those of each text."""
    from flowlens.llm import tokens

    for name, value in (("MEMO", 50), ("MEMO_CHARS", 9), ("COUNTED", 300), ("STEP_CHARS", 90)):
        monkeypatch.setattr(tokens, name, value)
    bpe = tokens.PrefixBPE(tokens.vocabulary_path(C.VOCABULARY))
    rng = random.Random(10)
    some = PARTS + ["don't", "'LL", "x'll", "’re", "l1é", "٣", "ǅ", "e\u0301", "\u200b", "\x85", "\u2028", "longer" * 4, "日本" * 30,
                    "###", "\n", "\n\n", " ", " ", " "]
    for k in range(40):
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 12))]
        for t, got in zip(texts, bpe.many(texts), strict=True):
            assert got.dtype == np.dtype("<i4")
            assert got.tolist() == [count(t[:i]) for i in range(len(t) + 1)], t
