import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType()), StructField("_text", StringType()),
                   StructField("n_words", StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """documents (with two columns whose names the operators also use) from texts."""
    def build(texts, ids=None, parts=5):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), "mine", "own") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)
    return build


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, junk, null, empty and long ones."""
    rng = random.Random(11)
    out = [None, "", "   \n", "one", "One", "a b c", prose(rng, 6000)]
    base = [prose(rng, rng.randint(30, 200)) for _ in range(25)]
    out += base + base[:4] + base[:2]
    for t in base[:10]:
        for _ in range(rng.randint(1, 3)):
            w = t.split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(["x", "yy", "changed"])
            out.append(" ".join(w))
    passage = prose(rng, 90)
    out += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 50) for _ in range(12)]
    out += ["ab" * 300, "a" * 500, "a" * 199, "a" * 200, base[3].upper(), out[6][100:2000]]
    return out
