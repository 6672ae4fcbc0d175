"""The registered queries over whole tables, and the pipeline against brute force."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from flowlens.llm import quality_rules as Q
from tests.llm import test_decontaminate as brute_7
from tests.llm import test_near_dedup as brute_9
from tests.llm import test_packing as brute_3
from tests.llm import test_quality_rules as brute_5
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_op2(spark, table):
    from tests.llm.test_suffix_dedup import brute
    keys = sorted(table)
    want = dict(zip(keys, brute([table[k] for k in keys], 200)))
    got = rows_of(spark, "op2_suffix_dedup")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_op5(spark, table):
    for r in rows_of(spark, "op5_quality_rules"):
        want = brute_5.brute(table[r["doc_id"]])[:5]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_op6(spark, table):
    from tests.llm.test_sharding import check
    rows = rows_of(spark, "op6_sharding")
    check(rows, list(table.items()), 8)
    assert all(r["law"] == "key" and r["grown_shard"] in (r["shard"], 8) for r in rows)


def test_op7(spark, table):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for r in rows_of(spark, "op7_decontamination"):
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_7.brute(
            table[r["doc_id"]], items)


def test_op8_and_op10(spark, table):
    import zlib
    from tests.llm.test_token_store import ids_of
    start, want = 0, {}
    for k in sorted(table):
        ids = ids_of(table[k])
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op8_token_store")} == want
    for r in rows_of(spark, "op10_token_counts"):
        n = want[r["doc_id"]][1] - 1
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((table[r["doc_id"]] or "").encode()), n, n > 1024)


def test_op9(spark, table):
    keys = sorted(table)
    want = {i: (n, c, i == c) for i, n, c in brute_9.brute([table[k] for k in keys], keys)}
    got = rows_of(spark, "op9_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def whole_cut(texts, length=200):
    """Texts without the characters that repeated strings cover wholly; None if
    nothing but white space is left of a text that lost something."""
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        at, rest = 0, []
        for c in r.decode():
            n = len(c.encode())
            if not all(gone[at:at + n]):
                rest.append(c)
            at += n
        t = "".join(rest)
        out.append(t if len(t.encode()) == len(r) or t.strip(" \t\n\v\f\r") else None)
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgéh日") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [fresh(rng.randint(55, 300)) for _ in range(60)]
    texts += texts[:6]
    for t in texts[6:16]:
        w = t.split(" ")
        w[3] = "changed"
        texts.append(" ".join(w))
    passage, item = fresh(80), fresh(30)
    texts += [fresh(70) + "\n" + passage + "\n" + fresh(60) for _ in range(5)]
    texts += [fresh(40) + " " + item + " " + fresh(40), fresh(2000) + " " + item]
    texts += [" ".join(w + "***" for w in fresh(80).split(" ")) for _ in range(30)] + [None, "", "few words", prose(rng, 9000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if t and "***" in t else 1, 0) for i, t in enumerate(texts) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(0, item), (1, fresh(20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(enumerate(texts))
    _, rules = Q.judged(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules
    for step, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{step}")
        docs = spark.read.parquet(f"{tmp_path}/out{step}")
        if name == "quality_rules":
            base = {i: brute_5.brute(t) for i, t in now.items()}
            now = {i: t for i, t in now.items() if base[i][0] >= 50 and 2 * base[i][4] <= base[i][0] and "***" not in t}
        elif name == "near_duplicates":
            keys = sorted(now)
            now = {i: now[i] for i, _, c in brute_9.brute([now[k] for k in keys], keys) if i == c}
        elif name == "repeated_passages":
            keys = sorted(now)
            now = {k: t for k, t in zip(keys, whole_cut([now[k] for k in keys])) if t is not None}
        elif name == "decontamination":
            now = {i: t for i, t in now.items() if not brute_7.brute(t, items)[-1]}
        if step < 4:
            assert docs.columns == list(C.COLUMNS)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == now, name
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    want = spark.createDataFrame(sorted(now.items()), "doc_id long, text string")
    from flowlens.llm.packing import packed
    from pyspark.sql import functions as F
    again = packed(want)
    brute_3.check(list(now.items()), again.collect(), 1024)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(cols).collect())) == sorted(
        map(tuple, again.withColumn("ids_crc32", F.crc32("ids")).select(cols).collect()))
    whole = C.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, docs.select(cols).collect()))
    assert whole.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()


def test_pipeline_defined_cases(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(70))
    rows = [(None, good, "en", "s", 1), (7, good, "en", "s", 1), (7, good, "en", "s", 1), (8, None, "en", "s", 0),
            (9, other, None, None, None), (9, other, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()) == [7, 9]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert C.run(spark, f"{tmp_path}/empty").collect() == []


def test_pipeline_keeps_different_texts_under_one_key_and_null(spark):
    rng = random.Random(31)
    fresh = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    alone = [fresh() for _ in range(8)]
    near = fresh()
    rows = [(k, t) for k, t in zip([7, 7, 7, None, None, None, 1, 2], alone)]
    rows += [(7, alone[0]), (None, alone[3]), (7, near + " x"), (7, near + " y"), (None, near), (9, near),
             (None, alone[4] + " z"), (None, " "), (7, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [(r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, SF).collect()]
    kept = [(k, t) for k, t in got if t and t.startswith(near)]
    assert len(kept) == 1 and kept[0] in [(7, near + " x"), (7, near + " y")]
    twins = [(k, t) for k, t in got if t and t.startswith(alone[4])]
    assert len(twins) == 1 and twins[0][0] is None
    rest = [r for r in got if r not in kept and r not in twins]
    want = [(k, t) for k, t in zip([7, 7, 7, None, None, None, 1, 2], alone) if t != alone[4]] + [(None, " "), (7, None)]
    assert sorted(rest, key=str) == sorted(want, key=str)
