"""Operator 7: benchmark decontamination with one Aho-Corasick automaton.

Windows of 13 consecutive normalised words of the benchmark items (a shorter
item is one window) are the patterns; each document is normalised and scanned
once. Matches carry word positions, which are mapped back to byte ranges of
the original text.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import ALNUM_WORDS, RELEASE_FOR_TOKENS, buffer, words

WINDOW = 13
#: normalised bytes of benchmark text that one automaton is built from
BLOCK_BYTES = 1 << 20

#: separators to spaces, A-Z to lower case
_NORMAL = bytes(32 if not ALNUM_WORDS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalise(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the separators."""
    return (text or "").encode("utf-8").translate(_NORMAL).split()


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark as lists of (item, text) of bounded size; items stream past
    the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).alias("k"), text_of(benchmark, text).alias("t")).toLocalIterator():
        n = len(row["t"].encode("utf-8"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["k"], row["t"]))
        size += n
    if block:
        yield block


#: blocks that are scanned in one Python step
TOGETHER = 16

_BUILT: dict[str, object] = {}


def forget() -> None:
    _BUILT.clear()


RELEASE_FOR_TOKENS.append(forget)


def automaton(items: list[tuple], window: int = WINDOW):
    """Aho-Corasick automaton over the windows of some items: pattern -> (words,
    indices of the items). None if no item has a word."""
    import ahocorasick

    found: dict[str, tuple[int, set]] = {}
    for i, (_, text) in enumerate(items):
        w = normalise(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            part = w[a:a + window]
            found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), set()))[1].add(i)
    if not found:
        return None
    out = ahocorasick.Automaton()
    for pattern, (n, of) in found.items():
        out.add_word(pattern, (n, sorted(of)))
    out.make_automaton()
    return out


def _built(group: list[list[tuple]], window: int) -> list:
    """The automata of some blocks, built once per worker process."""
    key = hashlib.sha256(repr((group, window)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()  # one group at a time
        _BUILT[key] = [automaton(items, window) for items in group]
    return _BUILT[key]


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_OWN = [StructField("n_words", LongType()), StructField("hit_words", ArrayType(_SPAN)),
        StructField("hit_items", ArrayType(StringType()))]


def _scan(batches, names: list[str], items: list[tuple], auto, arrow: pa.Schema):
    labels = [None if k is None else str(k) for k, _ in items]
    for batch in batches:
        old = dict(zip(batch.schema.names, batch.columns))
        n_words, hits, found = [], [], []
        for text, runs, keys in zip(old["_text"].to_pylist(), old["hit_words"].to_pylist(),
                                    old["hit_items"].to_pylist()):
            w = normalise(text)
            n_words.append(len(w))
            runs = [(r["start"], r["end"]) for r in runs]
            if auto is not None and w:
                line = f" {b' '.join(w).decode('latin-1')} "
                got = list(auto.iter(line))
                if got:
                    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
                    last = np.searchsorted(spaces, [e for e, _ in got])  # words up to the match's end
                    runs = _merged(runs + [(int(b) - n, int(b)) for b, (_, (n, _)) in zip(last, got)])
                    keys = sorted({*keys, *(labels[i] for _, (_, of) in got for i in of)} - {None})
            hits.append([{"start": a, "end": b} for a, b in runs])
            found.append(keys)
        old |= {"n_words": pa.array(n_words, pa.int64()), "hit_words": pa.array(hits, arrow.field("hit_words").type),
                "hit_items": pa.array(found, arrow.field("hit_items").type)}
        yield pa.RecordBatch.from_arrays([old[n] for n in names], names=names)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id",
         item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words, hit_words`` (merged word ranges inside occurrences,
    from 0, end exclusive), ``hit_items`` (item keys as sorted strings),
    ``n_hit, n_items, items_sha256, contaminated`` (``n_hit > 0`` and
    ``20 * n_hit >= n_words``) and ``hit_bytes`` (the ranges as byte offsets of
    the original UTF-8 text). Such columns of ``docs`` are replaced.

    No shuffle: the benchmark goes to the tasks in blocks of ``block_bytes``, ``TOGETHER``
    of them in one narrow Python step; what they found is written before the next ones. Null or empty text: no words, not
    contaminated. Items of null or empty text, or repeated ones, add no window of their
    own. The windows of an item without an id are hit like others; it is not among
    ``hit_items``. Empty benchmark: nothing is hit.
    """
    made = {"n_words", "hit_words", "hit_items", "n_hit", "n_items", "items_sha256", "contaminated", "hit_bytes",
            "_text"}
    kept = [c for c in docs.columns if c not in made]
    src = docs.select(*kept, text_of(docs, text).alias("_text"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(ArrayType(_SPAN)).alias("hit_words"),
                      F.array().cast(ArrayType(StringType())).alias("hit_items"))
    base = src.schema
    schema = StructType([*[base[c] for c in kept], base["_text"], *_OWN])
    arrow = pa.schema([("hit_words", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                       ("hit_items", pa.list_(pa.string()))])
    left = item_blocks(benchmark, item_key, item_text, block_bytes)
    final = StructType([*[f for f in schema.fields if f.name != "_text"], StructField("hit_bytes", ArrayType(_SPAN))])

    def run(batches, group, last):
        # one Python step: every further one in a task is a worker process of its own
        for items, auto in zip(group, _built(group, window)):
            batches = _scan(batches, schema.names, items, auto, arrow)
        return offsets(batches) if last else batches

    def offsets(batches):
        for batch in batches:
            old = dict(zip(batch.schema.names, batch.columns))
            spans = []
            for t, runs in zip(old.pop("_text").to_pylist(), old["hit_words"].to_pylist()):
                if runs:
                    raw, offs = buffer(pa.array([t]))
                    a, b, _ = words(raw, offs, ALNUM_WORDS)
                    spans.append([{"start": int(a[r["start"]]), "end": int(b[r["end"] - 1])} for r in runs])
                else:
                    spans.append([])
            old["hit_bytes"] = pa.array(spans, arrow.field("hit_words").type)
            yield pa.RecordBatch.from_arrays([old[n] for n in final.names], names=final.names)

    out, group = src, list(islice(left, TOGETHER)) or [[]]
    while group:
        more = list(islice(left, TOGETHER))
        out = out.mapInArrow(lambda it, group=group, last=not more: run(it, group, last), schema if more else final)
        if more:
            out = staged(out, "scanned")
        group = more
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("hit_items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.concat_ws(",", "hit_items"), 256))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(*[c for c in out.columns if c != "hit_bytes"], "hit_bytes")
