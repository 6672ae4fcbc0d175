"""Operator 2: byte ranges that occur elsewhere, by merged sparse suffix orders.

A byte is removed if a ``LENGTH``-byte string that covers it also starts at
another place of the corpus. Sorting every suffix of the corpus is out of
reach, so suffixes are sparse: the start ``s`` of a string is attached to the
anchor ``a(s)``, the smallest (rightmost of equal ones) hash of ``GRAM`` bytes at
``s .. s + SPREAD - 1``. The anchor depends on the string alone, so equal strings
have their anchors at equal distances, and comparing the suffixes at anchors,
each with the bytes before it, finds every repeated string.

Shards and merge:

* ``shard_runs``: each task sorts its anchors by the name of their first bytes
  (``seed``: bytes every attached string has after the anchor) and of their whole
  reach, and sends equal ones as one row: the shard's sparse order, in which the
  bytes before the anchor play the part of the Burrows-Wheeler column.
* ``merged``: the runs of all shards meet by seed. Equal reaches are repeated
  whole. A seed with several reaches is an interval that has to be refined.
* ``refine``: the suffixes of such intervals stay in the order in which the shards
  delivered them and carry a block number. Blocks are split symbol by symbol,
  forwards along the suffix (the depth of a split is the common prefix) and
  backwards through the preceding bytes; no suffix is sorted again. A string is
  repeated if a block of its depth on both sides has two members.
* Intervals with very many members are split by the names of their strings
  instead, so no group is unbounded.

Names are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField,
                               StructType)

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import Prefix, blocks, buffer

LENGTH = 200
GRAM = 8
SPREAD = 128
#: anchors that a task sorts at once
RUN = 400_000
#: different reaches of one seed in one shard from which the seed counts as crowded
CROWDED_RUN = 64
#: different reaches of one seed that are refined together
CROWDED = 4096
#: rows of refined intervals held at once
CHUNK = 8192

_LOC = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("d", "<i4")])
_WHOLE, _REFINE, _NAMED = 0, 1, 2


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, spread: int, gram: int):
    """Anchors of the documents in one buffer: ``doc, lo, n, d, seed, reach``. The
    ``n`` strings that start at ``lo, lo+1, ...`` of document ``doc`` belong to the
    anchor at ``lo + d``; ``reach`` names all their bytes, ``seed`` those of the
    first ``length - spread + 1`` bytes after the anchor."""
    n = len(raw)
    empty = [np.empty(0, dtype=np.int64)] * 4 + [np.empty(0, dtype=np.uint64)] * 2
    if n < length:
        return empty
    pre = Prefix(raw)
    at = np.arange(n - gram + 1)
    value = pre.window(at, at + gram)
    # hash above, position below (later ones smaller): the minimum names its place
    value = (value & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    least, k = value, 1
    while 2 * k <= spread:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < spread:
        m = len(value) - spread + 1
        least = np.minimum(least[:m], least[spread - k:spread - k + m])
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:], sizes)[:n - length + 1]
    s = np.arange(n - length + 1)
    ok = s + length <= last
    s = s[ok]
    if not len(s):
        return empty
    a = (np.uint64(0xFFFFFFFF) - (least[s] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.empty(len(s), dtype=bool)
    new[0] = True
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    lo, a = s[first], a[first]
    count = np.diff(np.append(first, len(s)))
    doc = np.searchsorted(offsets, lo, side="right") - 1
    return (doc, lo - offsets[doc], count, a - lo, pre.window(a, a + (length - spread + 1)),
            pre.window(lo, lo + count - 1 + length))


_RUN_ROW = StructType([StructField("seed", LongType()), StructField("salt", LongType()),
                       StructField("reach", LongType()), StructField("n", LongType()),
                       StructField("locs", BinaryType())])


def _runs(seed, reach, locs):
    """Rows of one sorted run: equal (seed, reach) as one row with all places;
    seeds with many reaches are dealt by reach, and a row of ``n = 0`` says so
    where the seed's other rows are."""
    order = np.lexsort((reach, seed))
    seed, reach, locs = seed[order], reach[order], locs[order]
    new = np.ones(len(seed), dtype=bool)
    new[1:] = (seed[1:] != seed[:-1]) | (reach[1:] != reach[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(seed)))
    seed, reach = seed[first].view(np.int64), reach[first].view(np.int64)
    names, which, many = np.unique(seed, return_inverse=True, return_counts=True)
    salt = np.where(many[which] >= CROWDED_RUN, reach | 1, 0)
    marks = names[many >= CROWDED_RUN]
    raw, size = locs.tobytes(), _LOC.itemsize
    places = [raw[a * size:(a + k) * size] for a, k in zip(first.tolist(), n.tolist())]
    zero = np.zeros(len(marks), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([seed, marks])), pa.array(np.concatenate([salt, zero])),
         pa.array(np.concatenate([reach, zero])), pa.array(np.concatenate([n, zero])),
         pa.array(places + [b""] * len(marks), pa.binary())], names=_RUN_ROW.names)


def shard_runs(src: DataFrame, length: int, spread: int, gram: int) -> DataFrame:
    """Sorted runs of all shards (one or more per input partition)."""
    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = buffer(batch.column(2))
            for i, j in blocks(offsets):
                doc, lo, n, d, seed, reach = anchors(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i],
                                                     length, spread, gram)
                if not len(doc):
                    continue
                locs = np.empty(len(doc), dtype=_LOC)
                locs["k1"], locs["k2"] = k1[i + doc], k2[i + doc]
                locs["lo"], locs["n"], locs["d"] = lo, n, d
                held.append((seed, reach, locs))
                size += len(doc)
                if size >= RUN:
                    yield _runs(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield _runs(*(np.concatenate(x) for x in zip(*held)))

    return src.select("k1", "k2", "_text").mapInArrow(run, _RUN_ROW)


_MARK = StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("lo", IntegerType()),
                    StructField("n", IntegerType()), StructField("d", IntegerType()),
                    StructField("how", IntegerType()), StructField("seed", LongType())])


def _mark_batch(locs: np.ndarray, how: np.ndarray, seed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.ascontiguousarray(locs[c])) for c in ("k1", "k2", "lo", "n", "d")),
         pa.array(how.astype(np.int32)), pa.array(seed)], names=_MARK.names)


def _complete(batches, same: int, most: int):
    """Sorted batches cut at group borders (a group: equal values of the first
    ``same`` columns). A group of over ``most`` rows comes in parts. Yields (table,
    whether its first group began in an earlier part or goes on in a later one)."""
    held = big = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not held.num_rows:
            continue
        keys = [held.column(k).to_numpy() for k in range(same)]
        first, last = (tuple(k[i] for k in keys) for i in (0, -1))
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(change):
            cut = int(change[-1])
            yield held.slice(0, cut).combine_chunks(), first == big
            held, big, first = held.slice(cut).combine_chunks(), None, last
        if held.num_rows > most:
            yield held, True
            held, big = None, last
    if held is not None and held.num_rows:
        yield held, tuple(held.column(k)[0].as_py() for k in range(same)) == big


def merged(runs: DataFrame) -> DataFrame:
    """Marks of repeated anchors: ``how`` 0: all strings of the anchor are repeated;
    1: to be refined among the anchors of its seed; 2: to be resolved by name."""
    met = runs.repartition("seed", "salt").sortWithinPartitions("seed", "salt", "reach")

    def run(batches):
        for table, in_parts in _complete(batches, 2, 4 * CROWDED):
            seed, salt, reach, n = (table.column(k).to_numpy() for k in range(4))
            locs = table.column(4).combine_chunks()
            rows = len(seed)
            group = np.zeros(rows, dtype=np.int64)
            group[1:] = np.cumsum((seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1]))
            real = n > 0
            step = np.ones(rows, dtype=bool)
            step[1:] = (group[1:] != group[:-1]) | (reach[1:] != reach[:-1]) | (real[1:] != real[:-1])
            of = np.cumsum(step) - 1
            total = np.bincount(of, weights=n).astype(np.int64)[of]
            groups = int(group[-1]) + 1
            reaches = np.bincount(group[step & real], minlength=groups)
            marked = np.bincount(group[~real], minlength=groups) > 0
            crowded = (reaches > CROWDED) | marked
            crowded[0] |= in_parts  # its reaches are not together: they are resolved by name
            crowded = crowded[group] | (salt != 0)
            several = (reaches > 1)[group] | crowded
            whole = real & (total > 1)
            asked = real & step & several
            out = []
            if whole.any():
                pick = np.flatnonzero(whole)
                all_ = np.frombuffer(b"".join(locs.take(pa.array(pick)).to_pylist()), dtype=_LOC)
                out.append(_mark_batch(all_, np.full(len(all_), _WHOLE), np.repeat(seed[pick], n[pick])))
            if asked.any():
                pick = np.flatnonzero(asked)
                ones = np.frombuffer(b"".join(x[:_LOC.itemsize] for x in locs.take(pa.array(pick)).to_pylist()), _LOC)
                out.append(_mark_batch(ones, np.where(crowded[pick], _NAMED, _REFINE), seed[pick]))
            yield from out

    return met.mapInArrow(run, _MARK)


_CONTEXT = StructType([StructField("how", IntegerType()), StructField("name", LongType()),
                       StructField("n", LongType()), StructField("locs", BinaryType()),
                       StructField("bytes", BinaryType())])


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_CONTEXT.names)


def _contexts(batches, names: list[str], length: int):
    """Bytes of the anchors to refine; names of the strings of the crowded ones,
    equal names of a batch in one row."""
    at = {c: names.index(c) for c in ("k1", "k2", "_text", "_marks")}
    for batch in batches:
        rows: list[tuple] = []
        named: list[tuple] = []
        for i in range(batch.num_rows):
            marks = batch.column(at["_marks"])[i].as_py()
            if not marks:
                continue
            text = batch.column(at["_text"])[i].as_py().encode("utf-8")
            k1, k2 = batch.column(at["k1"])[i].as_py(), batch.column(at["k2"])[i].as_py()
            pre = Prefix(np.frombuffer(text, dtype=np.uint8)) if any(m["how"] == _NAMED for m in marks) else None
            for m in marks:
                lo, n = m["lo"], m["n"]
                if m["how"] == _REFINE:
                    loc = np.array([(k1, k2, lo, n, m["d"])], dtype=_LOC).tobytes()
                    rows.append((_REFINE, m["seed"], 1, loc, text[lo:lo + n - 1 + length]))
                else:
                    s = np.arange(lo, lo + n)
                    locs = np.zeros(n, dtype=_LOC)
                    locs["k1"], locs["k2"], locs["lo"], locs["n"] = k1, k2, s, 1
                    named.append((pre.window(s, s + length).view(np.int64), locs))
            if len(rows) >= 2000:
                yield _context_batch(rows)
                rows = []
        if named:
            name, locs = (np.concatenate(x) for x in zip(*named))
            order = np.argsort(name, kind="stable")
            name, locs = name[order], locs[order]
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            n = np.diff(np.append(first, len(name)))
            raw, size = locs.tobytes(), _LOC.itemsize
            for a, k in zip(first.tolist(), n.tolist()):
                rows.append((_NAMED, int(name[a]), k, raw[a * size:(a + k) * size], b""))
                if len(rows) >= 20_000:
                    yield _context_batch(rows)
                    rows = []
        if rows:
            yield _context_batch(rows)


def refine(seed: np.ndarray, locs: np.ndarray, contexts: list[bytes], length: int, spread: int):
    """Repeated strings among anchors of equal seeds: (row, first string, strings)
    for each maximal run. Blocks are refined one byte at a time on either side
    of the anchor."""
    rows, depth = len(seed), length - spread + 1
    d, n = locs["d"].astype(np.int64), locs["n"].astype(np.int64)
    right = np.zeros((rows, length), dtype=np.uint8)
    left = np.zeros((rows, spread), dtype=np.uint8)
    for i, c in enumerate(contexts):
        b = np.frombuffer(c, dtype=np.uint8)
        r = b[d[i]:d[i] + length]
        right[i, :len(r)] = r
        left[i, :d[i]] = b[:d[i]][::-1]
    _, block = np.unique(seed, return_inverse=True)
    for k in range(depth):
        _, block = np.unique(block * 256 + right[:, k], return_inverse=True)
    forward = {depth: block}
    for k in range(depth, length):
        _, block = np.unique(block * 256 + right[:, k], return_inverse=True)
        forward[k + 1] = block
    repeated = np.zeros((rows, spread), dtype=bool)
    back = np.zeros(rows, dtype=np.int64)
    for x in range(spread):  # strings that start x bytes before their anchor
        if x:
            _, back = np.unique(back * 256 + left[:, x - 1], return_inverse=True)
        own = np.flatnonzero((d - n < x) & (x <= d))
        if len(own) > 1:
            _, both, count = np.unique(forward[length - x][own] * np.int64(rows) + back[own], return_inverse=True,
                                       return_counts=True)
            repeated[own, x] = count[both] > 1
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    # distance x counts backwards: the run begin..end-1 starts at the largest x
    return row, locs["lo"][row] + (d[row] - (end - 1)), end - begin


_SPAN = StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("lo", IntegerType()),
                    StructField("n", IntegerType())])


def _span_batch(k1, k2, lo, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k1)), pa.array(np.ascontiguousarray(k2)),
                                       pa.array(np.asarray(lo, dtype=np.int32)),
                                       pa.array(np.asarray(n, dtype=np.int32))], names=_SPAN.names)


def resolved(contexts: DataFrame, length: int, spread: int) -> DataFrame:
    """Repeated strings of refined and of named intervals: ``k1, k2, lo, n``."""
    met = contexts.repartition("how", "name").sortWithinPartitions("how", "name")

    def run(batches):
        last = None  # of the last named group: name, a place of it, whether that was told
        for table, in_parts in _complete(batches, 2, 4 * CHUNK):
            how, name, n = (table.column(k).to_numpy() for k in range(3))
            places = table.column(3).combine_chunks()
            named = np.flatnonzero(how == _NAMED)
            if len(named):
                key = name[named]
                step = np.append(True, key[1:] != key[:-1])
                of = np.cumsum(step) - 1
                total = np.bincount(of, weights=n[named])[of]
                if in_parts and last is not None and last[0] == key[0]:
                    if not last[2]:
                        one = np.frombuffer(last[1], dtype=_LOC)
                        yield _span_batch(one["k1"], one["k2"], one["lo"], one["n"])
                        last = (last[0], last[1], True)
                    total[of == 0] = 2
                hit = named[total > 1]
                if len(hit):
                    all_ = np.frombuffer(b"".join(places.take(pa.array(hit)).to_pylist()), dtype=_LOC)
                    yield _span_batch(all_["k1"], all_["k2"], all_["lo"], all_["n"])
                last = (key[-1], places[int(named[-1])].as_py(), bool(total[-1] > 1))
            todo = np.flatnonzero(how == _REFINE)
            a = 0
            while a < len(todo):  # whole groups, about CHUNK rows at a time
                b = min(len(todo), a + CHUNK)
                while b < len(todo) and name[todo[b]] == name[todo[b - 1]]:
                    b += 1
                pick = todo[a:b]
                locs = np.frombuffer(b"".join(places.take(pa.array(pick)).to_pylist()), dtype=_LOC)
                texts = table.column(4).take(pa.array(pick)).to_pylist()
                row, lo, count = refine(name[pick], locs, texts, length, spread)
                if len(row):
                    yield _span_batch(locs["k1"][row], locs["k2"][row], lo, count)
                a = b

    return met.mapInArrow(run, _SPAN)


def _merge_runs(lo: np.ndarray, hi: np.ndarray):
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return lo[first], hi[np.append(first[1:] - 1, len(hi) - 1)]


_BYTES = StructType([StructField("start", LongType()), StructField("end", LongType())])


def _character_runs(raw: bytes, lo: list[int], hi: list[int]):
    """The runs without the characters that they cover in part."""
    runs = []
    for a, b in zip(lo, hi):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        if b < len(raw):
            while a < b and raw[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            runs.append((a, b))
    return [a for a, _ in runs], [b for _, b in runs]


def repeated_spans(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM, text: str = "text",
                   key: str = "doc_id", characters: bool = False) -> DataFrame:
    """``docs`` without its text plus ``n_bytes, n_removed, spans`` (maximal removed
    byte ranges ``start, end``), ``kept`` (the remaining bytes) and ``kept_sha256``.

    Strings of ``length`` bytes that start at two places (of one document or of
    two) are removed at all of them; nothing spans documents. Null text is
    empty, shorter texts keep all; repeated rows are copies of each other. With
    ``characters`` a character that is covered in part stays, so that what is
    kept is UTF-8 again.
    ``gram <= spread <= length - gram``.
    """
    if not 0 < gram <= spread <= length - gram:
        raise ValueError("gram <= spread <= length - gram is needed")
    made = {"n_bytes", "n_removed", "spans", "kept", "kept_sha256", "k1", "k2", "_text", "_marks", "_spans"}
    kept = [c for c in docs.columns if c != text and c not in made]
    body = text_of(docs, text)
    src = docs.select(*kept, F.xxhash64(F.col(key)).alias("k1"), F.xxhash64(body, F.lit(7)).alias("k2"),
                      body.alias("_text"))
    marks = staged(merged(shard_runs(src, length, spread, gram)), "repeat-marks")
    # the texts are dealt once; both joins below read the same exchange
    dealt = src.repartition("k1", "k2")
    asked = (marks.where(F.col("how") != _WHOLE).groupBy("k1", "k2")
             .agg(F.collect_list(F.struct("lo", "n", "d", "how", "seed")).alias("_marks")))
    open_ = dealt.join(asked.hint("shuffle_hash"), ["k1", "k2"], "left")
    names = open_.columns
    contexts = open_.mapInArrow(lambda it: _contexts(it, names, length), _CONTEXT)
    spans = marks.where(F.col("how") == _WHOLE).select("k1", "k2", "lo", "n").unionByName(
        resolved(contexts, length, spread))
    per = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n")).alias("_spans"))
    joined = dealt.join(per.hint("shuffle_hash"), ["k1", "k2"], "left").select(*kept, "_text", "_spans")
    schema = StructType([*[joined.schema[c] for c in kept], StructField("n_bytes", LongType()),
                         StructField("n_removed", LongType()), StructField("spans", ArrayType(_BYTES)),
                         StructField("kept", BinaryType()), StructField("kept_sha256", StringType())])

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(len(kept)), batch.column(len(kept) + 1)
            for i in range(0, batch.num_rows, 200):
                rows = []
                for t, s in zip(texts.slice(i, 200).to_pylist(), spans.slice(i, 200)):
                    raw = t.encode("utf-8")
                    if not s.is_valid:
                        rows.append((len(raw), 0, [], raw, hashlib.sha256(raw).hexdigest()))
                        continue
                    lo = s.values.field("lo").to_numpy().astype(np.int64)
                    lo, hi = _merge_runs(lo, lo + s.values.field("n").to_numpy() - 1 + length)
                    lo, hi = lo.tolist(), hi.tolist()
                    if characters:
                        lo, hi = _character_runs(raw, lo, hi)
                    rest = b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)]))
                    rows.append((len(raw), len(raw) - len(rest), [{"start": a, "end": b} for a, b in zip(lo, hi)],
                                 rest, hashlib.sha256(rest).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                         pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, 200) for k in range(len(kept))),
                     *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=schema.names)

    return joined.mapInArrow(cut, schema)
