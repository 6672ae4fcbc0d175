"""Operator 3: best-fit-decreasing packing of token pieces into sequences.

Pieces of equal length are interchangeable, so the packing is decided on the
counts per length alone: at most ``capacity`` numbers, whatever the corpus.
Lengths are placed from the longest down; a segment tree over remaining
capacities gives the tightest open bin that still fits in O(log capacity).
Bins with the same contents move as one group, which keeps the plan at a few
groups per length. Each piece then finds its place by its rank among the
pieces of its length (binary search in the plan), in parallel.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from flowlens.llm.common import staged, text_of
from flowlens.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: texts given to the encoder at once: as many as it splits and names together
STEP = 400


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which ones have an open
    bin, and the smallest such capacity that is at least x."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.used = np.zeros(2 * self.n, dtype=bool)

    def set(self, capacity: int, there: bool) -> None:
        i = self.n + capacity
        self.used[i] = there
        i //= 2
        while i:
            self.used[i] = self.used[2 * i] | self.used[2 * i + 1]
            i //= 2

    def tightest(self, least: int) -> int:
        """Smallest open capacity >= least, or -1."""
        i = self.n + least
        if i >= 2 * self.n:
            return -1
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY):
    """Best-fit decreasing on counts per length.

    Returns ``(segments, bins)``: ``segments[length]`` lists
    ``(rank, n, first bin, per bin, offset)``: the ``n`` pieces from ``rank`` on
    go to bins from ``first bin`` on, ``per bin`` in a row in each, from
    ``offset`` on. The result is that of placing piece by piece.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, deque] = defaultdict(deque)  # remaining -> groups (first bin, bins)
    segments: dict[int, list] = {}
    bins = 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining:
            if not open_bins[remaining]:
                tree.set(remaining, True)
            open_bins[remaining].append((first, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left, rank, out = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first = capacity, bins
                have = -(-left // (capacity // length))
                bins += have
            else:
                first, have = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            # the bin just used stays the tightest as long as another one fits
            each = room // length
            full = min(have, left // each)
            if full:
                out.append((rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < have and left:  # left < each: one bin gets the rest
                out.append((rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < have:
                put(room, first + full, have - full)
        segments[length] = out
    return segments, bins


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of every document: ``key, piece, start, length, ids`` (ids as
    little-endian unsigned 32-bit integers) and ``_task, _rank``, the task and
    the piece's rank among the task's pieces of its length. A document is its
    ids and then ``end_id``; null text is empty. Only a document longer than
    ``capacity`` is cut; its first piece is then the shorter one."""
    src = docs.select(F.col(key).alias("_key"), text_of(docs, text).alias("_text"))
    kind = src.schema["_key"].dataType
    schema = StructType([StructField("_key", kind), StructField("piece", IntegerType()),
                         StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids", BinaryType()), StructField("_task", IntegerType()),
                         StructField("_rank", LongType())])

    def run(batches):
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                rows: list[tuple] = []
                at: list[int] = []
                for row, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    a, b, piece = 0, (n - 1) % capacity + 1, 0
                    while a < n:
                        rows.append((piece, a, b - a, ids[4 * a:4 * b], int(seen[b - a])))
                        at.append(row)
                        seen[b - a] += 1
                        a, b, piece = b, b + capacity, piece + 1
                piece, start, length, ids, rank = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64())],
                    names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema).withColumnRenamed("_key", key)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to the rows of ``pieces`` (which must come from
    a written table, so that ranks stay what they were) and drops the helpers.

    The driver sees one count per length. A piece's rank among all of its
    length is its rank in its task plus the counts of earlier tasks, joined on
    (task, length); all rows of one task and length are a small group.
    """
    own = cut.groupBy("_task", "length").agg(F.max("_rank").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select(F.col("_task").alias("_t"), F.col("length").alias("_l"),
                      F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_base"))
    totals = own.groupBy("length").agg(F.sum(F.col("_n") + 1).alias("n"))
    segments, _ = plan({r["length"]: r["n"] for r in totals.collect()}, capacity)  # at most `capacity` rows
    steps = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*s)) for x, s in segments.items()}
    ranked = (cut.join(base, (cut["_task"] == base["_t"]) & (cut["length"] == base["_l"]))
              .drop("_t", "_l"))
    keep = [c for c in cut.columns if c not in ("_task", "_rank", "sequence_id", "offset")]
    src = ranked.select(*keep, (F.col("_base") + F.col("_rank")).alias("_at"))
    schema = StructType([*[src.schema[c] for c in keep], StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])

    def run(batches):
        for batch in batches:
            length = batch.column(keep.index("length")).to_numpy()
            at = batch.column(len(keep)).to_numpy()
            seq, off = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                rank, _, first, each, begin = steps[int(x)]
                k = np.searchsorted(rank, at[mine], side="right") - 1
                d = at[mine] - rank[k]
                seq[mine] = first[k] + d // each[k]
                off[mine] = begin[k] + d % each[k] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)],
                                             names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """All documents packed: one row per piece with its ids and its place.

    Pieces are written to the shared folder once. Repeated rows are packed
    each; an empty table gives an empty result; extra columns are dropped.
    """
    return pack(staged(pieces(docs, vocabulary, capacity, end_id, text, key), "pieces"), capacity)
