"""Operator 6: sharding by fixed virtual slots.

Records hash by their key into a fixed number of slots; bytes are added up per slot; a
versioned map says which shard owns each slot. Editing the map adds a version: one
more shard takes an even share of slots, and only into itself (``grown``), or slots change
owner until the bytes of the shards are near equal (``rebalanced``). Records never change
slot, and a key alone finds its shard.

By the map of version 0 (slots dealt in turn) the key and the number of shards decide
the shard: law ``key``. By a rebalanced map the bytes are near equal, as far as no slot
is too large: law ``bytes``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from flowlens.llm.common import staged, text_of

SLOTS = 4096
SHARDS = 8
MAP = StructType([StructField("version", IntegerType()), StructField("slot", IntegerType()),
                  StructField("shard", IntegerType())])


def slotted(docs: DataFrame, slots: int = SLOTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, size`` (UTF-8 bytes of the text plus 1; null text: 1), ``text_crc32``
    and the virtual slot of each record, by a hash of its key."""
    t = text_of(docs, text)
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
                       F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(records: DataFrame) -> dict[int, int]:
    """Bytes per slot: at most as many rows as there are slots."""
    return {r["vslot"]: r["b"] for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Slots dealt out in turn, before anything is known of their sizes."""
    return {s: s % shards for s in range(slots)}


def grown(owner: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """The map edited for one more shard: it takes its even share, from every shard in turn the
    last slot that shard still has. No slot moves between the old shards."""
    owner = dict(owner)
    of = [[s for s in sorted(owner) if owner[s] == k] for k in range(shards)]
    for i in range(len(owner) // (shards + 1)):
        most = max(range(shards), key=lambda k: (len(of[k]), -k))
        owner[of[most].pop()] = shards
    return owner


def rebalanced(owner: dict[int, int], sizes: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """The map edited so that shard bytes are near equal.

    Slots of overfull shards (above the mean) are taken off, largest first
    while the shard stays overfull; what was taken goes, largest first, to the
    emptiest shard. Then single moves and swaps between the fullest and the
    emptiest shard are made as long as they narrow the gap. Only slot sizes are
    looked at, so the cost does not depend on the corpus.
    """
    owner = dict(owner)
    load = [0] * shards
    of: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s in sorted(owner):
        owner[s] %= shards
        load[owner[s]] += sizes.get(s, 0)
        of[owner[s]].append((sizes.get(s, 0), s))
    mean = sum(load) / shards
    moved: list[tuple[int, int]] = []
    for k in range(shards):
        for b, s in sorted(of[k], reverse=True):
            if b and load[k] > mean:
                load[k] -= b
                moved.append((b, s))
    heap = [(b, k) for k, b in enumerate(load)]
    heapq.heapify(heap)
    for b, s in sorted(moved, reverse=True):
        least, k = heapq.heappop(heap)
        owner[s] = k
        heapq.heappush(heap, (least + b, k))
    for _ in range(64 * shards):
        load = [0] * shards
        for s, k in owner.items():
            load[k] += sizes.get(s, 0)
        top, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        mine = [(sizes.get(s, 0), s) for s in owner if owner[s] == top and sizes.get(s, 0)]
        theirs = sorted([(sizes.get(s, 0), s) for s in owner if owner[s] == low and sizes.get(s, 0)] + [(0, -1)])
        best = None  # (what is left of the gap, slot out, slot back)
        for b, s in mine:
            for c, r in _near(theirs, b - gap / 2):
                if 0 < b - c < gap:
                    left = abs(gap - 2 * (b - c))
                    if best is None or (left, s, r) < best:
                        best = (left, s, r)
        if best is None:
            break
        owner[best[1]] = low
        if best[2] >= 0:
            owner[best[2]] = top
    return owner


def _near(ordered: list[tuple[int, int]], value: float):
    """The entries just below and above a size."""
    import bisect

    i = bisect.bisect_left(ordered, (value, -1))
    return ordered[max(0, i - 1):i + 1]


def map_table(docs: DataFrame, versions: list[dict[int, int]]) -> DataFrame:
    """The versioned slot-to-shard map as a table (versions from 0)."""
    rows = [(v, s, k) for v, owner in enumerate(versions) for s, k in sorted(owner.items())]
    return docs.sparkSession.createDataFrame(rows, MAP)


_PLACED = ["doc_id", "size", "text_crc32", "vslot", "version", "shard", "grown_shard"]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: numbers from 0 in each shard, by virtual slot and key. Rows are sorted
    over range partitions, numbered within them and moved by the counts of the partitions
    before, so that no task needs a whole shard, slot or key."""
    order = ["shard", "vslot", "doc_id", "text_crc32", "size", "_row"]
    spread = rows.withColumn("_row", F.monotonically_increasing_id())  # parts equal rows; equal, so in any order
    spread = spread.repartitionByRange(*order).sortWithinPartitions(*order).select(*_PLACED)
    schema = StructType([*spread.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    shard_at = _PLACED.index("shard")

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            shard = batch.column(shard_at).to_numpy()
            new = np.ones(n, dtype=bool)
            new[1:] = shard[1:] != shard[:-1]
            new[0] = shard[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            at = np.where(start < 0, np.arange(n) + count, np.arange(n) - start)
            last, count = shard[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(at)],
                                             names=schema.names)

    placed = staged(spread.mapInArrow(run, schema), "placed")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per partition, and one more for each shard that begins within one
    base = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), ["shard", "_part"]).select(
        *_PLACED, (F.col("_base") + F.col("_at")).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, text: str = "text", key: str = "doc_id",
            law: str = "key"):
    """``(rows, map)``: every record with its shard and its place there, and the map with
    version 0 (dealt in turn), 1 (version 0 with one more shard) and 2 (version 0
    rebalanced by bytes).

    ``rows``: ``doc_id, size, text_crc32, vslot, version, shard, grown_shard, slot``, by version 0
    for law ``key`` (``grown_shard``: by version 1) and by version 2 for law ``bytes``
    (``grown_shard`` null). ``slot`` numbers the shard's records gaplessly from 0, by virtual
    slot and then key. Null keys and repeated rows are records like others; all rows of a
    key are in one shard.
    """
    if law not in ("key", "bytes"):
        raise ValueError("law is 'key' or 'bytes'")
    records = slotted(docs, slots, text, key)
    first = first_map(shards, slots)
    versions = [first, grown(first, shards), rebalanced(first, slot_sizes(records), shards)]
    table = staged(map_table(docs, versions), "slot-map")
    used = 0 if law == "key" else 2
    now = table.where(F.col("version") == used).withColumnRenamed("slot", "vslot")
    more = table.where(F.col("version") == 1).select(F.col("slot").alias("vslot"), F.col("shard").alias("grown_shard"))
    owner = now.join(more, "vslot")  # one row per virtual slot: a bounded table
    if law == "bytes":
        owner = owner.withColumn("grown_shard", F.lit(None).cast("int"))
    return _numbered(records.join(F.broadcast(owner), "vslot").select(*_PLACED)), table
