"""Operator 8: token-id files with a minimal perfect hash index.

File format (one shard per file, documents in ascending key order over the
shards in name order): per document a record
``key int64 | repeat uint32 | n uint32 | n ids | 0x0A``, little-endian, ids of 2
bytes where the vocabulary allows it and of 4 otherwise. ``repeat`` counts
documents of one key within the shard from 0; bit 31 of it marks a null key.

The index holds, per hash bucket of keys, a minimal perfect hash function
(levels of collision-free bits, numbered by rank), and in its order a 32-bit
fingerprint, shard, byte offset and id count of each key. A lookup hashes the
key, reads one bit position per level and one slot: constant time, and a key
that was never stored is turned away by its fingerprint.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import mix
from flowlens.llm.tokens import encoder
from flowlens.session import scratch_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: bytes of text, and records, that one shard file is sized for
SHARD_BYTES = 16 << 20
SHARD_ROWS = 200_000
#: keys that one index bucket is sized for
BUCKET_KEYS = 20_000
_NULL = 1 << 31
#: key, repeat and number of ids of a record, and its bytes
_HEAD, _HEAD_BYTES = "<qII", 16


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, text: str = "text",
          key: str = "doc_id", wide: bool = False) -> str:
    """Encode every document, append ``end_id`` and write the shard files.

    Null text is empty, a null key sorts first, repeated keys are kept in input
    order as separate records. ``wide`` forces 4-byte ids. The files go through
    Spark's text writer and its commit protocol, so a retried task leaves
    nothing behind.
    """
    src = docs.select(F.col(key).cast("long").alias("_key"), text_of(docs, text).alias("_text"),
                      F.monotonically_increasing_id().alias("_tie"))
    size = src.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b")).first()
    shards = int(max(1, -(-size["b"] // SHARD_BYTES), -(-size["n"] // SHARD_ROWS)))
    ordered = src.repartitionByRange(shards, "_key", "_tie").sortWithinPartitions("_key", "_tie")

    def run(batches):
        enc = encoder(vocabulary)
        narrow = not wide and enc.vocab_size <= 1 << 16 and end_id < 1 << 16
        end, last, repeat = np.array([end_id], dtype="<u4").tobytes(), object(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 400):
                part = batch.slice(i, 400)
                out = []
                for k, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    repeat, last = (repeat + 1 if k == last else 0), k
                    ids += end
                    head = struct.pack(_HEAD, k or 0, repeat | (_NULL if k is None else 0), len(ids) // 4)
                    if narrow:
                        ids = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
                    out.append(head + ids)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = ordered.mapInArrow(run, StructType([StructField("record", BinaryType())]))
    # the text writer copies the bytes as they are and ends each record with 0x0A
    records.select(F.col("record").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", SHARD_ROWS).text(path)
    return path


def width(vocabulary: str = VOCABULARY, end_id: int = END_ID, wide: bool = False) -> int:
    """Bytes of one stored id."""
    return 2 if not wide and encoder(vocabulary).vocab_size <= 1 << 16 and end_id < 1 << 16 else 4


def shard_number(path: str) -> int:
    """Place of a shard file in the order of the keys."""
    m = re.search(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", path)
    return int(m[1]) << 20 | int(m[2] or 0)


ENTRY = StructType([StructField("doc_id", LongType()), StructField("repeat", LongType()),
                    StructField("shard", LongType()), StructField("offset", LongType()),
                    StructField("n_tokens", LongType()), StructField("before", LongType()),
                    StructField("ids_crc32", LongType())])


def _records(content: memoryview, bytes_per_id: int):
    """(offset, key or None, repeat, ids) of one shard file."""
    at = 0
    while at < len(content):
        key, repeat, n = struct.unpack_from(_HEAD, content, at)
        ids = np.frombuffer(content, dtype=f"<u{bytes_per_id}", count=n, offset=at + _HEAD_BYTES)
        yield at, (None if repeat & _NULL else key), repeat & ~_NULL, ids
        at += _HEAD_BYTES + n * bytes_per_id + 1


def scan(spark: SparkSession, path: str, bytes_per_id: int) -> DataFrame:
    """Read the shard files back: one row per record, ``before`` being the ids of
    the records before it in its shard, ``ids_crc32`` of the ids as unsigned
    32-bit integers. One task holds one shard file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard, before, rows = shard_number(name), 0, []
                for at, key, repeat, ids in _records(memoryview(content.as_buffer()), bytes_per_id):
                    rows.append((key, repeat, shard, at, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, ENTRY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=ENTRY.names)


def _hash(keys: np.ndarray, repeat: np.ndarray, level: int) -> np.ndarray:
    """64-bit hash of (key, repeat) for one level; level 255 gives fingerprints."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    return mix(mix(keys.astype(np.uint64) ^ seed) + repeat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def perfect_hash(keys: np.ndarray, repeat: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash function over distinct keys: a key sits at
    the first level at which no other remaining key shares its bit."""
    levels: list[np.ndarray] = []
    while len(keys):
        size = 2 * len(keys) + 1
        at = _hash(keys, repeat, len(levels)) % np.uint64(size)
        hits = np.bincount(at.astype(np.int64), minlength=size)
        levels.append(hits == 1)
        left = hits[at.astype(np.int64)] > 1
        keys, repeat = keys[left], repeat[left]
        if len(levels) > 250:
            raise ValueError("keys are not distinct")
    return levels


def perfect_slot(levels: list[np.ndarray], keys: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Slot of each key, gapless from 0 for the keys the function was made of; -1
    where every level misses."""
    out = np.full(len(keys), -1, dtype=np.int64)
    before = 0
    for k, bits in enumerate(levels):
        open_ = np.flatnonzero(out < 0)
        at = (_hash(keys[open_], repeat[open_], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before += int(bits.sum())
    return out


_INDEX = StructType([StructField("bucket", LongType()), StructField("n_keys", LongType()),
                     StructField("level_bits", BinaryType()), StructField("bits", BinaryType()),
                     StructField("slots", BinaryType())])
_SLOT = np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("n", "<u4")])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("repeat")), F.lit(buckets))


def build_index(entries: DataFrame, n_keys: int) -> DataFrame:
    """One row per bucket of about ``BUCKET_KEYS`` keys. A key that has records
    in several shards is indexed at the first; null keys are not indexed."""
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    keys = (entries.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "repeat")
            .agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("_at"))
            .select(_bucket(buckets).alias("bucket"), "doc_id", "repeat", "_at.*"))

    def build(table: pa.Table) -> pa.Table:
        key, rep = table["doc_id"].to_numpy(), table["repeat"].to_numpy()
        levels = perfect_hash(key, rep)
        slot = perfect_slot(levels, key, rep)
        slots = np.zeros(len(key), dtype=_SLOT)
        slots["print"][slot] = (_hash(key, rep, 255) >> np.uint64(32)).astype("<u4")
        for name, column in (("shard", "shard"), ("offset", "offset"), ("n", "n_tokens")):
            slots[name][slot] = table[column].to_numpy()
        bits = np.packbits(np.concatenate(levels))
        return pa.table({"bucket": [table["bucket"][0].as_py()], "n_keys": [len(key)],
                         "level_bits": [np.array([len(x) for x in levels], dtype="<i4").tobytes()],
                         "bits": [bits.tobytes()], "slots": [slots.tobytes()]},
                        schema=pa.schema([("bucket", pa.int64()), ("n_keys", pa.int64()),
                                          ("level_bits", pa.binary()), ("bits", pa.binary()),
                                          ("slots", pa.binary())]))

    return keys.groupBy("bucket").applyInArrow(build, _INDEX).withColumn("buckets", F.lit(buckets))


_FOUND = StructType([StructField("doc_id", LongType()), StructField("repeat", LongType()),
                     StructField("shard", LongType()), StructField("offset", LongType()),
                     StructField("n_tokens", LongType())])


def lookup(index: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Keys (``doc_id`` and, optionally, ``repeat``: 0 if absent) -> shard, offset
    and id count. Keys are hashed to their bucket's function; unknown keys (by
    fingerprint) give no row. ``n_keys`` as given to ``build_index``."""
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    rep = F.col("repeat").cast("long") if "repeat" in keys.columns else F.lit(0).cast("long")
    asked = (keys.select(F.col("doc_id").cast("long").alias("doc_id"), rep.alias("repeat"))
             .where(F.col("doc_id").isNotNull()).distinct().withColumn("bucket", _bucket(buckets)))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        key, repeat = left["doc_id"].to_numpy(), left["repeat"].to_numpy()
        out = {n: [] for n in _FOUND.names}
        if right.num_rows and len(key):
            sizes = np.frombuffer(right["level_bits"][0].as_py(), dtype="<i4")
            bits = np.unpackbits(np.frombuffer(right["bits"][0].as_py(), dtype=np.uint8))[:sizes.sum()].astype(bool)
            slots = np.frombuffer(right["slots"][0].as_py(), dtype=_SLOT)
            slot = perfect_slot(np.split(bits, np.cumsum(sizes)[:-1]), key, repeat)
            hit = np.flatnonzero(slot >= 0)
            got = slots[slot[hit]]
            same = got["print"] == (_hash(key[hit], repeat[hit], 255) >> np.uint64(32)).astype("<u4")
            hit, got = hit[same], got[same]
            out = {"doc_id": key[hit], "repeat": repeat[hit], "shard": got["shard"], "offset": got["offset"],
                   "n_tokens": got["n"].astype(np.int64)}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, _FOUND)


def fetch(spark: SparkSession, path: str, index: DataFrame, keys: DataFrame, n_keys: int,
          bytes_per_id: int) -> DataFrame:
    """Keyed access: ``doc_id, repeat, ids`` (unsigned 32-bit little-endian) of the
    given keys, cut out of the shard files at the offsets the index gives. Only
    shards holding an asked key reach a task."""
    places = (lookup(index, keys, n_keys).groupBy("shard")
              .agg(F.collect_list(F.struct("offset", "n_tokens", "doc_id", "repeat")).alias("asked")))
    number = (F.regexp_extract("path", r"part-(\d+)-", 1).cast("long") * F.lit(1 << 20)
              + F.coalesce(F.expr("try_cast(regexp_extract(path, '-c(\\\\d+)[.]txt$', 1) as bigint)"), F.lit(0)))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
             .select(number.alias("shard"), "content"))
    schema = StructType([StructField("doc_id", LongType()), StructField("repeat", LongType()),
                         StructField("ids", BinaryType())])

    def cut(batches):
        for batch in batches:
            for content, asked in zip(batch.column(0), batch.column(1).to_pylist()):
                raw, rows = memoryview(content.as_buffer()), []
                for a in asked:
                    ids = np.frombuffer(raw, dtype=f"<u{bytes_per_id}", count=a["n_tokens"],
                                        offset=a["offset"] + _HEAD_BYTES)
                    rows.append((a["doc_id"], a["repeat"], ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                    names=schema.names)

    return files.join(places, "shard").select("content", "asked").mapInArrow(cut, schema)


def store(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, text: str = "text",
          key: str = "doc_id", path: str | None = None):
    """Write, scan and index: ``(path, entries, index, n_keys, bytes_per_id)``."""
    spark = docs.sparkSession
    path = write(docs, path or scratch_dir(spark, "token-store"), vocabulary, end_id, text, key)
    bytes_per_id = width(vocabulary, end_id)
    entries = staged(scan(spark, path, bytes_per_id), "token-entries")
    n_keys = entries.count()
    return path, entries, staged(build_index(entries, n_keys), "token-index"), n_keys, bytes_per_id


def stored_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """Every stored document by way of the index: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens, ids_crc32, shard, offset``.

    Each record of the files is asked for by its key; a record is returned from
    where the index says it is. Records without a place of their own in the
    index (null keys, further records of a key in a later shard) are returned
    from the scan. Per-shard totals (one row per file) give the running start.
    """
    _, entries, index, n_keys, _ = store(docs, vocabulary, end_id, text, key)
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # one row per shard file: a bounded table, summed up in one small window
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    found = lookup(index, entries, n_keys).select(
        "shard", "offset", F.col("doc_id").alias("_k"), F.col("n_tokens").alias("_n"), F.lit(True).alias("_hit"))
    at = entries.join(found, ["shard", "offset"], "left")
    bad = F.col("_hit") & ~(F.col("_k").eqNullSafe(F.col("doc_id")) & (F.col("_n") == F.col("n_tokens")))
    first = F.min("shard").over(Window.partitionBy("doc_id", "repeat"))
    # an entry that is the first of its key must have been found through the index
    lost = F.col("_hit").isNull() & F.col("doc_id").isNotNull() & (F.col("shard") == first)
    checked = at.withColumn("n_tokens", F.when(bad | lost, F.raise_error(F.lit("the index misses a stored key")))
                            .otherwise(F.col("n_tokens")))
    return (checked.join(F.broadcast(base), "shard")
            .select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard",
                    "offset"))
