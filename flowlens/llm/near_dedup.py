"""Operator 9: near-duplicate documents with an LSH forest.

Every document is the set of its distinct 5-word shingles; documents of equal
sets form one class. A class has ``TREES * ROOT`` minhash values. Each of the
``TREES`` sorted orders ("trees") lists the classes by a label of ``DEPTH`` of
those values, a different selection per tree. Classes that share at least
``ROOT`` leading values with a neighbour are candidates:

1. classes with such a neighbour, in either direction of an order, are grouped by
   region (equal leading values). The depth of a region adapts: where more than
   ``REGION`` classes share ``ROOT`` values, it is split by further values.
2. In a region, each class and the one whose signature agrees best are confirmed
   on full shingle sets and joined into components.
3. Where a region still holds several components, every likely pair across them
   is compared on 32-bit shingle sets inside the region's task, and the pairs
   that link components are confirmed on full sets. Pairs inside a component
   need no confirmation, so no more than a spanning set is ever told.
4. Where a region of ``ROOT`` values was split for its size and still holds
   several components, those outside its largest are compared with all of it in
   blocks, so every two classes that share ``ROOT`` values are compared or are in
   one component already.

A pair of Jaccard similarity s misses all trees at the root depth with
probability ``(1 - s**ROOT) ** TREES``: 5e-6 at 0.75.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from flowlens.llm.common import released, staged, text_of
from flowlens.llm.text import SPACE_WORDS, Prefix, blocks, buffer, mix, shingles, words

SHINGLE = 5
PERCENT = 75
TREES = 32
#: values that neighbours share at least, values of a label
ROOT, DEPTH = 4, 8
#: classes of one region that are compared pairwise
REGION = 512
#: signature agreement from which a pair is confirmed: 4 standard deviations
#: under the threshold
LIKELY = 0.6

_RNG = np.random.default_rng(75)
_XOR = _RNG.integers(0, 2**63, TREES * ROOT, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, TREES * ROOT, dtype=np.uint64) | np.uint64(1)


def label_values(tree: int) -> list[int]:
    """Which signature values make the label of a tree: its own ``ROOT`` first,
    then values of other trees in an order that differs per tree."""
    own = list(range(tree * ROOT, (tree + 1) * ROOT))
    more = [(tree * ROOT + ROOT + 37 * q) % (TREES * ROOT) for q in range(DEPTH - ROOT)]
    return own + more


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Yields the sorted distinct shingle hashes of each text: words are runs
    without white space, A-Z lower-cased; a text of fewer words is one shingle;
    no words give the empty set."""
    raw, offsets = buffer(texts)
    for i, j in blocks(offsets):
        part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = words(part, at, SPACE_WORDS)
        names = Prefix(part, fold=True).window(starts, ends)
        runs = shingles(names, size)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= size:
                yield np.unique(runs[a:b - size + 1])
            elif b > a:
                short = mix(np.array([b - a], dtype=np.uint64))
                for w in names[a:b]:
                    short = mix(short * np.uint64(0x9E3779B97F4A7C15) + w)
                yield short
            else:
                yield np.empty(0, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 minhash values of non-empty sets, one row per set."""
    out = np.empty((len(sets), TREES * ROOT), dtype=">u2")
    for i in range(0, len(sets), 256):
        some = sets[i:i + 256]
        flat = np.concatenate(some)
        at = np.cumsum([0, *map(len, some)])[:-1]
        for k in range(TREES * ROOT):
            out[i:i + len(some), k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at) >> np.uint64(48)
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def text_name(text) -> Column:
    """128 bits of a text's SHA-256: rows of equal text under any key."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


_SIGNED = [StructField("n_shingles", LongType()), StructField("digest", BinaryType()),
           StructField("signature", BinaryType())]


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, name, n_shingles, digest, signature`` (the last two null for the
    empty set)."""
    src = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("_text")).select(
        "doc_id", text_name(F.col("_text")).alias("name"), "_text")
    schema = StructType([src.schema["doc_id"], StructField("name", BinaryType()), *_SIGNED])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                sets = list(shingle_sets(part.column(2)))
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=schema.names)

    return src.mapInArrow(run, schema)


_ROW = StructType([StructField("tree", IntegerType()), StructField("label", BinaryType()),
                   StructField("digest", BinaryType())])


def _forest_rows(classes: DataFrame) -> DataFrame:
    """Each class once per tree: ``tree, label, digest``."""
    picks = [np.array(label_values(t)) for t in range(TREES)]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                if not part.num_rows:
                    continue
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=">u2").reshape(part.num_rows, -1)
                for t, pick in enumerate(picks):
                    raw = np.ascontiguousarray(sig[:, pick]).tobytes()
                    labels = [raw[k:k + 2 * DEPTH] for k in range(0, len(raw), 2 * DEPTH)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * part.num_rows, pa.int32()), pa.array(labels, pa.binary()),
                         part.column(0)], names=_ROW.names)

    return classes.select("digest", "signature").mapInArrow(run, _ROW)


_NEAR = StructType([StructField("kind", IntegerType()), *_ROW.fields, StructField("other", BinaryType()),
                    StructField("other_label", BinaryType())])
_PAIR, _EDGE = 0, 1


def _neighbours(batches):
    """Neighbours of one sorted partition that share the root values; also its
    first and last row, whose other neighbour is in another partition."""
    prev = first = None
    for batch in batches:
        tree, label, digest = (batch.column(k).to_pylist() for k in range(3))
        if not tree:
            continue
        out = []
        if first is None:
            first = (tree[0], label[0], digest[0])
            out.append((_EDGE, *first, None, None))
        for row in zip(tree, label, digest):
            if prev is not None and prev[0] == row[0] and prev[1][:2 * ROOT] == row[1][:2 * ROOT]:
                out.append((_PAIR, *row, prev[2], prev[1]))
            prev = row
        if out:
            yield _near_batch(out)
    if prev is not None:
        yield _near_batch([(_EDGE, *prev, None, None)])


def _near_batch(rows):
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_NEAR.names)


def _sorted_orders(classes: DataFrame) -> DataFrame:
    """The neighbours and edges of all sorted orders (``_NEAR``), written."""
    rows = _forest_rows(classes)
    shuffled = rows.repartitionByRange("tree", "label", "digest").sortWithinPartitions("tree", "label", "digest")
    return staged(shuffled.mapInArrow(_neighbours, _NEAR), "forest")


def _neighbour_rows(near: DataFrame) -> DataFrame:
    """Neighbouring classes of all sorted orders: ``tree, label, digest, other,
    other_label`` where at least the root values agree."""
    # two rows per partition meet again by region, to be joined over the border
    region = Window.partitionBy("tree", F.substring("label", 1, 2 * ROOT)).orderBy("label", "digest")
    border = (near.where(F.col("kind") == _EDGE).dropDuplicates(["tree", "label", "digest"])
              .withColumn("other", F.lag("digest").over(region)).withColumn("other_label", F.lag("label").over(region))
              .where(F.col("other").isNotNull()))
    return near.where(F.col("kind") == _PAIR).unionByName(border).drop("kind")


_SET = StructType([StructField("digest", BinaryType()), StructField("shingles", BinaryType())])


def full_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``digest, shingles`` of the classes in ``wanted`` (``digest, member``), made anew
    from the text of one member document each."""
    src = docs.select(F.col(key).alias("_key"), text_of(docs, text).alias("_text"))
    mine = src.join(wanted.select(F.col("member").alias("_m")), src["_key"].eqNullSafe(F.col("_m")), "left_semi")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                sets = [s for s in shingle_sets(batch.slice(i, 250).column(1)) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=_SET.names)

    made = mine.mapInArrow(run, _SET)
    return made.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def short_sets(sets: DataFrame) -> DataFrame:
    """``digest, short``: 32 bits of each hash of the full sets."""
    def run(batches):
        for batch in batches:
            full = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1))
            short = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in full]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["digest", "short"])

    return sets.select("digest", "shingles").mapInArrow(run, "digest binary, short binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` of which ``100 * intersection >= percent * union``."""
    both = (pairs.join(sets.select(F.col("digest").alias("u"), F.col("shingles").alias("_a")), "u")
            .join(sets.select(F.col("digest").alias("v"), F.col("shingles").alias("_b")), "v"))

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b[i].as_buffer(), dtype=np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "_a", "_b").mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components by alternating large-star and small-star
    rounds; every round is written to the checkpoint folder."""
    now = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a != b").distinct()
    now = now.checkpoint()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a")
        now = (small.select(F.col("b").alias("a"), F.col("_m").alias("b"))
               .unionByName(small.select("a", F.col("_m").alias("b")))
               .where("a != b").distinct().checkpoint())
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _regions(near: DataFrame) -> DataFrame:
    """``tree, region, deal, digest``: the classes with a neighbour, by region.
    Regions of more than ``REGION`` classes go deeper until they are small enough;
    equal labels are dealt into groups of about that size, anew in each tree."""
    rows = near.select("tree", "label", "digest").unionByName(
        near.select("tree", F.col("other_label").alias("label"), F.col("other").alias("digest"))).distinct()
    for d in range(ROOT, DEPTH + 1):
        pre = F.substring("label", 1, 2 * d)
        size = rows.groupBy("tree", pre.alias("_p")).agg(F.count("*").alias(f"_n{d}")).where(
            F.col(f"_n{d}") > REGION).withColumnRenamed("tree", "_t")
        rows = rows.join(size, (F.col("tree") == F.col("_t")) & (pre == F.col("_p")), "left").drop("_t", "_p")
    depth, last = F.lit(DEPTH), F.col(f"_n{DEPTH}")
    for d in range(DEPTH - 1, ROOT - 1, -1):
        depth = F.when(F.col(f"_n{d}").isNull(), F.lit(d)).otherwise(depth)
    deal = F.when(last.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("tree", "digest"), F.floor(last / REGION) + 1))
    return rows.select("tree", F.substring(F.col("label"), F.lit(1), 2 * depth).alias("region"),
                       deal.cast("int").alias("deal"), "digest")


_REGION_KEYS = ["tree", "region", "deal"]


def _likely(regions: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``u, v``: for each class and region the partner whose signature agrees best,
    if by at least ``LIKELY``."""
    rows = regions.join(classes.select("digest", "n", "signature"), "digest")

    def best(table: pa.Table) -> pa.Table:
        digest, n = table["digest"].to_pylist(), table["n"].to_numpy()
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=">u2").reshape(len(digest), -1)
        u, v = [], []
        for i in range(len(digest)):
            same = (sig == sig[i]).mean(axis=1)
            same[(100 * np.minimum(n, n[i]) < percent * np.maximum(n, n[i])) | (np.arange(len(n)) == i)] = 0
            j = int(np.argmax(same))
            if same[j] >= LIKELY:
                u.append(digest[i])
                v.append(digest[j])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    found = rows.groupBy(*_REGION_KEYS).applyInArrow(best, "u binary, v binary")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _remaining(regions: DataFrame, classes: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links between components. In each region that holds several
    components, every pair across them with likely signatures is compared on
    32-bit shingle sets, best agreement first; a pair that links for certain
    joins its components for the rest of the region, so what comes out are links
    that span, and the few that are too close to call."""
    rows = regions.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    mixed = rows.groupBy(*_REGION_KEYS).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where(
        "_lo != _hi").select(*_REGION_KEYS)
    mixed = staged(rows.join(mixed, _REGION_KEYS, "left_semi"), "mixed-regions")
    rows = mixed.join(classes.select("digest", "n", "signature"), "digest").join(short_sets(sets), "digest")
    told = staged(_told(rows, _REGION_KEYS, percent), "remaining")
    released(mixed)
    return told


def _told(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """``u, v``: the links that each group of ``rows`` tells. With a column
    ``mine``, each pair has a row of which it is true."""
    halves = "mine" in rows.columns

    def compare(table: pa.Table) -> pa.Table:
        digest, n = table["digest"].to_pylist(), table["n"].to_numpy()
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=">u2").reshape(len(digest), -1)
        short = [np.frombuffer(x, dtype="<u4") for x in table["short"].to_pylist()]
        _, part = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)
        firsts = np.flatnonzero(table["mine"].to_numpy(zero_copy_only=False)) if halves else range(1, len(digest))
        u, v = [], []
        for i in firsts:
            upto = len(digest) if halves else i
            j = _partners(sig, n, part, i, upto, percent)
            while len(j):
                some, j = j[:16], j[16:]
                flat = np.concatenate([short[k] for k in some])
                size = np.array([len(short[k]) for k in some])
                at = np.searchsorted(short[i], flat)
                hit = short[i][np.minimum(at, len(short[i]) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                share = 100 * common / (size + len(short[i]) - common)
                for k, x in zip(some.tolist(), share.tolist()):
                    if x >= percent - 1 and part[k] != part[i]:
                        u.append(digest[i])
                        v.append(digest[k])
                        if x >= percent + 1:
                            part[part == part[k]] = part[i]
                j = j[part[j] != part[i]]
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    found = rows.groupBy(*keys).applyInArrow(compare, "u binary, v binary")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _partners(sig: np.ndarray, n: np.ndarray, part: np.ndarray, i: int, upto: int, percent: int) -> np.ndarray:
    """Rows before ``upto`` of other components than row ``i`` whose size and
    signature make a link likely, best agreement first."""
    j = np.flatnonzero((part[:upto] != part[i])
                       & (100 * np.minimum(n[:upto], n[i]) >= percent * np.maximum(n[:upto], n[i])))
    same = (sig[j] == sig[i]).mean(axis=1)
    return j[np.argsort(-same, kind="stable")[:int((same >= LIKELY).sum())]]


_BLOCK_KEYS = ["tree", "region", "mine_block", "block"]


def _across(regions: DataFrame, classes: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links between components that the splitting of large regions kept
    apart. In each region of ``ROOT`` values that was split, the classes outside its
    largest component ("mine") are compared with all of its classes, both dealt
    into blocks of about ``REGION``. Shingle sets are fetched only for classes with
    a likely partner in their block."""
    region = F.substring("region", 1, 2 * ROOT).alias("region")
    rows = regions.where(F.length("region") > 2 * ROOT).select("tree", region, "digest")
    rows = rows.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    most = rows.groupBy("tree", "region", "root").agg(F.count("*").alias("_n")).groupBy("tree", "region").agg(
        F.max(F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_all")).where("_all > _most._n")
    most = most.select("tree", "region", F.col("_most.root").alias("_big"),
                       F.floor(F.col("_all") / REGION).cast("int").alias("_blocks"),
                       F.floor((F.col("_all") - F.col("_most._n")) / REGION).cast("int").alias("_mine_blocks"))
    rows = staged(rows.join(most, ["tree", "region"]), "split-regions")
    name = F.xxhash64("tree", "digest")
    own = F.pmod(name, F.col("_blocks") + 1).cast("int"), F.pmod(name, F.col("_mine_blocks") + 1).cast("int")
    every = rows.withColumn("block", own[0]).withColumn("mine_block", F.explode(F.sequence(F.lit(0), "_mine_blocks")))
    mine = rows.where(F.col("root") != F.col("_big")).withColumn("mine_block", own[1]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), "_blocks")))
    cols = [*_BLOCK_KEYS, "digest", "root"]
    dealt = every.select(*cols, F.lit(False).alias("mine")).unionByName(mine.select(*cols, F.lit(True).alias("mine")))
    signed_rows = dealt.join(classes.select("digest", "n", "signature"), "digest")
    schema = StructType([dealt.schema[c] for c in [*cols, "mine"]])

    def likely(table: pa.Table) -> pa.Table:
        n, mine = table["n"].to_numpy(), table["mine"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=">u2").reshape(len(n), -1)
        _, part = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)
        keep = np.zeros(len(n), dtype=bool)
        for i in np.flatnonzero(mine):
            j = _partners(sig, n, part, i, len(n), percent)
            keep[j] = True
            keep[i] |= len(j) > 0
        return table.select([*cols, "mine"]).filter(pa.array(keep))

    some = staged(signed_rows.groupBy(*_BLOCK_KEYS).applyInArrow(likely, schema), "split-likely")
    payload = classes.select("digest", "n", "signature").join(short_sets(sets), "digest")
    told = staged(_told(some.join(payload, "digest"), _BLOCK_KEYS, percent), "across")
    released(rows, some)
    return told


def _grouped(docs: DataFrame, percent: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows and ``digest, member, name, root`` of every class; its
    member is the row of the smallest key (null last), then of the smallest name."""
    own = staged(signed(docs, text, key), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name"))
    classes = staged(own.where(F.col("digest").isNotNull()).groupBy("digest")
                     .agg(first.alias("_f"), F.max("n_shingles").alias("n"), F.min("signature").alias("signature"))
                     .select("digest", F.col("_f.doc_id").alias("member"), F.col("_f.name").alias("name"), "n",
                             "signature"), "classes")
    forest = _sorted_orders(classes)
    regions = staged(_regions(_neighbour_rows(forest)), "regions")
    released(forest)
    wanted = classes.select("digest", "member").join(regions.select("digest"), "digest", "left_semi")
    sets = staged(full_sets(docs, wanted, text, key), "sets")
    likely = staged(_likely(regions, classes, percent), "likely")
    links = staged(confirmed(likely, sets, percent), "links")
    more = _remaining(regions, classes, sets, components(links), percent)
    links = links.unionByName(staged(confirmed(more, sets, percent), "more-links"))
    released(likely, more)
    parts = components(links)
    last = _across(regions, classes, sets, parts, percent)
    if not last.isEmpty():
        parts = components(links.unionByName(staged(confirmed(last, sets, percent), "last-links")))
    names = staged(classes.select("digest", "member", "name"), "class-names")
    released(sets, regions, last, classes)
    joined = names.join(
        parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    return own, joined


def near_duplicates(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    ``component_id`` is the smallest key that links of at least ``percent`` %
    similarity reach, itself included; ``kept`` is key = component. Empty sets
    (null, empty or blank text) are linked with nothing. Repeated rows are
    copies of each other and each get a row; a null key gets the smallest key of
    its component (its own null if it has no other).
    """
    own, joined = _grouped(docs, percent, text, key)
    least = joined.groupBy("root").agg(F.min("member").alias("component_id"))
    named = joined.join(least, "root").select("digest", "component_id")
    out = own.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, name``: one row per component of ``near_duplicates``, empty sets
    left out. It is the row of the smallest key (a null key only if there is no
    other); texts that share that key are told apart by shingle digest, then
    ``text_name``. No text survives twice, as equal texts are in one component."""
    _, joined = _grouped(docs, percent, text, key)
    first = F.min(F.struct(F.col("member").isNull().alias("none"), "member", "digest", "name")).alias("_f")
    return joined.groupBy("root").agg(first).select(F.col("_f.member").alias("doc_id"), F.col("_f.name").alias("name"))
