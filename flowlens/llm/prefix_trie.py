"""Operator 12: the trie of conversation prefixes, summed up band by band.

A node of depth d is a distinct sequence of first d turns (role, text). Sequences
are named by 128 bits: with ``v`` the first 16 bytes of the SHA-256 of a turn, a
prefix has the sums of ``v[i] * M**i`` over its turns, in two 64-bit halves, so the
name of a prefix follows from running sums and a piece of a conversation can be
moved to another depth by a power of ``M``.

1. ``numbered``: turns are sorted by (conversation, turn) over range partitions; each
   task counts and sums within its range, and one row per partition carries the
   count and sums of the conversation that runs over its end. No task needs a whole
   conversation.
2. ``rebuilt`` (or ``plain``): the paths, a row per conversation and depth.
3. ``nodes``: equal names are one node; members are added up before the shuffle.
4. ``rolled_up``: the depth-band rollup. Bands are ``height`` depths high. Every node
   explodes only to its ancestors in its own band. The tops of the bands form a trie
   of their own, ``height`` times less deep, whose sums are completed the same way;
   then each top's completed total goes to the ancestors in the band above it. A
   node has at most ``height`` copies in either step, and the number of rounds is the
   logarithm of the depth.
5. ``end_digests``: the ids that end at a node are sorted over range partitions;
   what lies within one range is hashed there, what is long or crosses a border goes
   on as pieces of some 16 kB that are hashed in order.

Defined cases: null role or text is empty. Rows of a null conversation id belong to
no conversation. Null turns come first; rows of one turn number (repeated rows too)
are turns one after the other, in the order of the SHA-256 of role and text. An empty table has no
node. Of a conversation id c the remainders are those of SQL (the sign of c). Columns
other than the four are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from flowlens.llm.common import staged
from flowlens.llm.text import mix

#: depths of a band
HEIGHT = 32
#: conversations of a block share the head of its first one, of up to this many turns
BLOCK, HEADS = 20, 4
#: bytes of a piece of a list of ids
PIECE = 1 << 14

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACK = [[pow(pow(m, -1, 1 << 64), k, 1 << 64) for k in range(HEADS)] for m in _MULT]
_WORD = r"[^\x20\x09-\x0D]+"


def _power(mult: int, exponents: np.ndarray) -> np.ndarray:
    """``mult ** exponents`` modulo 2**64."""
    out, e = np.ones(len(exponents), dtype=np.uint64), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * np.uint64(mult), out)
        mult, e = mult * mult % (1 << 64), e >> np.uint64(1)
    return out


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: byte length of the role, colon, role, text."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


_LOCAL = StructType([
    StructField("part", IntegerType()), StructField("edge", BooleanType()), StructField("conv_id", LongType()),
    StructField("first", BooleanType()), StructField("pos", LongType()), StructField("s1", LongType()),
    StructField("s2", LongType()), StructField("q1", LongType()), StructField("q2", LongType()),
    StructField("words", LongType())])


def _scan(batches):
    """Positions and sums within one sorted partition. ``first`` marks the rows of its
    first conversation; an ``edge`` row at the end has the first conversation (``words``)
    and what the last one (``conv_id``) has come to."""
    part = TaskContext.get().partitionId()
    begun = conv = None
    count, sums = 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, words = batch.column(0).to_numpy(), batch.column(2)
        v = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(n, 2)
        if begun is None:
            begun = conv = int(ids[0])
        new = np.ones(n, dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = ids[0] != conv
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        carried = start < 0
        pos = np.where(carried, np.arange(n) + 1 + count, np.arange(n) - start + 1)
        columns = []
        for k in (0, 1):
            term = v[:, k] * _power(_MULT[k], pos)
            run = np.cumsum(term, dtype=np.uint64)
            before = np.where(carried, np.uint64(0), (run - term)[np.maximum(start, 0)])
            s = run - before + np.where(carried, np.uint64(sums[k]), np.uint64(0))
            sums[k] = int(s[-1])
            columns += [s, s - term]
        conv, count = int(ids[-1]), int(pos[-1])
        s1, q1, s2, q2 = (pa.array(c.view(np.int64)) for c in columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), batch.column(0),
             pa.array(ids == begun), pa.array(pos), s1, s2, q1, q2, words], names=_LOCAL.names)
    if begun is not None:
        s1, s2 = (np.array([x], dtype=np.uint64).view(np.int64) for x in sums)
        zero = pa.array([0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([True]), pa.array([conv], pa.int64()), pa.array([True]),
             pa.array([count], pa.int64()), pa.array(s1), pa.array(s2), zero, zero, pa.array([begun], pa.int64())],
            names=_LOCAL.names)


def _carries(edges) -> dict[int, tuple[int, int, int]]:
    """Count and sums that the first conversation of a partition brings along, from one
    row per partition."""
    out: dict[int, tuple[int, int, int]] = {}
    conv, state = None, (0, 0, 0)
    for r in sorted(edges, key=lambda r: r["part"]):
        own = (r["pos"], r["s1"] % (1 << 64), r["s2"] % (1 << 64))
        if conv == r["words"]:
            out[r["part"]] = state
            if conv == r["conv_id"]:  # it goes on to the end of this partition
                own = _after(state, own)
        conv, state = r["conv_id"], own
    return out


def _after(state, own):
    n = state[0]
    return (n + own[0], *((state[k + 1] + pow(_MULT[k], n, 1 << 64) * own[k + 1]) % (1 << 64) for k in (0, 1)))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``s1, s2`` (sums up to the turn), ``q1, q2`` (before
    it), ``words``: a row per turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"),
        F.unhex(F.substring(turn_digest(role, text), 1, 32)).alias("v"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("_row"))  # parts equal rows over range borders; equal, so in any order
    order = ["conv_id", "_turn", "v", "_row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "v", "words")
    local = staged(rows.mapInArrow(_scan, _LOCAL), "turns")
    carried = _carries(local.where("edge").collect())  # one row per partition

    def whole(batches):
        for batch in batches:
            part, first = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            pos, *sums = (batch.column(k).to_numpy().copy() for k in range(4, 9))
            for p in np.unique(part[first]).tolist():
                if p in carried:
                    n, *base = carried[p]
                    at = np.flatnonzero(first & (part == p))
                    pos[at] += n
                    for j, col in enumerate(sums):
                        k = j % 2
                        some = col[at].view(np.uint64) * np.uint64(pow(_MULT[k], n, 1 << 64)) + np.uint64(base[k])
                        col[at] = some.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(pos), *map(pa.array, sums), batch.column(9)],
                                             names=["conv_id", "pos", "s1", "s2", "q1", "q2", "words"])

    return local.where("not edge").mapInArrow(
        whole, "conv_id long, pos long, s1 long, s2 long, q1 long, q2 long, words long")


_SUMS = ("s1", "s2", "q1", "q2")
_PATH = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, last boolean"


def _named(rows: DataFrame) -> DataFrame:
    """Paths from ``conv_id, depth, s1, s2, q1, q2, b1, b2, h1, h2, back, words, last``: the
    name after a turn is ``b + (s - h) * M**-back``, before it the same of ``q``."""
    def run(batches):
        for batch in batches:
            depth, back = batch.column(1).to_numpy().astype(np.uint64), batch.column(10).to_numpy()
            s1, s2, q1, q2, b1, b2, h1, h2 = (batch.column(k).to_numpy().view(np.uint64) for k in range(2, 10))
            m1, m2 = (np.array(x, dtype=np.uint64)[back] for x in _BACK)
            step = np.uint64(0xD6E8FEB86659FD93)
            names = [mix(b1 + (s1 - h1) * m1 + depth * step), b2 + (s2 - h2) * m2,
                     mix(b1 + (q1 - h1) * m1 + (depth - np.uint64(1)) * step), b2 + (q2 - h2) * m2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x.view(np.int64)) for x in names),
                 batch.column(11), batch.column(12)], names=[f.split()[0] for f in _PATH.split(", ")])

    nil = [F.lit(0).cast("long").alias(c) for c in ("b1", "b2", "h1", "h2")]
    have = [c if c in rows.columns else nil[i] for i, c in enumerate(("b1", "b2", "h1", "h2"))]
    back = "back" if "back" in rows.columns else F.lit(0).alias("back")
    return rows.select("conv_id", "depth", *_SUMS, *have, back, "words", "last").mapInArrow(run, _PATH)


def _roots(convs: DataFrame, length: Column) -> DataFrame:
    nil = F.lit(0).cast("long")
    return convs.select("conv_id", nil.alias("depth"), nil.alias("k1"), nil.alias("k2"),
                        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
                        nil.alias("words"), (length == 0).alias("last"))


def plain(turns: DataFrame) -> DataFrame:
    """The paths of conversations as they are."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("_n"))
    rows = turns.withColumnRenamed("pos", "depth").join(sizes, "conv_id").withColumn("last", F.col("depth") == F.col("_n"))
    return _named(rows).unionByName(_roots(sizes, F.col("_n")))


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """The paths of conversations whose first h turns are replaced by those of the
    first conversation of their block, h = crc32 of the id modulo ``heads``."""
    head = F.when(F.col("pos") < heads, F.struct("pos", *_SUMS, "words"))
    convs = staged(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "conversations")  # under ``heads`` each
    base = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_bn"), F.col("heads").alias("_bh"))
    info = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")).join(
        base, F.col("conv_id") - F.col("conv_id") % block == F.col("_base"), "left")
    info = info.withColumn("m", F.least("h", F.coalesce("_bn", F.lit(0))).cast("int")).withColumn(
        "length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    given = info.select("conv_id", "length", F.explode(F.slice("_bh", F.lit(1), F.col("m"))).alias("t"))
    given = given.select("conv_id", F.col("t.pos").alias("depth"), *(F.col(f"t.{c}").alias(c) for c in _SUMS),
                         F.col("t.words").alias("words"), (F.col("t.pos") == F.col("length")).alias("last"))

    def at(heads_: str, i: str, c: str) -> Column:  # the sum after turn i, 0 before the first
        return F.coalesce(F.get(F.col(heads_), F.col(i) - 1)[c], F.lit(0)).cast("long")

    own = turns.join(info.select("conv_id", "h", "m", "length", at("_bh", "m", "s1").alias("b1"), at("_bh", "m", "s2").alias("b2"),
                                 at("heads", "h", "s1").alias("h1"), at("heads", "h", "s2").alias("h2")), "conv_id")
    own = own.where(F.col("pos") > F.col("h")).withColumn("depth", F.col("m") + F.col("pos") - F.col("h")).withColumn(
        "back", F.col("h") - F.col("m")).withColumn("last", F.col("depth") == F.col("length"))
    return _named(own).unionByName(_named(given)).unionByName(_roots(info, F.col("length")))


_KEY = ["k1", "k2"]


def rolled_up(paths: DataFrame, nodes: DataFrame, deepest: int, height: int = HEIGHT) -> DataFrame:
    """``k1, k2, leaves, saved``: both summed over the subtree of each node. ``nodes``
    has ``k1, k2, conv_id`` (a conversation through it), ``depth, leaves, saved``."""
    band = F.floor(F.col("depth") / height).cast("long").alias("band")
    chains = paths.groupBy("conv_id", band).agg(F.collect_list(F.struct("depth", *_KEY)).alias("above"))  # ``height`` at most
    up = nodes.withColumn("band", band).join(chains, ["conv_id", "band"])
    up = up.select(F.explode(F.filter("above", lambda a: a["depth"] <= F.col("depth"))).alias("a"), "leaves", "saved")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    within = up.groupBy(F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2")).agg(*sums)
    if deepest < height:
        return within
    within = staged(within, "bands")
    down = [c if c != "depth" else (F.col("depth") / height).cast("long").alias("depth") for c in nodes.columns]
    tops = nodes.where(F.col("depth") % height == 0).select(*down).drop("leaves", "saved").join(within, _KEY)
    short = paths.where(F.col("depth") % height == 0).withColumn("depth", (F.col("depth") / height).cast("long"))
    done = rolled_up(short, tops, deepest // height, height)
    done = tops.drop("leaves", "saved").where("depth > 0").join(done, _KEY).withColumn("band", F.col("depth") - 1)
    passed = done.join(chains, ["conv_id", "band"]).select(F.explode("above").alias("a"), "leaves", "saved")
    passed = passed.select("a.k1", "a.k2", "leaves", "saved")
    return within.unionByName(passed).groupBy(*_KEY).agg(*sums)


_END = StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("at", LongType()),
                   StructField("piece", BinaryType()), StructField("digest", StringType())])


def _end_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_END.names)


def _pieces(batches):
    """Ids of one sorted partition, comma-joined per node: the digest where the node's
    ids are few and surely all here, pieces where they are many or at a border."""
    node, ids, size, inner = None, [], 0, False
    for batch in batches:
        out = []
        for k1, k2, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (k1, k2) != node:
                if ids:
                    text = b",".join(ids)
                    out.append((*node, None, None, hashlib.sha256(text).hexdigest()) if inner
                               else (*node, first, text, None))
                # the first node of a partition may have begun before it
                node, ids, size, inner = (k1, k2), [], 0, node is not None
            if not ids:
                first = conv
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
            if size > PIECE:
                out.append((*node, first, b",".join(ids), None))
                ids, size, inner = [], 0, False
        if out:
            yield _end_batch(out)
    if ids:
        yield _end_batch([(*node, first, b",".join(ids), None)])


def _joined(batches):
    """Digests of nodes whose pieces come in order."""
    node = digest = None
    for batch in batches:
        out = []
        for k1, k2, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (k1, k2) != node:
                if node is not None:
                    out.append((*node, None, None, digest.hexdigest()))
                node, digest = (k1, k2), hashlib.sha256(piece)
            else:
                digest.update(b"," + piece)
        if out:
            yield _end_batch(out)
    if node is not None:
        yield _end_batch([(*node, None, None, digest.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes at which conversations end."""
    order = [*_KEY, "conv_id"]
    ends = paths.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ends.mapInArrow(_pieces, _END), "ends")
    pieces = found.where("piece is not null").select(*_KEY, "at", "piece")
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "at").select(*_KEY, "piece")
    whole = pieces.mapInArrow(_joined, _END).unionByName(found.where("piece is null"))
    return whole.select(*_KEY, F.col("digest").alias("ends_sha256"))


def trie(paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    paths = staged(paths, "paths")
    merged = paths.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *(F.max(c).alias(c) for c in ("depth", "p1", "p2", "words")))  # equal in all rows of a node
    merged = staged(merged, "trie")
    deepest = merged.agg(F.max("depth")).first()[0]
    kids = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    nodes = merged.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    totals = rolled_up(paths, nodes.select(*_KEY, "conv_id", "depth", "leaves", "saved"), deepest or 0, height)
    parents = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("leaves", "saved").join(totals, _KEY).join(end_digests(paths), _KEY, "left").join(
        parents, ["p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def duckdb_sql(block: int = BLOCK, heads: int = HEADS) -> str:
    """The trie of the rebuilt conversations as DuckDB SQL; the checksum's table is made
    by its rule (reversed polynomial 3988292384)."""
    return f"""
with recursive bits as (
  select i, i::ubigint as c, 0 as k from range(256) t(i)
  union all
  select i, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
             sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as v,
             row_number() over (partition by conv_id order by turn nulls first, v) as pos
      from conversations where conv_id is not null),
n as (select conv_id, count(*) as n from o group by conv_id),
h as (select n.conv_id, n.conv_id - n.conv_id % {block} as c0,
             (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(n.conv_id::varchar, ''),
                  lambda x: ascii(x)::ubigint)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) % 256)::int])),
              4294967295::ubigint) % {heads})::bigint as h from n, tab),
r as (select h.conv_id, o.pos as depth, o.text, o.v from h join o on o.conv_id = h.c0 and o.pos <= h.h
      union all
      select o.conv_id, least(h.h, coalesce(b.n, 0)) + o.pos - h.h, o.text, o.v
      from o join h on h.conv_id = o.conv_id left join n b on b.conv_id = h.c0 where o.pos > h.h),
p as (select conv_id, depth, string_agg(v, '') over (partition by conv_id order by depth) as name,
             coalesce(string_agg(v, '') over (partition by conv_id order by depth rows between unbounded preceding and 1 preceding), '') as parent,
             len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words,
             depth = max(depth) over (partition by conv_id) as last from r
      union all
      select conv_id, 0, '', null, 0, conv_id not in (select conv_id from r) from n),
t as (select name, min(conv_id) as conv_id, any_value(depth) as depth, any_value(parent) as parent, count(*) as n_convs,
             any_value(words) as words, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
      from p group by name),
k as (select parent as name, count(*) as n_children from t where depth > 0 group by parent),
s as (select a.name, sum(case when k.name is null then 1 else 0 end) as n_leaves, sum((t.n_convs - 1) * t.words) as saved_tokens
      from t left join k on k.name = t.name join p a on a.conv_id = t.conv_id and a.depth <= t.depth group by a.name)
select t.conv_id, t.depth::bigint as depth, u.conv_id as parent_conv_id, t.n_convs, coalesce(k.n_children, 0) as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, t.ends_sha256
from t join s on s.name = t.name left join k on k.name = t.name left join t u on u.name = t.parent"""
