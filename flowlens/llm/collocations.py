"""Operator 13: collocations by best-first branch-and-bound growth of phrases.

Texts (A-Z lower-cased) are split at ``. , ; : ! ?``, line feed, vertical tab, form feed
and carriage return into pieces, and those at spaces and tabs into words. Words are
named by 64 bits per language; the naming is checked to be free of collisions and
made anew otherwise, so the counts are exact.

1. ``word_counts``, ``pair_counts``: every task adds up block by block, Spark adds up
   before and after the shuffle. A pair is counted only if both words are found
   ``least`` times. Such filters travel as bitmaps of a fixed largest size; a bit set
   by another entry costs work, not correctness.
2. A phrase that begins with the pair (u, v) has a score of at most
   ``10**6 * f(u v) / f(u)``: its own count is no larger than f(u v), and the cut after
   u divides by f(u) and by no less than its own count. This bound from prefix counts
   orders the frontier.
3. ``grown``: all pairs of a language whose bound reaches its threshold are expanded in
   one pass over the texts, and so are, to the left, pairs whose own score reaches it
   (a longer phrase may drop them). Every phrase at or above the threshold is then
   known exactly, with all that could drop it. Where fewer than ``top`` phrases of a
   language survive, its threshold goes down to the next part of the frontier, ties
   included, and only phrases that were not counted before are counted.
4. The first ``top`` survivors of each language by score, count and phrase.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count
each. A language with fewer survivors returns those it has; without candidates, or
with an empty table, there is no row. Columns other than text and language are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import staged, text_of
from flowlens.llm.text import Prefix, blocks, buffer, mix, words

LEAST, TOP, SHARE = 10, 2000, 50
#: how many times ``top`` pairs the first part of the frontier has, and by how much it grows
FIRST, GROWTH = 2, 8
#: scores are told apart by this much when a threshold is set
STEP = 1000
#: bits of a filter: per entry, at least and at most
BITS, FEWEST_BITS, MOST_BITS = 16, 15, 27
#: bytes of text counted at once, and of these whose words are named at once: naming takes some
#: 40 bytes for each byte of text, counting some 60 for each word
BLOCK, NAMED = 4 << 20, 128 << 10

_DELIMITER = np.zeros(256, dtype=bool)
_DELIMITER[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_DELIMITER
_WORD[[0x20, 9]] = False
_SPLIT, _SPACE = r"[.,;:!?\n\x0B\f\r]", r"[ \t]+"


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Words:
    """The words of a block of documents: ``ids``, byte ranges, and ``linked[i]`` if word
    i + 1 follows word i in its piece."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, langs: list[str], seed: int):
        self.raw = raw
        odd = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        parts, a = [], 0
        while a < len(raw) or not parts:
            b = _until(raw, at, a)
            parts.append(self._named(raw[a:b], at[(at >= a) & (at <= b)] - a, a, odd))
            a = b
        self.starts, self.ends, ids, linked = map(np.concatenate, zip(*parts))
        self.first = np.searchsorted(self.starts, at)
        self.ids = mix(ids + np.repeat(np.array([_language(x) for x in langs], dtype=np.uint64), np.diff(self.first)))
        linked[self.first[self.first > 0] - 1] = False
        self.linked = linked[:-1]

    @staticmethod
    def _named(raw: np.ndarray, at: np.ndarray, a: int, odd: np.uint64):
        """``starts, ends, names, linked`` of the bytes from ``a``, without their documents' languages."""
        starts, ends, _ = words(raw, at, _WORD)
        pre, half = Prefix(raw, fold=True), (starts + ends) >> 1
        ids = pre.window(starts, half) * odd + pre.window(half, ends)
        piece = np.cumsum(_DELIMITER[raw])[starts] if len(raw) else starts
        linked = np.zeros(len(ids), dtype=bool)
        linked[:-1] = piece[1:] == piece[:-1]
        return starts + a, ends + a, ids, linked


def _until(raw: np.ndarray, at: np.ndarray, a: int) -> int:
    """Where the bytes from ``a`` that are named together end: ``NAMED`` bytes on, at the next end of
    a document or delimiter, across which no word is linked."""
    b = min(a + NAMED, len(raw))
    stop = int(at[np.searchsorted(at, b)])
    while b < stop:
        found = np.flatnonzero(_DELIMITER[raw[b - 1:min(b - 1 + NAMED, stop)]])
        if len(found):
            return b + int(found[0])
        b += NAMED
    return stop


def _blocks_of(batch: pa.RecordBatch, seed: int):
    """``(words, languages)`` of the blocks of a batch ``lang, text``."""
    raw, offsets = buffer(batch.column(1))
    langs = batch.column(0).to_pylist()
    for i, j in blocks(offsets, BLOCK):
        yield _Words(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], langs[i:j], seed), langs[i:j]


def _runs(*ids: np.ndarray):
    """``(distinct rows, counts, a place of each)``; equal rows may come out apart, never
    different ones together."""
    name = ids[0]
    for x in ids[1:]:
        name = _pair(name, x)
    order = np.argsort(name, kind="stable")
    ids = [x[order] for x in ids]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
    at = np.flatnonzero(new)
    return [x[at] for x in ids], np.diff(np.append(at, len(order))), order[at]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b))


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(docs, text).alias("text"))


def word_counts(src: DataFrame, seed: int) -> DataFrame:
    """``lang, word, id, f``; with a null word, all words of a language."""
    def run(batches):
        for batch in batches:
            for w, langs in _blocks_of(batch, seed):
                if not len(w.ids):
                    continue
                (ids,), f, at = _runs(w.ids)
                doc = np.searchsorted(w.first, at, side="right") - 1
                raw = w.raw.tobytes()
                found = [raw[a:b].lower() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist())]
                sizes = np.diff(w.first).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[d] for d in doc.tolist()] + langs), pa.array(found + [None] * len(langs), pa.binary()),
                     pa.array(np.append(ids.view(np.int64), np.zeros(len(langs), dtype=np.int64))),
                     pa.array(f.tolist() + sizes, pa.int64())], names=["lang", "word", "id", "f"])

    rows = src.mapInArrow(run, "lang string, word binary, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


class _Bits:
    """Membership by one hash; what is in is always found."""

    def __init__(self, table: DataFrame, column: str, size: int):
        self.power = min(MOST_BITS, max(FEWEST_BITS, (BITS * size).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 64 - self.power) + 1
        parts = table.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("k")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bits")).collect()  # at most 2**power bits
        self.bits = np.zeros(1 << (self.power - 3), dtype=np.uint8)
        for r in parts:
            self.bits[(r["k"] - 1) * 4096:r["k"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)

    def __contains__(self, other):
        raise TypeError("use has()")

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names >> np.uint64(64 - self.power)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def pair_counts(src: DataFrame, seed: int, often: _Bits) -> DataFrame:
    """``u, v, a`` of the pairs of words in ``often``."""
    def run(batches):
        for batch in batches:
            for w, _ in _blocks_of(batch, seed):
                known = often.has(w.ids)
                i = np.flatnonzero(w.linked & known[:-1] & known[1:])
                (u, v), a, _ = _runs(w.ids[i], w.ids[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(a)],
                                                 names=["u", "v", "a"])

    return src.mapInArrow(run, "u long, v long, a long").groupBy("u", "v").agg(F.sum("a").alias("a"))


def _with_names(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the ``name`` of each pair in filters."""
    schema = pairs.select("*", F.lit(0).cast("long").alias("name")).schema
    u, v = pairs.columns.index("u"), pairs.columns.index("v")

    def run(batches):
        for batch in batches:
            name = _pair(batch.column(u).to_numpy().view(np.uint64), batch.column(v).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name.view(np.int64))], names=schema.names)

    return pairs.mapInArrow(run, schema)


class _Frontier:
    """Which three-word phrases a pass counts."""

    def __init__(self, pairs: DataFrame, size: int, limits: DataFrame, often: _Bits):
        rows = pairs.join(limits, "lang")
        self.often = often
        self.right = _Bits(rows.where("bound >= tau"), "name", size)
        self.left = _Bits(rows.where("score >= tau"), "name", size)

    def counts(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return self.often.has(head) & self.often.has(tail) & (self.right.has(head) | self.left.has(tail))


def _triple_counts(src: DataFrame, seed: int, now: _Frontier, before: list[_Frontier]) -> DataFrame:
    """``u, v, w, a`` of the phrases of three words on the frontier and on none before."""
    def run(batches):
        for batch in batches:
            for x, _ in _blocks_of(batch, seed):
                i = np.flatnonzero(x.linked[:-1] & x.linked[1:])
                pairs = _pair(x.ids[:-1], x.ids[1:])
                head, tail = pairs[i], pairs[i + 1]
                new = now.counts(head, tail)
                for old in before:
                    new &= ~old.counts(head, tail)
                i = i[new]
                (u, v, w), a, _ = _runs(x.ids[i], x.ids[i + 1], x.ids[i + 2])
                yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in (u, v, w)), pa.array(a)],
                                                 names=["u", "v", "w", "a"])

    rows = src.mapInArrow(run, "u long, v long, w long, a long")
    return rows.groupBy("u", "v", "w").agg(F.sum("a").alias("a"))


def _score(a: str, left: str, right: str) -> Column:
    """``floor(10**6 * a * a / (left * right))``, exact for counts up to 10**15."""
    return F.expr(f"(cast({a} as decimal(19,0)) * {a} * 1000000BD) div (cast({left} as decimal(19,0)) * {right})")


def _thresholds(scores: DataFrame, wanted: int) -> DataFrame:
    """``lang, tau``: the largest multiple of ``STEP`` that ``wanted`` scores of the language reach,
    0 if fewer do."""
    steps = scores.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))  # 1001 rows a language at most
    enough = F.when(F.col("above") >= wanted, F.col("step") * STEP)
    return steps.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(enough), F.lit(0)).alias("tau"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language."""
    src = _source(docs, text, lang)
    for seed in range(8):
        every = staged(word_counts(src, seed).where((F.col("f") >= least) | F.col("word").isNull()), "words")
        known = every.where("word is not null")
        if known.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no naming of the words without collisions")
    often = _Bits(known, "id", known.count())
    pairs = pair_counts(src, seed, often).where(F.col("a") >= least)
    heads = known.select(F.col("id").alias("u"), "lang", F.col("f").alias("fu"))
    tails = known.select(F.col("id").alias("v"), F.col("f").alias("fv"))
    scored = pairs.join(heads, "u").join(tails, "v").withColumn("score", _score("a", "fu", "fv")).withColumn(
        "bound", F.expr("(cast(a as decimal(19,0)) * 1000000BD) div fu"))
    scored = staged(_with_names(scored.select("lang", "u", "v", "a", "fu", "fv", "score", "bound")), "pairs")
    size = scored.count()
    joined = _Bits(scored, "name", size)

    settled = limits = None
    frontiers: list[_Frontier] = []
    triples = None
    wanted = FIRST * top
    while True:
        lower = _thresholds(scored, wanted)
        # a settled language keeps its threshold
        limits = staged(lower if settled is None else lower.join(settled, "lang", "left").select(
            "lang", F.coalesce("kept", "tau").alias("tau")), "limits")
        now = _Frontier(scored, size, limits, joined)
        more = staged(_triple_counts(src, seed, now, frontiers).where(F.col("a") >= least), "triples")
        triples = more if triples is None else triples.unionByName(more)
        frontiers.append(now)
        found = staged(_survivors(scored, triples, limits, share), "survivors")
        enough = found.groupBy("lang").agg(F.count("*").alias("n"))
        state = limits.join(enough, "lang", "left")
        open_ = (F.coalesce("n", F.lit(0)) < top) & (F.col("tau") > 0)
        if state.where(open_).isEmpty():
            break
        settled = state.where(~open_).select("lang", F.col("tau").alias("kept"))
        wanted *= GROWTH
    total = every.where("word is null").select("lang", F.col("f").alias("n"))
    return _ranked(found, known, total, top)


def _survivors(pairs: DataFrame, triples: DataFrame, limits: DataFrame, share: int) -> DataFrame:
    """``lang, u, v, w, a, l, r, score``: the phrases that reach their language's threshold and are
    not dropped for a longer one."""
    head = pairs.select("u", "v", "lang", F.col("a").alias("uv"), "fu")
    tail = pairs.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("a").alias("vw"), F.col("fv").alias("fw"))
    three = triples.join(head, ["u", "v"]).join(tail, ["v", "w"])
    three = three.withColumn("s1", _score("a", "fu", "vw")).withColumn("s2", _score("a", "uv", "fw"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "u", "v", "w", "a", F.when(first, F.col("fu")).otherwise(F.col("uv")).alias("l"),
                         F.when(first, F.col("vw")).otherwise(F.col("fw")).alias("r"), F.least("s1", "s2").alias("score"))
    inside = triples.select("u", "v", "a").unionByName(triples.select(F.col("v").alias("u"), F.col("w").alias("v"), "a"))
    longer = inside.groupBy("u", "v").agg(F.max("a").alias("_longer"))
    two = pairs.join(limits, "lang").where("score >= tau").join(longer, ["u", "v"], "left")
    two = two.where(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True)))
    two = two.select("lang", "u", "v", F.lit(None).cast("long").alias("w"), "a", F.col("fu").alias("l"),
                     F.col("fv").alias("r"), "score")
    return three.join(limits, "lang").where("score >= tau").drop("tau").unionByName(two)


def _ranked(found: DataFrame, known: DataFrame, total: DataFrame, top: int) -> DataFrame:
    out = found
    for c in ("u", "v", "w"):
        out = out.join(known.select(F.col("id").alias(c), F.col("word").cast("string").alias(f"_{c}")), c, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", "_u", "_v", "_w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the limit reaches below the shuffle: no more than ``top`` rows of a language leave a task
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                          F.col("score").cast("long").alias("score"))


def duckdb_sql(least: int = LEAST, top: int = TOP, share: int = SHARE) -> str:
    """The collocations as DuckDB SQL, by counting every phrase."""
    def best(a: str, cuts: list[tuple[str, str]]) -> list[str]:
        return [f"(1000000::hugeint * {a} * {a} // ({x}::hugeint * {y}))" for x, y in cuts]

    s = best("t.a", [("u.a", "vw.a"), ("uv.a", "w.a")])
    return f"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}')) as piece from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '{_SPACE}'), lambda x: x <> '') as w from d),
f1 as (select lang, u, count(*) as a from (select lang, unnest(w) as u from p) group by all),
n as (select lang, sum(a)::bigint as n from f1 group by lang),
i2 as (select lang, w, unnest(range(1, len(w))) as i from p),
f2 as (select lang, w[i] as u, w[i + 1] as v, count(*) as a from i2 group by all having count(*) >= {least}),
i3 as (select lang, w, unnest(range(1, len(w) - 1)) as i from p),
f3 as (select lang, w[i] as u, w[i + 1] as v, w[i + 2] as w, count(*) as a from i3 group by all having count(*) >= {least}),
longer as (select lang, u, v, max(a) as b from (select lang, u, v, a from f3 union all select lang, v, w, a from f3) group by all),
c2 as (select t.lang, t.u || ' ' || t.v as phrase, t.a, u.a as l, v.a as r, {best('t.a', [('u.a', 'v.a')])[0]} as score
       from f2 t join f1 u on u.lang = t.lang and u.u = t.u join f1 v on v.lang = t.lang and v.u = t.v
       left join longer g on g.lang = t.lang and g.u = t.u and g.v = t.v where coalesce(100 * g.b < {share} * t.a, true)),
c3 as (select t.lang, t.u || ' ' || t.v || ' ' || t.w as phrase, t.a, case when {s[0]} <= {s[1]} then u.a else uv.a end as l,
              case when {s[0]} <= {s[1]} then vw.a else w.a end as r, least({s[0]}, {s[1]}) as score
       from f3 t join f1 u on u.lang = t.lang and u.u = t.u join f1 w on w.lang = t.lang and w.u = t.w
       join f2 uv on uv.lang = t.lang and uv.u = t.u and uv.v = t.v
       join f2 vw on vw.lang = t.lang and vw.u = t.v and vw.v = t.w),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
      from (select * from c2 union all select * from c3))
select lang, rank, phrase, a, l, r, n, score::bigint as score from k join n using (lang) where rank <= {top}"""
