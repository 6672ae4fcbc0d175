"""The k-th smallest value by counting: no sort, no shuffle of the data, no checkpoint.

Every pass deals the values between two bounds into ``BUCKETS`` equal steps and counts
them (added up before the shuffle: a row per task, target and step). The step that
holds the wanted rank gives the next bounds, its smallest and largest value, until both
are the same. So ties cost nothing, whatever their share, and a pass reads the data
once for all columns and ranks together. The driver sees ``BUCKETS`` counts per target.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Found:
    """A value, the number of values below it and equal to it."""
    value: float | int
    below: int
    equal: int


@dataclass
class _Target:
    column: int
    rank: int
    lo: float | int
    hi: float | int
    below: int
    n: int


def _step(t: _Target, whole: bool) -> Column:
    """Which of the steps between the target's bounds a value is in."""
    c = f"_c{t.column}"
    if whole:
        width = (t.hi - t.lo) // BUCKETS + 1
        return F.expr(f"int((cast({c} as decimal(20,0)) - {t.lo}BD) div {width}BD)")
    v, lo, hi = F.col(c), t.lo, t.hi
    if math.isinf(hi - lo):
        v, lo, hi = v / F.lit(2.0), lo / 2, hi / 2
    return F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(BUCKETS))).cast("int"), F.lit(BUCKETS - 1))


def kth(df: DataFrame, columns: list[Column], ranks: Callable[[int], list[int]]) -> list[tuple[int, dict[int, Found]]]:
    """For each column ``(n, {rank: Found})``: ``n`` values (nulls left out) and those of the 0-based
    ranks that ``ranks(n)`` asks for, in the order -inf, finite, inf, NaN."""
    x = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    whole = [isinstance(f.dataType, _WHOLE) for f in x.schema.fields]
    x = x.select(*[F.col(f"_c{i}").cast("bigint" if w else "double").alias(f"_c{i}") for i, w in enumerate(whole)])
    inf, aggs = float("inf"), []
    for i in range(len(columns)):
        c = F.col(f"_c{i}")
        odd = F.lit(False) if whole[i] else F.isnan(c) | (F.abs(c) == F.lit(inf))
        fine = F.when(~odd, c)
        aggs += [F.count(c).alias(f"n{i}"), F.count(fine).alias(f"f{i}"), F.min(fine).alias(f"lo{i}"), F.max(fine).alias(f"hi{i}"),
                 F.count(F.when(c == F.lit(-inf), 1)).alias(f"m{i}"), F.count(F.when(c == F.lit(inf), 1)).alias(f"p{i}")]
    first = x.agg(*aggs).first()
    out: list[tuple[int, dict[int, Found]]] = []
    open_: list[tuple[_Target, dict[int, Found], int]] = []
    for i in range(len(columns)):
        n, fine, minus, plus = (int(first[f"{k}{i}"]) for k in "nfmp")
        found: dict[int, Found] = {}
        for k in sorted(set(ranks(n))) if n else []:
            if k < minus:
                found[k] = Found(-inf, 0, minus)
            elif k >= minus + fine + plus:
                found[k] = Found(float("nan"), minus + fine + plus, n - minus - fine - plus)
            elif k >= minus + fine:
                found[k] = Found(inf, minus + fine, plus)
            else:
                open_.append((_Target(i, k, first[f"lo{i}"], first[f"hi{i}"], minus, fine), found, k))
        out.append((n, found))
    while open_:
        for t, found, k in open_:
            if t.lo == t.hi:
                found[k] = Found(t.lo, t.below, t.n)
        open_ = [o for o in open_ if o[0].lo != o[0].hi]
        if not open_:
            break
        hits = []
        for j, (t, _, _) in enumerate(open_):
            c = F.col(f"_c{t.column}")
            inside = c.between(F.lit(t.lo), F.lit(t.hi))
            hits.append(F.when(inside, F.struct(F.lit(j).alias("j"), _step(t, whole[t.column]).alias("s"),
                                                F.lit(t.column).alias("i"))))
        hit = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
        both = x.select(*x.columns, hit)
        low, high = [], []
        for i, w in enumerate(whole):
            v = F.when(F.col("h.i") == i, F.col(f"_c{i}"))
            low.append(F.min(v).alias(f"lo{i}"))
            high.append(F.max(v).alias(f"hi{i}"))
        rows = both.groupBy("h.j", "h.s").agg(F.count("*").alias("n"), *low, *high).collect()
        for j, (t, _, _) in enumerate(open_):
            for r in sorted((r for r in rows if r["j"] == j), key=lambda r: r["s"]):
                if t.rank < t.below + r["n"]:
                    t.lo, t.hi, t.n = r[f"lo{t.column}"], r[f"hi{t.column}"], r["n"]
                    break
                t.below += r["n"]
    return out


def first_rows(df: DataFrame, keys: list[Column], k: int, out_col: str) -> DataFrame:
    """``df`` with ``out_col``, true for exactly ``k`` rows (all, if there are fewer): the first by
    ``keys`` (whole numbers, not null). Rows equal in all keys are told apart by their other
    columns, and rows that are equal in those too by their place."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*keys, F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.monotonically_increasing_id()]
    names = [f"_sel{i}" for i in range(len(keys))]
    x = df.withColumns(dict(zip(names, keys)))
    taken, tied = F.lit(False), F.lit(k > 0)
    for name in names:
        if k <= 0:
            break
        _, found = kth(x.where(tied), [F.col(name)], lambda n: [k - 1] if k <= n else [])[0]
        if not found:  # fewer rows than asked for
            break
        at = found[k - 1]
        taken = taken | (tied & (F.col(name) < F.lit(at.value)))
        tied = tied & (F.col(name) == F.lit(at.value))
        k -= at.below
        if k == at.equal:
            break
    return x.withColumn(out_col, taken | tied).drop(*names)
