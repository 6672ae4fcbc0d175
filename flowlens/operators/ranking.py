"""Global order without a single-task window (the "rank helper").

``Window.orderBy`` without ``partitionBy`` moves every row into one task; at
scale that is never acceptable. Instead:

1. ``repartitionByRange`` on the order key spreads the rows over N ordered
   partitions (sampled bounds), ``sortWithinPartitions`` orders each one;
2. the partition id and the in-partition position
   (``monotonically_increasing_id`` = pid << 33 | row) are materialised and the
   frame is checkpointed to the reliable checkpoint directory, so both passes
   below see the very same partitioning even if executors are lost;
3. per-partition counts / sums (one row per partition, bounded by N) give
   prefix offsets, joined back by broadcast;
4. running sums inside a partition are computed by an Arrow ``mapInPandas``
   (numpy cumsum over the already-sorted batches).

Single order statistics (quantiles, exact cuts) need no order: ``selection`` counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .selection import kth

_ROW_BITS = 33


def ranged(df: DataFrame, order: list[Column], n_parts: int | None = None) -> DataFrame:
    """Range-partitioned, sorted, checkpointed frame with ``_pid`` and ``_pos``
    (0-based position inside the partition)."""
    ensure_checkpoint_dir(df.sparkSession)
    # without an explicit count AQE sizes the range shuffle (coalescing only
    # merges adjacent ranges, so the partition order stays the global order)
    r = df.repartitionByRange(n_parts, *order) if n_parts else df.repartitionByRange(*order)
    r = r.sortWithinPartitions(*order)
    r = r.withColumn("_pid", F.spark_partition_id())
    r = r.withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS))
    return r.checkpoint(eager=True)


def partition_offsets(r: DataFrame, sums: dict[str, Column] | None = None,
                      group: list[str] | None = None) -> DataFrame:
    """One row per (group..., partition): row count and sums plus their
    exclusive prefix over the partition order. Bounded by groups x partitions."""
    group = group or []
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [v.alias(k) for k, v in (sums or {}).items()]
    per = r.groupBy(*group, "_pid").agg(*aggs)
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if group \
        else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = {"_off_cnt": F.coalesce(F.sum("_cnt").over(w), F.lit(0))}
    for k in (sums or {}):
        cols[f"_off_{k}"] = F.coalesce(F.sum(k).over(w), F.lit(0))
    return per.withColumns(cols)


def quantile_linear(df: DataFrame, col: str, q: float) -> float | None:
    """numpy ``percentile(..., linear)`` / DuckDB ``quantile_cont``: exact, from
    the two neighbouring order statistics."""
    def ks(n):
        pos = q * (n - 1)
        return [math.floor(pos), math.ceil(pos)]
    n, found = kth(df, [F.col(col).cast("double")], ks)[0]
    if n == 0:
        return None
    pos = q * (n - 1)
    lo, hi = found[math.floor(pos)].value, found[math.ceil(pos)].value
    return lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))


def nearest_rank(q: float, n: int) -> int:
    return int(math.floor(q * (n - 1) + 0.5))


def quantile_nearest(df: DataFrame, col: str, q: float) -> float | None:
    """pandas ``quantile(q, interpolation='nearest')`` (ties of the fraction round up)."""
    return nearest_quantiles_stacked(df, [col], q)[col]


def nearest_quantiles_stacked(df: DataFrame, cols: list[str], q: float) -> dict:
    """Nearest-rank quantile of several columns in the same counting passes."""
    found = kth(df, [F.col(c).cast("double") for c in cols], lambda n: [nearest_rank(q, n)])
    return {c: values[nearest_rank(q, n)].value if n else None for c, (n, values) in zip(cols, found)}


def ordered_running_sums(df: DataFrame, order: list[Column], sum_cols: list[str],
                         n_parts: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` (inclusive running sum in the global order) for each
    column. Offsets come from per-partition totals; in-partition sums from an
    Arrow ``mapInPandas`` over the sorted partition."""
    r = ranged(df, order, n_parts)
    sums = {f"_t_{c}": F.sum(c) for c in sum_cols}
    off = partition_offsets(r, sums).select("_pid", *[f"_off__t_{c}" for c in sum_cols])
    fields = list(r.schema.fields) + [T.StructField(f"_loc_{c}", T.DoubleType()) for c in sum_cols]
    schema = T.StructType(fields)

    def local_cumsum(batches):
        carry = {c: 0.0 for c in sum_cols}
        for pdf in batches:
            for c in sum_cols:
                vals = pdf[c].astype("float64").fillna(0.0)
                cs = vals.cumsum() + carry[c]
                pdf[f"_loc_{c}"] = cs
                if len(cs):
                    carry[c] = float(cs.iloc[-1])
            yield pdf

    loc = r.mapInPandas(local_cumsum, schema)
    out = loc.join(F.broadcast(off), "_pid")  # one row per partition
    return out.withColumns({f"cum_{c}": F.col(f"_loc_{c}") + F.col(f"_off__t_{c}") for c in sum_cols}) \
        .drop(*[f"_loc_{c}" for c in sum_cols], *[f"_off__t_{c}" for c in sum_cols])

