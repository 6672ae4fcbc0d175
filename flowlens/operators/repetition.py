"""Repetition key and the 45-second repetition count.

Batch form of the per-key deque: for every anomalous event, the number of
earlier anomalous events with the same key inside the last 45 seconds
(inclusive), capped at 50.

Because of the cap a row needs no more than the 50 rows before it in the order
(key, time, sequence). So the anomalous rows are range-partitioned and sorted in
that order, each task looks back within its range, and only the first 50 rows of a
range are looked up again among the last 50 rows of the ranges before it: at most
100 rows per partition meet there, whatever the key holds. A key that holds half of
all rows within a minute is cut by the range bounds like any other stretch of rows.
Rows that are not anomalous take no part and go around the shuffle.

``before`` continues a count: rows of earlier calls that are still in their key's
deque (``carried``). The micro-batches of the live job use it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..session import scratch_dir

REPEAT_COLUMNS = ["repetition_key", "repeat_previous_count", "repeat_count", "repeat_level",
                  "repeat_boost", "is_repeated", "repeat_window_s"]


def repeat_key_expr(src_ip="src_ip", dest_ip="dest_ip", proto="proto",
                    traffic_class="traffic_class", dest_port="dest_port") -> Column:
    """(src_ip, dest_ip, PROTO, class, port); '?' for empty text, port 0 when
    missing, unparsable, or the class is local_discovery / dns."""
    def txt(c):
        v = F.col(c).cast("string")
        return F.when(v.isNull() | (v == ""), F.lit("?")).otherwise(v)

    cls = F.lower(F.when(F.col(traffic_class).isNull() | (F.col(traffic_class) == ""),
                         F.lit("unknown")).otherwise(F.col(traffic_class)))
    port = F.coalesce(F.col(dest_port).cast("string").try_cast("int"), F.lit(0))
    port = F.when(cls.isin("local_discovery", "dns"), F.lit(0)).otherwise(port)
    return F.struct(txt(src_ip).alias("src_ip"), txt(dest_ip).alias("dest_ip"),
                    F.upper(txt(proto)).alias("proto"), cls.alias("traffic_class"),
                    port.alias("dest_port"))


def repeat_level_expr(prev: Column) -> Column:
    return (F.when(prev <= 0, "single")
            .when(prev < fixed.REPEAT_PERSISTENT_PREV_COUNT, "repeated")
            .otherwise("persistent"))


_NAME = ["_lb_k1", "_lb_k2"]                       # 128 bits that name the key
_SORT = [*_NAME, "_lb_new", "_lb_ord", "_lb_ts"]   # then the sequence; carried rows come first
_ADDED = [T.StructField("_lb_part", T.IntegerType()), T.StructField("_lb_pos", T.LongType()),
          T.StructField("_lb_prev", T.IntegerType()), T.StructField("_lb_head", T.BooleanType()),
          T.StructField("_lb_edge", T.BooleanType())]
BEFORE_SCHEMA = "_lb_k1 long, _lb_k2 long, _lb_ord int, _lb_ts double"


def key_name(key: Column) -> list[Column]:
    fields = [key[f] for f in ("src_ip", "dest_ip", "proto", "traffic_class", "dest_port")]
    return [F.xxhash64(*fields).alias("_lb_k1"), F.xxhash64(F.lit("repeat"), *fields).alias("_lb_k2")]


def look_back(k1, k2, ts, window_s: float, cap: int) -> np.ndarray:
    """Per row the distance to the oldest of the ``cap`` rows before it that has its key
    and is not older than ``window_s``: the deque's length. Older rows ahead of that
    one have left the deque."""
    n = len(ts)
    new = np.ones(n, dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    run = np.arange(n) - start
    prev = np.zeros(n, dtype=np.int32)
    for lag in range(1, min(cap, int(run.max(initial=0))) + 1):
        at = np.flatnonzero(run >= lag)
        at = at[ts[at - lag] >= ts[at] - window_s]
        prev[at] = lag
    return prev


def _scan_fn(schema: T.StructType, window_s: float, cap: int):
    """Look-back within one sorted partition. The first rows of its first key are marked
    (``_lb_head``); at the end come copies of the last rows of its last key
    (``_lb_edge``, nothing but name, time and place)."""
    names = [f.name for f in schema.fields]
    k1_at, k2_at, ts_at = (names.index(c) for c in (*_NAME, "_lb_ts"))

    def run(batches):
        part, pos, first = TaskContext.get().partitionId(), 0, None
        k1 = k2 = np.empty(0, dtype=np.int64)
        ts = np.empty(0)
        types = None
        for batch in batches:
            n, kept = batch.num_rows, len(ts)
            if not n:
                continue
            types = [c.type for c in batch.columns]
            k1 = np.concatenate([k1, batch.column(k1_at).to_numpy()])
            k2 = np.concatenate([k2, batch.column(k2_at).to_numpy()])
            ts = np.concatenate([ts, batch.column(ts_at).to_numpy(zero_copy_only=False)])
            prev = look_back(k1, k2, ts, window_s, cap)[kept:]
            if first is None:
                first = (k1[0], k2[0])
            at = np.arange(pos, pos + n)
            head = (at < cap) & (k1[kept:] == first[0]) & (k2[kept:] == first[1])
            pos += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(at), pa.array(prev),
                 pa.array(head), pa.array(np.zeros(n, dtype=bool))], names=names)
            k1, k2, ts = k1[-cap:], k2[-cap:], ts[-cap:]
        if first is None:
            return
        last = np.flatnonzero((k1 == k1[-1]) & (k2 == k2[-1]))
        n = len(last)
        columns = [pa.nulls(n, t) for t in types]
        columns[k1_at], columns[k2_at], columns[ts_at] = pa.array(k1[last]), pa.array(k2[last]), pa.array(ts[last])
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(pos - len(ts) + last),
             pa.nulls(n, pa.int32()), pa.array(np.zeros(n, dtype=bool)), pa.array(np.ones(n, dtype=bool))], names=names)
    return run


def _border_counts(scanned: DataFrame, window_s: float, cap: int) -> DataFrame:
    """``_lb_part, _lb_pos, _lb_again``: the counts of the first rows of each partition,
    from these and the last rows of the partitions before (``2 * cap`` a partition)."""
    place = ["_lb_part", "_lb_pos"]
    rows = scanned.where(F.col("_lb_head") | F.col("_lb_edge")).select(*_NAME, *place, "_lb_ts", "_lb_head")
    rows = rows.groupBy(*place).agg(*(F.first(c).alias(c) for c in (*_NAME, "_lb_ts")), F.max("_lb_head").alias("_lb_head"))
    back = Window.partitionBy(*_NAME).orderBy(*place).rowsBetween(-cap, -1)
    rows = rows.withColumn("_lb_list", F.collect_list("_lb_ts").over(back)).where("_lb_head")
    inside = F.expr(f"array_position(transform(_lb_list, t -> t >= _lb_ts - {float(window_s)!r}D), true)").cast("int")
    return rows.select(*place, F.when(inside > 0, F.size("_lb_list") - inside + 1).otherwise(0).alias("_lb_again"))


def counted(rows: DataFrame, ts_col: str, seq_col: str, window_s: float, cap: int, before: DataFrame | None = None,
            n_parts: int | None = None) -> DataFrame:
    """``rows`` (all anomalous, with ``repetition_key``) and, with null columns, the rows of
    ``before``, each with ``_lb_prev`` and its place in the order. Written to the shared
    folder (``staged_path``), so that both readers below see the same partitions."""
    src = rows.withColumns({"_lb_new": F.lit(1), "_lb_ord": F.lit(None).cast("int"),
                            "_lb_ts": F.col(ts_col).cast("double")}).select("*", *key_name(F.col("repetition_key")))
    if before is not None:
        src = src.unionByName(before.withColumn("_lb_new", F.lit(0)), allowMissingColumns=True)
    src = src.withColumn("_lb_row", F.monotonically_increasing_id())  # parts equal rows; equal, so in any order
    order = [*_SORT, seq_col, "_lb_row"]
    spread = src.repartitionByRange(n_parts, *order) if n_parts else src.repartitionByRange(*order)
    spread = spread.sortWithinPartitions(*order).drop("_lb_row")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in spread.schema.fields] + _ADDED)
    path = scratch_dir(rows.sparkSession, "repetition")
    spread.mapInArrow(_scan_fn(schema, window_s, cap), schema).write.parquet(path)
    scanned = rows.sparkSession.read.schema(schema).parquet(path)
    again = _border_counts(scanned, window_s, cap)
    heads = scanned.where("_lb_head").join(again, ["_lb_part", "_lb_pos"], "left")
    heads = heads.withColumn("_lb_prev", F.coalesce("_lb_again", "_lb_prev")).select(*schema.names)
    out = scanned.where("not _lb_edge and not _lb_head").unionByName(heads).drop("_lb_edge", "_lb_head")
    out.staged_path = path
    return out


def carried(found: DataFrame, cap: int, horizon: float | None = None) -> DataFrame:
    """``BEFORE_SCHEMA``: what is left in the deque of every key of ``counted`` rows, at most
    ``cap`` each; keys whose newest row is older than ``horizon`` are forgotten."""
    newest = Window.partitionBy(*_NAME).orderBy(F.desc("_lb_part"), F.desc("_lb_pos"))
    rows = found.select(*_NAME, "_lb_new", "_lb_part", "_lb_pos", "_lb_ts", "_lb_prev").withColumn(
        "_lb_rn", F.row_number().over(newest)).where(F.col("_lb_rn") <= cap)
    key = Window.partitionBy(*_NAME)
    length = F.max(F.when((F.col("_lb_rn") == 1) & (F.col("_lb_new") == 1), F.least(F.col("_lb_prev") + 1, F.lit(cap)))).over(key)
    rows = rows.withColumns({"_lb_len": length, "_lb_max": F.max("_lb_ts").over(key)})
    rows = rows.where(F.col("_lb_rn") <= F.coalesce("_lb_len", F.lit(cap)))  # an untouched key keeps all it had
    if horizon is not None:
        rows = rows.where(F.col("_lb_max") >= F.lit(float(horizon)))
    return rows.select(*_NAME, (-F.col("_lb_rn")).cast("int").alias("_lb_ord"), "_lb_ts")


def with_levels(df: DataFrame, window_s: float, cap: int) -> DataFrame:
    """The columns that follow from ``is anomalous`` (a key is there) and the previous count."""
    prev = F.col("repeat_previous_count")
    out = df.withColumns({
        "repeat_count": F.when(F.col("repetition_key").isNotNull(), F.least(prev + 1, F.lit(cap))).otherwise(0).cast("int"),
        "repeat_level": repeat_level_expr(prev),
        "repeat_window_s": F.lit(int(window_s)),
        "is_repeated": prev > 0,
    })
    return out.withColumn("repeat_boost", F.when(F.col("repeat_level") == "single", 0)
                          .when(F.col("repeat_level") == "repeated", 1).otherwise(2))


def attach_repetition(df: DataFrame, ts_col: str = "ts_unix", seq_col: str = "flow_id", anom_col: str = "is_anom",
                      window_s: int = fixed.REPEAT_WINDOW_S, cap: int = fixed.REPEAT_MAX_EVENTS_PER_KEY,
                      before: DataFrame | None = None, n_parts: int | None = None,
                      keep: list | None = None) -> DataFrame:
    """F02 over a frame with ``traffic_class`` and the event columns. Null times come
    first and are counted as never inside a window. With ``keep`` (a list) the counted
    rows are appended to it, for ``carried``."""
    anom = F.coalesce(F.col(anom_col), F.lit(False))
    rows = df.where(anom).withColumn("repetition_key", repeat_key_expr())
    found = counted(rows, ts_col, seq_col, window_s, cap, before, n_parts)
    if keep is not None:
        keep.append(found)
    hot = found.where("_lb_new = 1").withColumn("repeat_previous_count", F.col("_lb_prev")).select(
        *df.columns, "repetition_key", "repeat_previous_count")
    quiet = df.where(~anom).withColumns({
        "repetition_key": F.lit(None).cast(rows.schema["repetition_key"].dataType),
        "repeat_previous_count": F.lit(0)})
    return with_levels(hot.unionByName(quiet), window_s, cap)
