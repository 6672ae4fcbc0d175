"""Sinks.

All writers take a DataFrame and a path; column order is fixed by the caller's
list; writes are idempotent per path (``overwrite``) except the append-only
prediction log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header in a fixed column order."""
    out = df.select(*(columns or df.columns))
    out.write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (the prediction-log record form)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def append_prediction_log(df: DataFrame, path: str, partition_col: str | None = "log_date") -> None:
    """Append-only JSON log; partitioned by UTC date of ``ts_unix`` so
    readers prune by day."""
    out = df
    if partition_col and "ts_unix" in df.columns:
        out = df.withColumn(partition_col, F.to_date(F.timestamp_seconds(F.col("ts_unix"))))
        out.write.mode("append").partitionBy(partition_col).json(path)
    else:
        out.write.mode("append").json(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A10: one-row metrics or per-epoch history as JSON or CSV (single file)."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.json(path)
