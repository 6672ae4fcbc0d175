"""Labelled and feature CSV files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .zeek import with_place

def read_labelled_csv(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """Header CSV with a configurable separator, all columns as text. Each file is UTF-8, or,
    if any of its lines is not, ISO-8859-1 as a whole; the lines are read as bytes once and
    decoded by their file's flag. All files must have the same header."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_at"))
    raw = with_place(raw, F.col("_at")).drop("_at")
    place = F.struct("_split", "_row")
    files = raw.groupBy(F.col("_file").alias("_f")).agg(
        F.max(~F.is_valid_utf8("value")).alias("_latin"), F.min(place).alias("_first"), F.min_by("value", place).alias("_head"))
    heads = files.select(_decoded("_head").alias("h")).distinct().limit(2).collect()
    if not heads:
        return spark.createDataFrame([], "value string")
    if len(heads) > 1:
        raise ValueError("the files have different headers")
    names = next(csv.reader([heads[0]["h"]], delimiter=sep))
    # one row per file; AQE makes it a broadcast join where that is small
    rows = raw.join(files, raw["_file"] == files["_f"]).where(place > F.col("_first"))
    text = rows.select(_decoded("value").alias("value")).where(F.length("value") > 0)
    return text.select(F.from_csv("value", _ddl(names), {"sep": sep}).alias("_r")).select("_r.*")


def _decoded(column: str) -> Column:
    return F.when(F.col("_latin"), F.decode(F.col(column).cast("binary"), "ISO-8859-1")).otherwise(F.col(column))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def read_feature_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    """Header CSV; explicit schema preferred, inference only when none is given."""
    r = spark.read.option("header", "true")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


def parse_csv_lines(lines: DataFrame, ddl: str, sep: str = ",", value_col: str = "value") -> DataFrame:
    """CSV text already in a DataFrame column -> typed columns (``from_csv``)."""
    parsed = lines.select(F.from_csv(F.col(value_col), ddl, {"sep": sep}).alias("_r"))
    return parsed.select("_r.*")
