"""Session settings and written intermediate tables of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir, scratch_dir

#: rows of one Arrow batch handed to Python; long documents make wide rows
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure the shared folder is known."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ensure_checkpoint_dir(spark)
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from
    the files, so a lost executor costs no recomputation of earlier stages."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more, and let Spark clean up the
    shuffle files of the jobs before."""
    for table in tables:
        spark, path = table.sparkSession, table.staged_path
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
