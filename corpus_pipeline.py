"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark
decontamination, packing. ``STAGES`` lists them; each works on all that its
predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from flowlens.llm.common import documents, prepare, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a character of a word
WORD = r"[^ \t\n\x0B\f\r]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go. Rows that share a key are judged each by
    its own text; the texts are measured again rather than joined."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    _, rules = quality_rules.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = quality_rules.measured(docs.withColumn("_body", F.col("text")))
    kept = rows.where(~quality_rules.base_failed() & quality_rules.verdict(rules).isNull())
    return kept.withColumnRenamed("_body", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group the document of the smallest id stays (one row of
    it, if the row is repeated or the id has several texts in the group). Rows
    that share an id, or have none, but are in different groups stay each."""
    prepare(spark)
    found = near_dedup.survivors(docs.select(*COLUMNS)).select(F.col("doc_id").alias("_d"), F.col("name").alias("_n"))
    some = F.coalesce("text", F.lit("")).rlike(WORD)
    named = docs.where(some).withColumn("_name", near_dedup.text_name(F.col("text")))
    alone = named.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_name") == F.col("_n")),
                       "left_semi").dropDuplicates(["_name"])
    return alone.select(*COLUMNS).unionByName(docs.where(~some).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated 200-byte passages are cut out (whole
    characters only); documents of which nothing but white space is left go."""
    prepare(spark)
    out = suffix_dedup.repeated_spans(docs.select(*COLUMNS), characters=True)
    out = out.withColumn("text", F.decode("kept", "UTF-8")).where(
        (F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: contaminated documents go."""
    prepare(spark)
    rows = docs.select(*COLUMNS).withColumn("_body", F.col("text"))
    found = decontaminate.scan(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    prepare(spark)
    cut = staged(packing.pieces(docs), "pieces").withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(cut.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                                "offset")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: learned rules and token ids are beyond SQL; the tests hold the result against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
