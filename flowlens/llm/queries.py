"""Registered queries of the subpackage: ``QUERIES`` and, where SQL can express
one, ``ORACLE``. Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (collocations, decontaminate, licenses, line_dedup, near_dedup, packing, prefix_trie, quality_rules,
                          sharding, suffix_dedup, token_counts, token_store, toxicity)
from flowlens.llm.common import documents, prepare, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))[0]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ids stay in the written pieces; their checksum is what travels
    cut = staged(packing.pieces(documents(spark, sf_dir)), "pieces").withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(cut.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                                "offset")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judged(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "rule")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.sharded(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
                       "vslot", "version")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.prefix_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(_table(prepare(spark), sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_suffix_dedup, op3_packing, op4_license_scan, op5_quality_rules, op6_sharding,
    op7_decontamination, op8_token_store, op9_near_dedup, op10_token_counts, op11_line_dedup,
    op12_conversation_trie, op13_collocations)}
ORACLE = {"op4_license_scan": licenses.duckdb_sql(), "op11_line_dedup": line_dedup.duckdb_sql(),
          "op12_conversation_trie": prefix_trie.duckdb_sql(), "op13_collocations": collocations.duckdb_sql()}
