"""The operators of this subpackage as named queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk.llm import (
    extraction, fingerprints, language, line_dedup, mixing, near_duplicates, packing, prefix_trie, secrets, sharding, spelling,
    sql, token_files, vectors,
)
from txnrisk.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(stage(parts, "pieces"), ["doc_id", "piece", "start", "ids_crc32"])


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(_table(spark, sf_dir, "pages"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.take_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def number(kind: str):
        rank = secrets.KINDS.index(kind)
        return F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["rank"] < secrets.KINDS.index("random"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(secrets.written(base), 256).alias("base_sha256"),
                        secrets.written(F.col("spans")).alias("spans"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_extendible_sharding": op2_extendible_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_mix_sources": op5_mix_sources,
    "op6_winnowing": op6_winnowing,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    # rows of these tables differ in doc_id or text, so the bits of row numbers are not needed
    "op2_extendible_sharding": sql.SHARDING,
    "op11_spelling_variants": sql.SPELLING_VARIANTS,
    "op12_conversation_trie": sql.CONVERSATION_TRIE,
    "op13_line_dedup": sql.LINE_DEDUP,
}
