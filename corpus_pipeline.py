"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() stores each stage's rows as
Parquet and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnrisk.llm import language, mixing, near_duplicates, packing, secrets
from txnrisk.session import shared_folder, stage


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was identified."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows.

    Rows are carried whole beside their text, so that no column of theirs is mistaken for one of the scan. A null text
    stays null, an empty one empty; repeated rows are masked alike; no rows give none.
    """
    found = secrets.scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), secrets.train(docs.select("doc_id", "text")))
    changed = F.size("spans") > 0
    text = F.when(changed, secrets.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    kept = found.select("row", changed.alias("changed"), text.alias("text"))
    counted = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": counted}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their ids (binary, little-endian unsigned 32-bit) and their
    places in packed sequences.

    A null or empty text is a piece of the end id alone; repeated rows are packed once each; no rows
    give none. Places are worked out without the ids, which join them by the piece's number. Equal
    pieces are interchangeable, so that number is drawn once, when the pieces are stored.
    """
    parts = packing.pieces(docs).withColumns({"ids_crc32": F.crc32("ids"), "number": F.monotonically_increasing_id()})
    stored = stage(parts, "pieces")
    placed = packing.place(stored.drop("ids"), ["number"])
    return placed.join(stored.select("number", "ids"), "number").drop("number")


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
    ("pack", pack),
]

#: No stage but the masking can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
