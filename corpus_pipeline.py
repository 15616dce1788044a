"""A training-data pipeline over `documents`: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import language, packing, pii, simhash, substrings
from adloom.llm.common import drop_saved, mark, new_path, small_batches
from adloom.llm.queries import KEY, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without text or a letter, mostly in letters of no profile, or under the least score. What is
    learned comes from the labelled documents; lang becomes the predicted language."""
    small_batches(spark)
    found = language.identify(docs, language.learn(docs), COLUMNS, language.LEAST)
    kept = found.where(F.col("lang_pred") != language.UNKNOWN)
    return _columns(kept.withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Documents without doc_id stay, null
    and blank texts are one group, of rows that repeat a doc_id one stays, no rows give none."""
    small_batches(spark)
    return _columns(simhash.keep_one(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of which nothing is left go, and so do null texts."""
    small_batches(spark)
    cut = substrings.dedup(docs)
    return _columns(cut.where(F.trim("text") != ""))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data. Each row stands alone: null and empty texts, repeated rows and no rows pass as they are."""
    return _columns(pii.pseudonymise(docs, KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens. Null texts are empty ones, repeated rows are packed each for itself, no rows give
    no sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 4096, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", private_data),
    ("best-fit packing", packed),
]

#: Language profiles, fingerprints and token ids can't be written in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder and read again, and its intermediate tables are deleted."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        since = mark(spark)
        docs = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage{i}")
        docs.write.parquet(path)
        drop_saved(spark, since)
        docs = spark.read.parquet(path)
    return docs
