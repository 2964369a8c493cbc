"""A training corpus in five stages: quality, language, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import language_id, near_dup, packing, pii, quality
from trackframe.llm.common import small_batches
from trackframe.session import checkpoint

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Neither hashed weights nor tokenizers can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is one half at least; all of them where nothing is rated.

    Null and empty texts are graded by their length, rows without an id go, columns beyond those of documents too.
    """
    small_batches(spark)
    return quality.select_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told and not against the declared one; all of them where no language is declared.

    Texts without letters (null and empty ones too) have no language and go.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = language_id.documents_view(docs).withColumn("tie", F.xxhash64("text"))
    out = checkpoint(language_id.identify(rows).filter(~F.col("kept")).select(F.col("id").alias("_id"), F.col("tie").alias("_tie")).distinct())
    return docs.join(out, (docs["doc_id"] == out["_id"]) & (tie == out["_tie"]), "left_anti").select(*COLUMNS)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates at a similarity of 0.8; different texts under one id all count."""
    return near_dup.select_distinct(docs.select(*COLUMNS), num=80)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of token ids, neighbours on the curve together; an empty text is its end id."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality classifier", good_quality), ("language identification", known_language), ("near-duplicate removal", no_near_duplicates), ("personal data", no_personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
