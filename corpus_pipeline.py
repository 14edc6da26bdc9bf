"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again by the next.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
documents, and the pieces of packed sequences from the last. ``docs`` needs doc_id and text. Its columns may be null
or bear the name of a column that an operator adds; those but text and n_chars pass through unchanged.
Every stage of an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import language_id, near_dedup, packing, pii, substring_dedup
from tallyframe.llm.common import Scratch

#: Languages are told with at least this share of the softmax (four languages alike would have a quarter).
LEAST_SCORE = 0.35
PSEUDONYM_KEY = "tallyframe"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without letters or text, or scored under ``LEAST_SCORE``.

    Learns from the labelled rows of ``docs``; without any, every document would be undetermined, so all are kept.
    Null, empty and letterless texts go; repeated rows are judged alike, each by itself.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    found = language_id.predict(spark, docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns}), model)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"__{c}": c for c in ("lang_pred", "score")}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest doc_id, of each group of near-copies (similarity 0.8 of five-word shingles).

    Texts without words are no one's copies and stay, as do rows without a doc_id; rows that repeat a doc_id stay or go
    together.
    """
    copies = near_dedup.near_duplicates(spark, docs, threshold=80).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that still occur twice; other texts stay as they are.

    Null and empty texts stay so; repeated rows of 35 words or more are copies of each other and lose those words, but
    stay as rows. A text that loses all of its words becomes empty.
    """
    own = ("kept_text", "n_words", "n_removed")
    held = docs.withColumnsRenamed({c: f"__{c}" for c in own if c in docs.columns})
    found = substring_dedup.remove_repeats(spark, held, window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return counted(found.withColumn("text", text).drop(*own).withColumnsRenamed({f"__{c}": c for c in own})).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; null texts stay null, and rows are independent of each other."""
    held = docs.withColumnsRenamed({"n_private": "__n_private"})
    return counted(pii.pseudonymise(held, PSEUDONYM_KEY).drop("n_private").withColumnsRenamed({"__n_private": "n_private"})).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens; a null or empty text is its closing token, repeated rows are packed one by one."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=1024)


def counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("repeated-passages", repeated_passages),
    ("personal-data", personal_data),
    ("packing", packed),
]
#: Training, hashing, keyed digests and byte pairs have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; an earlier stage's table goes once the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
