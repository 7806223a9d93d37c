"""A training-data pipeline over ``documents``: each stage's table is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, pieces, shingles, substrings
from lodestone.llm.common import WORD, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told (operator 9); ``lang`` stays as it was given, rejected documents go."""
    kept = langid.identify(docs, langid.fit(docs), *COLUMNS)
    return kept.where(~kept["rejected"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with a similarity of 0.8 or more in five-word shingles link (operator 7):
    wide SimHash fingerprints are compared tile by tile, and what they find is counted exactly."""
    return shingles.keep_one(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines and passages that an earlier one has (operator 4); those left without a word go."""
    found = substrings.drop_repeats(docs, lines=True).withColumn("n_chars", F.char_length("text").cast("long"))
    return found.where((F.size("removed") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 2)."""
    return mixing.mixed(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 5), beside its columns but the text; ``same``: they decode to the text again."""
    return pieces.tokenise(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: Trained models and iterated solutions can't be put in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
