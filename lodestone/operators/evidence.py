"""What stands behind an answer: evidence that is strong enough, confidence, numbered context, follow-up questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import cosine

LEAST_SCORE, SATURATION, PASSAGE = 0.015, 6, 900
# fixed values: words that make a question depend on the one before
FOLLOW_UP = r"(?i)\b(it|its|that|this|they|them|those|the company|the stock|same)\b"


def supported(found: DataFrame, floor: float, least: float = LEAST_SCORE) -> DataFrame:
    """Evidence (question, source, score, matched_by, similarity) of ``least`` score, for the questions that may be answered.

    A question is refused, and has no rows, unless one of its pieces of evidence has a similarity of ``floor``: a shared
    word alone vouches for nothing.
    """
    strong = found.where(F.col("score") >= least)
    sure = strong.groupBy("question").agg(F.max("similarity").alias("top")).where(F.col("top") >= floor).select("question")
    return strong.join(sure, "question", "left_semi")


def confidence(evidence: DataFrame) -> DataFrame:
    """(question, pieces, confidence): volume, strength of the best and share found by both searches; 0.95 at most."""
    n = F.count(F.lit(1))
    both = F.count_if(F.contains("matched_by", F.lit("+"))) / n
    score = 0.4 * F.least(n / SATURATION, F.lit(1.0)) + 0.35 * F.least(F.max("score") / (2 * LEAST_SCORE), F.lit(1.0)) + 0.25 * both
    return evidence.groupBy("question").agg(n.alias("pieces"), F.round(F.least(score, F.lit(0.95)), 3).alias("confidence"))


def context(evidence: DataFrame, limit: int = 8) -> DataFrame:
    """(question, context): the best ``limit`` pieces (title, published_at, text), numbered, with the first 900 characters of each."""
    order = Window.partitionBy("question").orderBy(F.desc("score"), "source")
    best = evidence.withColumn("i", F.row_number().over(order)).where(F.col("i") <= limit)
    head = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), F.lit(" ("), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("undated")), F.lit(")\n"))
    block = F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, PASSAGE))
    blocks = F.array_sort(F.collect_list(F.struct("i", block.alias("b"))))  # ``limit`` at most
    return best.groupBy("question").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def resolved(turns: DataFrame) -> DataFrame:
    """Questions of (conv_id, turn, role, text) with ``resolved``: one that points back has the question before it in front."""
    asked = turns.where(F.col("role") == "user")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    back = F.coalesce(F.col("text").rlike(FOLLOW_UP), F.lit(False))
    return asked.withColumn("__before", before).select("conv_id", "turn", F.when(back & F.col("__before").isNotNull(), F.concat_ws(" ", "__before", "text")).otherwise(F.col("text")).alias("resolved"))


def relevance_floor(corpus: DataFrame, column: str, on_topic: list[list[float]], off_topic: list[list[float]]) -> DataFrame:
    """One row (lowest_on, highest_off, floor): the similarity that parts questions on the topic from others, or null.

    The questions are a stated set: each is an expression of one scan over the corpus, never a join.
    """
    top = lambda q: F.max(cosine(F.col(column), F.array(*[F.lit(float(x)) for x in q])))
    best = corpus.agg(F.array(*map(top, on_topic)).alias("on"), F.array(*map(top, off_topic)).alias("off")).select(F.array_min("on").alias("a"), F.array_max("off").alias("b"))
    return best.select(F.round("a", 6).alias("lowest_on"), F.round("b", 6).alias("highest_off"), F.when(F.col("a") > F.col("b"), F.round((F.col("a") + F.col("b")) / 2, 3)).alias("floor"))
