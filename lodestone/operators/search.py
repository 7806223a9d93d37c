"""Keyword and vector retrieval, and their fusion by reciprocal rank."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import content_words, mentions, name_tokens
from lodestone.sources.shared import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries that are compared with all vectors in one pass: 4,096 of 64 dimensions are 2 MB.
BLOCK = 4096
#: Queries, and rows, that are compared at a time: a task's arrays are a few MB, however many there are.
TILE = 512


def vector_topk(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(query_id, key, similarity, rank): the ``k`` rows of largest cosine with each of ``queries`` (query_id, query).

    Queries go out in blocks of a bounded size; a task keeps each query's best rows of its partition by matrix products,
    and their merge is ranked by query. Vectors of another length than a query's are skipped, zero vectors score 0. Ties
    go by the key, which is an integer.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK) * 2)
    best = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "query").toArrow()
        ids, shared = own["query_id"].to_pylist(), spark.sparkContext.broadcast((own["query_id"].to_pylist(), own["query"].to_pylist()))
        if ids:
            found = vectors.select(key, column).mapInArrow(lambda bs, q=shared: nearest(bs, *q.value, k), f"query_id long, {key} long, similarity double")
            best = found if best is None else best.unionByName(found)
    if best is None:
        return spark.createDataFrame([], f"query_id long, {key} long, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(batches: Iterator[pa.RecordBatch], ids: list[int], queries: list[list[float]], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's ``k`` best rows of a partition, by similarity of 6 places and key."""
    by: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        by.setdefault(len(q), []).append(i)
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    told = {d: (np.array([ids[i] for i in at]), unit(np.array([queries[i] for i in at], dtype=float).reshape(len(at), d))) for d, at in by.items()}
    top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        size = pc.fill_null(pc.list_value_length(batch[1]), -1).to_numpy(zero_copy_only=False)
        for d, (_, q) in told.items():
            rows = np.nonzero(size == d)[0]
            for a in range(0, len(rows), TILE):
                part = pa.array(rows[a : a + TILE])
                x = unit(batch[1].take(part).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), d))
                key = batch[0].take(part).to_numpy()
                for i in range(0, len(q), TILE):
                    top[d, i] = better(top.get((d, i)), q[i : i + TILE], x, key, k)
    for (d, i), (score, key) in top.items():
        who = np.repeat(told[d][0][i : i + TILE], score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(key.ravel(), pa.int64()), pa.array(score.ravel())], names=["query_id", batch.schema.names[0], "similarity"])


def better(best: tuple[np.ndarray, np.ndarray] | None, q: np.ndarray, x: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, key) of each query's ``k`` best among ``best`` and the unit rows ``x``; queries and rows are TILE at the most."""
    score = np.round(np.einsum("qd,nd->qn", q, x), 6) + 0.0
    key = np.broadcast_to(key, score.shape)
    if best is not None:
        score, key = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], key], axis=1)
    order = np.lexsort((key, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(key, order, axis=1)


def keyword_scores(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, score): sum of (1 + ln tf) * ln(1 + N / df) over the words; rows without any are left out.

    Only the words asked for leave a text.
    """
    own = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: w.isin(words))
    tf = docs.select(key, F.explode(own).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row a word of the query
    total = docs.count()
    scored = tf.join(F.broadcast(df), "word").groupBy(key)
    return scored.agg(F.round(F.sum((1 + F.log("tf")) * F.log(1 + F.lit(total) / F.col("df"))), 6).alias("score"))


def keyword_topk(docs: DataFrame, key: str, text: str, words: list[str], k: int) -> DataFrame:
    """The ``k`` rows of largest keyword score."""
    return keyword_scores(docs, key, text, words).orderBy(F.desc("score"), key).limit(k)


def passing(rows: DataFrame, tickers: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Search results that have any of the tickers and are not older; tags are not asked here."""
    if tickers:
        rows = rows.where(F.arrays_overlap("tickers", F.array(*[F.lit(t.upper()) for t in tickers])))
    return rows if since is None else rows.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, limit: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, key, rank; the vector one with similarity), by query.

    A source's best rank in each counts. Ranks are places in the lists as they came, before sources are made one. Rows
    have the ranks, ``matched_by``, and the best similarity; ``place`` is up to ``limit``.
    """
    both = keyword.select("query_id", key, "rank", F.lit("keyword").alias("by"), F.lit(None).cast("double").alias("similarity"))
    both = both.unionByName(vector.select("query_id", key, "rank", F.lit("vector").alias("by"), "similarity"))
    best = both.groupBy("query_id", key, "by").agg(F.min("rank").alias("rank"), F.max("similarity").alias("similarity"))
    rank = lambda by: F.max(F.when(F.col("by") == by, F.col("rank"))).alias(f"{by}_rank")
    names = F.array_join(F.sort_array(F.collect_list("by")), "+").alias("matched_by")
    out = best.groupBy("query_id", key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"), names, rank("keyword"), rank("vector"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def answer_sentences(passages: DataFrame, question: str, k: int = 5, least: int = 30) -> DataFrame:
    """(citation, sentence, score): of numbered passages (citation, text), the ``k`` sentences with the largest share of
    the question's content words, in the order of citations."""
    terms = content_words(F.lit(question))
    each = passages.select("citation", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("nth", "sentence")).withColumn("sentence", F.trim("sentence"))
    each = each.where(F.length("sentence") >= least)
    hit = F.try_divide(F.size(F.array_intersect(terms, content_words(F.col("sentence")))), F.size(terms))
    top = each.withColumn("score", F.round(hit, 6)).where("score > 0").orderBy(F.desc("score"), "citation", "nth").limit(k)
    return top.orderBy("citation", "nth").select("citation", "nth", "sentence", "score")


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Rows of ``left`` with those of ``right`` whose ``at`` lies in [low, high] of the left row, by days.

    Each left row goes to the days that its interval touches, and one equi join on the day replaces a range join.
    """
    days = left.withColumn("__day", F.explode(F.sequence(F.to_date(low), F.to_date(high))))
    return days.join(right.withColumn("__day", F.to_date(at)), "__day").where(F.col(at).between(F.col(low), F.col(high))).drop("__day")


#: Events that are alike in these have the same news.
KINDS = ["close_at", "symbol", "name", "direction"]
#: Hours before a close and after it in which articles count.
BEFORE, AFTER = 72, 24


def windows(rows: DataFrame) -> DataFrame:
    """``rows`` (close_at) with low and high: from when to when articles count."""
    return rows.withColumn("low", F.col("close_at") - F.expr(f"interval {BEFORE} hours")).withColumn("high", F.col("close_at") + F.expr(f"interval {AFTER} hours"))


def candidates(events: DataFrame, news: DataFrame, most: int) -> DataFrame:
    """(close_at, article): the ``most`` newest articles in the window of each distinct close, whoever's they are.

    Events of one close share them. Each day's ``most`` newest articles up to every hour are enough for any close, but
    closes are few (one a day), so each meets its days' articles.
    """
    closes = windows(events.select("close_at").distinct())
    met = range_join(closes, news.select("article", "published_at"), "published_at", "low", "high")
    newest = Window.partitionBy("close_at").orderBy(F.desc("published_at"), "article")
    return met.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most).select("close_at", "article")


def correlate(events: DataFrame, news: DataFrame, most: int = 40, top: int = 3) -> DataFrame:
    """The best news of each event (event_id, symbol, name, close_at, direction), three at most.

    ``news``: article (a key), published_at, title, summary, tickers, tags, label. Candidates are the newest 40 in the
    window of the close. Score: 0.20 the source files it under the symbol, 0.30 title or summary name the symbol or a
    word of the name, 0.25 recency, 0.20 the sentiment agrees, 0.05 it has tags; articles without the first two and
    without tags go.

    Events of one kind (KINDS) are scored once, see ``by_kind``.
    """
    few = by_kind(events, news, most, top)
    return events.select("event_id", *KINDS).alias("a").join(few.alias("b"), alike(KINDS)).select("event_id", *[F.col(f"b.{c}") for c in few.columns if c not in KINDS])


def alike(columns: list[str]) -> Column:
    """Rows ``a`` and ``b`` are the same in ``columns``, null or not."""
    return functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])


def by_kind(events: DataFrame, news: DataFrame, most: int | None = None, top: int = 3) -> DataFrame:
    """The best news of each kind of events (KINDS), of all articles in the window of their close; with ``most`` of the newest
    so many, as ``correlate`` tells them.

    Texts are read for names in one pass, those of the windows' days alone (or of candidates); pairs of kind and article carry
    no text, and titles join the ``top`` that stay.
    """
    kinds = KINDS
    asked = events.select(*kinds).distinct()
    near = None if most is None else kept(candidates(events, news, most), "candidates")
    if near is None:
        days = windows(events.select("close_at").distinct()).select(F.explode(F.sequence(F.to_date("low"), F.to_date("high"))).alias("__day")).distinct()
        news = news.join(days, F.to_date("published_at") == F.col("__day"), "left_semi")
    else:
        news = news.join(near.select("article").distinct(), "article", "left_semi")
    told = F.array_compact(F.concat(F.array(F.lower("symbol")), F.coalesce(name_tokens(F.col("name")), F.array().cast("array<string>"))))
    surfaces = asked.select("symbol", "name").distinct().select(F.explode(told).alias("surface")).distinct()
    said = news.select("article", F.concat("title", F.lit(" "), F.coalesce("summary", F.lit(""))).alias("said"))
    hits = mentions(said, "article", "said", surfaces.select("surface", F.col("surface").alias("entity")), whole=False).groupBy("article").agg(F.collect_set("entity").alias("hits"))
    own = news.select("article", "published_at", F.transform("tickers", lambda t: F.upper(t)).alias("tickers"), (F.size("tags") > 0).alias("tagged"), "label").join(hits, "article", "left")
    asked = asked.withColumn("told", told)
    met = range_join(windows(asked), own, "published_at", "low", "high") if near is None else asked.join(near.join(own, "article"), "close_at")
    hours = (F.unix_timestamp("close_at") - F.unix_timestamp("published_at")) / 3600
    recency = F.when(hours >= 0, F.greatest(F.lit(0.0), 1 - hours / BEFORE)).otherwise(0.5 * F.greatest(F.lit(0.0), 1 + hours / BEFORE))
    named = F.coalesce(F.arrays_overlap("hits", "told"), F.lit(False))
    filed = F.coalesce(F.array_contains("tickers", F.upper("symbol")), F.lit(False))
    agrees = F.coalesce(((F.col("direction") == "up") & (F.col("label") == "bullish")) | ((F.col("direction") == "down") & (F.col("label") == "bearish")), F.lit(False))
    tagged = F.coalesce("tagged", F.lit(False))
    one = lambda c: c.cast("int")
    score = F.round(0.20 * one(filed) + 0.30 * one(named) + 0.25 * recency + 0.20 * one(agrees) + 0.05 * one(tagged), 4)
    out = met.where(filed | named | tagged).select(*kinds, "article", score.alias("score"), filed.alias("source_attributed"), named.alias("named_in_text"), agrees.alias("sentiment_agrees"), F.round(hours, 1).alias("hours_before"))
    best = Window.partitionBy(*kinds).orderBy(F.desc("score"), "article")
    return out.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).join(news.select("article", "title"), "article")


def move(feature: Column, direction: Column, value: Column) -> Column:
    """An anomaly in words."""
    size = F.when(value.isNotNull() & (feature == "return"), F.concat(F.lit(" of "), F.format_string("%.1f", value * 100), F.lit("%"))).otherwise("")
    told = F.when(feature == "volume", "traded on unusual volume").when(feature == "volatility", "showed unusual volatility")
    return told.when(direction == "up", F.concat(F.lit("rose"), size)).when(direction == "down", F.concat(F.lit("fell"), size)).otherwise("moved unusually")


def narrative(events: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, explanation, documents): what may have moved each event (event_id, symbol, session, feature, direction,
    value), from its news (of ``correlate``, by event_id; or of ``by_kind``, whose lines are made once a kind); told differently
    where none came before the close. Events without news have no row."""
    keys = ["event_id"] if "event_id" in found.columns else KINDS
    filed = F.when(F.col("named_in_text"), "names this company").when(F.col("source_attributed"), "filed under this ticker by the source")
    hours = F.concat(F.format_string("%.0f", F.abs("hours_before")), F.when(F.col("hours_before") >= 0, "h before the close").otherwise("h after the close"))
    marks = F.array_join(F.array_compact(F.array(filed, F.when(F.col("sentiment_agrees"), "sentiment agrees with the move"), hours)), "; ")
    line = F.concat(F.lit("  - "), F.coalesce("title", F.lit("")), F.lit(" ("), marks, F.lit(")"))
    by = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line"), "article"))).alias("l"), F.bool_or(F.col("hours_before") >= 0).alias("before"))
    head = F.when(F.col("before"), "Possible contributing factors, ranked by relevance:").otherwise(
        "No news published before the close was found in the corpus. The following covered the move afterwards and may describe, but cannot explain, it:"
    )
    end = F.when(F.col("before"), F.array(F.lit("These are correlations in time and topic, not established causes."))).otherwise(F.array().cast("array<string>"))
    first = F.concat("a.symbol", F.lit(" "), move(F.col("feature"), F.col("a.direction"), F.col("value")), F.lit(" on "), F.date_format("session", "yyyy-MM-dd"), F.lit("."))
    told = events.alias("a").join(by.alias("b"), alike(keys))
    return told.select("a.event_id", F.array_join(F.concat(F.array(first, head), F.col("l.line"), end), "\n").alias("explanation"), F.col("l.article").alias("documents"))
