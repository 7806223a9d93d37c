"""Views of the test tables in the terms of the domain: price bars, tickers, news, edges, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each part brand; cents are summed as integers, so that the order of rows changes nothing downstream."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    px, turn = F.col("l_extendedprice"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    by = items.join(parts, items["l_partkey"] == parts["p_partkey"]).groupBy("symbol", F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"))
    return by.agg(
        F.min_by(px, turn).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, turn).alias("close"),
        (F.sum(F.round(px * 100).cast("long") * F.col("l_quantity").cast("long")) / F.sum("l_quantity") / 100).alias("adjusted_close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


def flagged(bars: DataFrame) -> DataFrame:
    """``bars`` with is_provisional: whether a bar is of the last session of all."""
    last = bars.agg(F.max("session").alias("__last"))  # one row
    return bars.join(F.broadcast(last)).withColumn("is_provisional", F.col("session") == F.col("__last")).drop("__last")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, weight, confidence): suppliers' nations supply brands, brands supply customers' nations."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    flow = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = flow.groupBy(F.col("n_name").alias("source"), F.col("p_brand").alias("target")).agg(F.sum("l_quantity").alias("q"))
    total = sums.groupBy("target").agg(F.sum("q").alias("all"))
    return sums.join(total, "target").select("source", "target", F.lit("supplies").alias("kind"), F.round(F.col("q") / F.col("all"), 6).alias("weight"), F.round(F.least(F.lit(1.0), F.col("q") / F.col("all") * 20), 6).alias("confidence"))


KINDS = ["supplies", "manufactures", "customer_of", "depends_on", "produces", "uses", "deploys", "partners_with", "invests_in", "competes_with", "acquired", "operates", "located_in"]


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, weight, confidence, valid_from, valid_to): a fifth of ``edges``, of all kinds, some bounded in time."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("j"))
    i, j = F.substring("target", 7, 3).cast("int"), F.col("j")
    some = edges(spark, sf_dir).select("source", "target").join(F.broadcast(nations), "source").where((i * 7 + j * 3) % 5 == 0)
    first, last = F.lit("1995-01-01").cast("date"), F.lit("1996-06-01").cast("date")
    return some.select(
        "source", "target", F.element_at(F.array(*map(F.lit, KINDS)), (i + j) % 13 + 1).alias("kind"),
        (((i * 3 + j * 5) % 10 + 1) / 10).alias("weight"), (((i + j * 2) % 6 + 5) / 10).alias("confidence"),
        F.when((i + j) % 3 == 0, F.date_add(first, i * 20)).alias("valid_from"), F.when((i + j) % 4 == 0, F.date_add(last, j * 10)).alias("valid_to"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, name, exchange, asset_type, is_active, last_session, source, synced_at) of each supplier."""
    k = F.col("s_suppkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    day = F.lit("1998-06-01").cast("date")
    return met.select(
        k.alias("id"), F.upper(F.replace("s_name", F.lit("Supplier#0000"), F.lit("S"))).alias("symbol"), F.concat_ws(" ", "n_name", "s_name").alias("name"), F.col("r_name").alias("exchange"),
        F.when(k % 5 == 0, "etf").otherwise("equity").alias("asset_type"), (k % 7 != 0).alias("is_active"), F.when(k % 4 != 0, F.date_sub(day, (k % 30).cast("int"))).alias("last_session"),
        F.when(F.col("s_nationkey") < 12, "a").otherwise("b").alias("source"), F.date_sub(day, (k % 11).cast("int")).alias("synced_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, url_hash, title, summary, published_at, tickers, tags, sentiment) of each document; some without sentiment."""
    k = F.col("doc_id")
    at = F.expr("timestamp_ntz '1996-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))")
    lines = F.split("text", "\n")
    symbol = lambda n: F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string"))
    return table(spark, sf_dir, "documents").select(
        k.alias("article"), F.sha2(k.cast("string"), 256).alias("url_hash"), lines[0].alias("title"), F.get(lines, F.lit(1)).alias("summary"), at.alias("published_at"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(symbol(k), symbol(k * 3))).alias("tickers"),
        F.when(k % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(k % 4 != 0, F.when(F.col("lang") == "en", "bullish").otherwise("bearish")).alias("sentiment"),
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, session, feature, severity, confidence, direction, value, explanation) made of orders; some are explained."""
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("session"),
        pick(3, "return", "volume", "volatility").alias("feature"), pick(4, "low", "medium", "high", "extreme").alias("severity"), ((k % 100) / 100).alias("confidence"),
        pick(2, "up", "down").alias("direction"), (F.when(k % 2 == 0, 1).otherwise(-1) * (k % 13) / 100).alias("value"), F.when(k % 3 == 0, "told").alias("explanation"),
    )
