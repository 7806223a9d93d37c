"""Structured Streaming: quote changes, windows over ticks, and replayed rows dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Ticks (symbol, ts, price) from files of events as a stream; ``ts`` gets a time zone, so that it can carry a watermark."""
    schema = spark.read.parquet(f"{path}/{glob}" if glob else path).schema
    reader = spark.readStream.schema(schema)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    return raw.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def bars(ticks: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Open, high, low, close and count of each symbol and window, tumbling or sliding."""
    order = F.struct("ts", "event_id")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    by = ticks.withWatermark("ts", late).groupBy("symbol", window.alias("w"))
    out = by.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a symbol's ticks without a pause of ``gap``."""
    by = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(ticks: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: What ``changes`` gives, and what it keeps from batch to batch: one row a symbol.
CHANGES, LAST = "symbol string, event_id long, price double", "symbol string, last double"


def changes(ticks: DataFrame, state: DataFrame, bucket: str = "hour") -> tuple[DataFrame, DataFrame]:
    """(ticks whose price is not that of their symbol's one before, last prices) of a batch and the last prices so far.

    Ticks are compared inside each symbol and hour, so a symbol with any share of the ticks goes to many tasks; the hours
    are stitched by their last prices, a row each.
    """
    turn = F.struct("ts", "event_id")
    order = Window.partitionBy("symbol", "bucket").orderBy("ts", "event_id")
    inner = ticks.withColumn("bucket", F.date_trunc(bucket, "ts")).withColumn("before", F.lag("price").over(order)).withColumn("nth", F.row_number().over(order))
    lasts = inner.groupBy("symbol", "bucket").agg(F.max_by("price", turn).alias("last"))
    earlier = F.lag("last").over(Window.partitionBy("symbol").orderBy("bucket"))
    stitched = lasts.withColumn("earlier", earlier).join(state.withColumnRenamed("last", "sent"), "symbol", "left")
    stitched = stitched.select("symbol", "bucket", F.coalesce("earlier", "sent").alias("earlier"))
    met = inner.join(stitched, ["symbol", "bucket"])
    before = F.when(F.col("nth") == 1, F.col("earlier")).otherwise(F.col("before"))
    sent = met.where(~before.eqNullSafe(F.col("price"))).select("symbol", "event_id", "price")
    now = lasts.groupBy("symbol").agg(F.max_by("last", "bucket").alias("last"))
    return sent, now.unionByName(state.join(now, "symbol", "left_anti"))


def payload(quotes: DataFrame) -> DataFrame:
    """Messages of quotes: prices and the change in percent as text, and always whether the bar is provisional."""
    percent = F.format_string("%.4f", F.round("change_percent", 4))
    return quotes.select("symbol", F.format_string("%.2f", "close").alias("close"), percent.alias("change_percent"), F.coalesce("is_provisional", F.lit(False)).alias("is_provisional"))
