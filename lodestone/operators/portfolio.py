"""Positions and portfolios, valued at the last completed close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """(user, symbol, cost, market_value, gain, gain_percent); unpriced positions have null values, a zero basis no percent."""
    met = positions.join(closes.select("symbol", "close"), "symbol", "left")
    cost, worth = F.col("quantity") * F.col("average_cost"), F.col("quantity") * F.col("close")
    return met.select("user", "symbol", F.round(cost, 4).alias("cost"), F.round(worth, 4).alias("market_value"), F.round(worth - cost, 4).alias("gain"), F.round(F.try_divide(worth - cost, cost) * 100, 4).alias("gain_percent"))


def totals(valued: DataFrame) -> DataFrame:
    """A portfolio's cost and value; the value is null as soon as one position is unpriced."""
    every = F.count("market_value") == F.count(F.lit(1))
    return valued.groupBy("user").agg(F.round(F.sum("cost"), 2).alias("cost"), F.when(every, F.round(F.sum("market_value"), 2)).alias("market_value"), F.count(F.lit(1)).alias("positions"))


def with_default(lists: DataFrame) -> DataFrame:
    """Lists (user, name, created_at) with is_default: a user's first is the default one."""
    first = lists.groupBy("user").agg(F.min(F.struct("created_at", "name")).alias("f"))
    return lists.join(first, "user").withColumn("is_default", (F.col("created_at") == F.col("f.created_at")) & (F.col("name") == F.col("f.name"))).drop("f")


def owned(rows: DataFrame, column: str, user: int) -> DataFrame:
    """A user's rows; those of others look as if they weren't there."""
    return rows.where(F.col(column) == user)


def tracked(lists: DataFrame, items: DataFrame, tickers: DataFrame) -> DataFrame:
    """(user, symbol): what users follow in any of their lists, each once."""
    return items.join(lists, "list").join(tickers, "ticker").select("user", "symbol").distinct()


def nested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for the keys, with the distinct rest of its rows as a sorted array of structs, ``items``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))


def ordered(lists: DataFrame) -> DataFrame:
    """Lists with their place in a user's: the default one first, then by name."""
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(~F.col("is_default"), "name")))


def priced(symbols: list[str], closes: DataFrame) -> DataFrame:
    """(symbol, close) of the symbols asked for, however written; those without a price are left out."""
    return closes.where(F.upper("symbol").isin(sorted({s.strip().upper() for s in symbols}))).select("symbol", "close")


def surprise(actual: Column, estimate: Column) -> Column:
    """What was earned beyond the estimate, in percent of its size; null for an estimate of zero."""
    return F.try_divide(actual - estimate, F.abs(estimate)) * 100


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid
