"""Unusual sessions: robust Z scores, and an isolation forest for each symbol."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import kept

from . import forest
from .reads import in_calendar

#: Deviations of a normal distribution in one median absolute deviation.
SCALE = 1.4826
THRESHOLD = 3.0
LEAST = 60
#: feature: whether low values count too
FEATURES = {"daily_return": True, "volume_ratio": False, "volatility_20": True}


#: Ranks that the sketch of a median may be off, as a share of the rows: 1 in so many.
SKETCH = 2000


def exact_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, median, n): the exact median of each group's values, and how many there are."""
    return exact_quantile(df, value, 0.5, *by).withColumnRenamed("quantile", "median")


def exact_quantile(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """(by, quantile, n): the exact quantile of each group's values, between the two that are nearest to (n - 1) * q, and n.

    A mergeable sketch brackets it, by twice what it may be off; a second pass counts the values below the bracket
    and, by value, those in it, and picks by their running count. No group is gathered: a window sees one row for each
    value in the bracket, a thousandth or so of a large group.
    """
    some = df.where(F.col(value).isNotNull())
    ends = F.array(F.lit(max(0.0, q - 2 / SKETCH)), F.lit(min(1.0, q + 2 / SKETCH)))
    about = some.groupBy(*by).agg(F.approx_percentile(value, ends, F.lit(SKETCH)).alias("near"), F.count(F.lit(1)).alias("n")).select(*by, F.col("near")[0].alias("low"), F.col("near")[1].alias("high"), "n")
    place = (F.col("n") - 1) * F.lit(q)
    first, next_ = F.floor(place) + 1, F.ceil(place) + 1
    # small groups are taken whole: their ranks are too few for a bracket
    same = functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], F.lit(True))
    met = some.alias("a").join(about.alias("b"), same)
    inside = F.col(f"a.{value}").between(F.col("b.low"), F.col("b.high")) | (F.col("b.n") <= SKETCH)
    spot = F.when(inside, F.col(f"a.{value}"))  # null: below the bracket
    met = met.where((F.col(f"a.{value}") <= F.col("b.high")) | (F.col("b.n") <= SKETCH))
    counts = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("b.n").alias("n"), spot.alias("spot")).agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(*by).orderBy(F.col("spot").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("spot")))
    below = F.coalesce(F.max(F.when(F.col("spot").isNull(), F.col("upto"))), F.lit(0))
    picked = upto.groupBy(*by).agg(pick(first).alias("a"), pick(next_).alias("b"), F.max("n").alias("n"), below.alias("below"))
    value_of = (F.col("a") + F.col("b")) / 2 if q == 0.5 else F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))
    middle = F.when(first == next_, F.col("a")).otherwise(value_of)
    held = F.when((F.col("below") < first) & F.col("b").isNotNull(), middle).otherwise(F.raise_error(F.lit("a sketch was off by more than its bound")))
    return picked.select(*by, held.alias("quantile"), "n")


def robust_z(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``df`` with median, n, mad and z = (x - median) / (1.4826 mad) of each group, by exact medians; null where mad is 0."""
    rows = kept(df, "values")
    with_median = on_group(rows, exact_median(rows, value, *by), *by)
    off = with_median.select(*by, F.abs(F.col(value) - F.col("median")).alias("off"))
    mads = exact_median(off, "off", *by).select(*by, F.col("median").alias("mad"))
    return on_group(with_median, mads, *by).withColumn("z", F.try_divide(F.col(value) - F.col("median"), SCALE * F.col("mad")))


def on_group(rows: DataFrame, groups: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the columns that ``groups`` has beside ``by``; nulls are a group."""
    same = functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], F.lit(True))
    return rows.alias("a").join(groups.alias("b"), same, "left").select("a.*", *[F.col(f"b.{c}") for c in groups.columns if c not in by])


def severity(score: Column) -> Column:
    return F.when(score >= 8, "extreme").when(score >= 5, "high").when(score >= 3.5, "medium").otherwise("low")


def confidence(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score <= threshold, F.lit(0.0)).otherwise(1 - F.exp(-(score - threshold) / 2))


def detect(observations: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, context: bool = False) -> DataFrame:
    """Rows (symbol, session, feature, value, score, direction, severity, confidence) of |z| of ``threshold`` or more.

    Symbols with fewer than ``least`` observations of a feature have no baseline. The volume ratio counts upwards alone.
    ``context``: with the median, the deviation and the number of observations as JSON.
    """
    names = list(FEATURES)
    long = observations.unpivot(["symbol", "session"], names, "feature", "value").where("value is not null")
    scored = robust_z(long, "value", "symbol", "feature").where((F.col("n") >= least) & F.col("z").isNotNull())
    signed = F.col("feature").isin([k for k, v in FEATURES.items() if v])
    out = scored.where((F.abs("z") >= threshold) & (signed | (F.col("z") > 0)))
    way = F.when(F.col("value") > 0, "up").when(signed & (F.col("value") < 0), "down").otherwise("neutral")
    score = F.abs("z")
    told = F.to_json(F.struct(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.col("n").alias("observations")))
    return out.select(
        "symbol", "session", "feature", F.round("value", 6).alias("value"), F.round(score, 6).alias("score"), way.alias("direction"),
        severity(score).alias("severity"), F.round(confidence(score), 6).alias("confidence"), *([told.alias("context")] if context else []),
    )


#: Feature rows of a symbol that a run reads, and sessions that it reports.
READ, LOOKBACK = 500, 30


def prepared(observations: DataFrame, calendar: DataFrame, read: int = READ, least: int = LEAST, lookback: int = LOOKBACK) -> DataFrame:
    """What a run works on: each symbol's last ``read`` rows, of trading days where its exchange has a calendar, with
    ``reported``: whether a row is one of the last ``lookback``. Symbols with fewer than ``least`` rows, before or after
    the calendar is asked, are left out. ``observations`` have a column exchange."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("session"))
    every = Window.partitionBy("symbol")
    some = observations.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= read).withColumn("__all", F.count(F.lit(1)).over(every)).where(F.col("__all") >= least).drop("__n", "__all")
    traded = in_calendar(some, calendar)
    ranked = traded.withColumn("__n", F.row_number().over(newest)).withColumn("__all", F.count(F.lit(1)).over(every)).where(F.col("__all") >= least)
    return ranked.withColumn("reported", F.col("__n") <= lookback).drop("__n", "__all")


def run(observations: DataFrame, calendar: DataFrame, lone: bool = True, lookback: int = LOOKBACK) -> DataFrame:
    """Findings of both detectors (method: zscore, isolation_forest) in the last ``lookback`` sessions; baselines are whole."""
    read = prepared(observations, calendar, lookback=lookback)
    recent = read.where("reported").select("symbol", "session")
    found = detect(read).withColumn("method", F.lit("zscore"))
    if lone:
        far = isolation_forest(read, ["daily_return", "volume_ratio", "volatility_20", "relative_strength"])
        missing = {c: F.lit(None).cast(t) for c, t in found.dtypes if c not in far.columns and c != "method"}
        found = found.unionByName(far.withColumns(missing).withColumns({"feature": F.lit("return"), "score": F.abs("decision"), "method": F.lit("isolation_forest")}).select(*found.columns))
    return found.join(recent, ["symbol", "session"], "left_semi")


def default_since(today: Column, sessions: Column) -> Column:
    """The day from which so many sessions surely lie: weekends and holidays are allowed for."""
    return F.date_sub(today, F.floor(sessions * 1.6).cast("int") + 7)


def valid_anomalies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return rows.where(good), rows.where(~good)


def isolation_forest(observations: DataFrame, features: list[str], trees: int = 200, share: float = 0.02, least: int = LEAST) -> DataFrame:
    """Rows of each symbol whose score is over its quantile of 1 - ``share``; rows with a missing feature are skipped."""
    rows = kept(observations.select("symbol", "session", *features).dropna(), "complete")
    told = kept(forest.scored(rows, features, trees, least), "scores")
    limits = exact_quantile(told, "score", 1 - share, "symbol").select("symbol", "quantile")
    found = told.join(limits, "symbol").withColumn("decision", F.round(F.col("quantile") - F.col("score"), 9)).where("decision < 0")
    size = F.abs("decision") * 40
    return found.select("symbol", "session", "decision", severity(size).alias("severity"), confidence(size).alias("confidence"))
