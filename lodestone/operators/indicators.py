"""Technical indicators of price bars: built-in windows over one shuffle, and scans for recursive smoothing.

All are aligned to the bars of their symbol, oldest first, and null until enough sessions are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import kept

from . import recursion

#: Sessions in a year.
YEAR = 252


def series() -> Window:
    return Window.partitionBy("symbol").orderBy("session")


def change(value: Column | str, sessions: int) -> Column:
    """(x - x before) / x before, null where that is zero."""
    value = F.col(value) if isinstance(value, str) else value
    if sessions < 1:
        raise ValueError("a period is 1 session or more")
    before = F.lag(value, sessions).over(series())
    return F.try_divide(value - before, before)


def full(value: Column, period: int) -> Column:
    """``value`` once ``period`` sessions are there."""
    if period < 1:
        raise ValueError("a period is 1 session or more")
    return F.when(F.row_number().over(series()) >= period, value)


def last(period: int) -> Window:
    return series().rowsBetween(-(period - 1), 0)


def returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "session", *[change("adjusted_close", k).alias(n) for n, k in (("daily_return", 1), ("weekly_return", 5), ("monthly_return", 21))])


def averages(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return bars.select("symbol", "session", *[full(F.avg("adjusted_close").over(last(p)), p).alias(f"sma_{p}") for p in periods], full(F.avg("volume").over(last(20)), 20).alias("volume_sma_20"))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of the last sessions, and ``width`` population deviations around it."""
    mean, spread = F.avg("adjusted_close").over(last(period)), F.stddev_pop("adjusted_close").over(last(period))
    return bars.select("symbol", "session", *[full(v, period).alias(f"bollinger_{n}") for n, v in (("upper", mean + width * spread), ("middle", mean), ("lower", mean - width * spread))])


def volatility(bars: DataFrame, period: int = 20) -> DataFrame:
    """Yearly sample deviation of daily returns; needs a return in each of the sessions."""
    if period < 2:
        raise ValueError("volatility needs 2 sessions or more")
    r = returns(bars).select("symbol", "session", "daily_return")
    return r.select("symbol", "session", F.when(F.count("daily_return").over(last(period)) == period, F.stddev_samp("daily_return").over(last(period)) * F.sqrt(F.lit(float(YEAR)))).alias(f"volatility_{period}"))


def volume_ratio(bars: DataFrame, period: int = 20) -> DataFrame:
    return bars.select("symbol", "session", full(F.try_divide(F.col("volume"), F.avg("volume").over(last(period))), period).alias("volume_ratio"))


def relative_strength(bars: DataFrame, benchmark: str) -> DataFrame:
    """Daily return less that of the benchmark in the same session; null where either is."""
    r = returns(bars).select("symbol", "session", "daily_return")
    other = r.where(F.col("symbol") == benchmark).select("session", F.col("daily_return").alias("__b"))
    return r.join(other, "session", "left").select("symbol", "session", (F.col("daily_return") - F.col("__b")).alias("relative_strength"))


def quotes(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol with its change from the one before: null without one or where it closed at zero."""
    before = F.lag("close").over(series())
    both = bars.withColumn("previous_close", before).groupBy("symbol").agg(F.max_by(F.struct("session", "close", "previous_close"), "session").alias("q")).select("symbol", "q.*")
    return both.withColumn("change_percent", F.round(F.try_divide(F.col("close") - F.col("previous_close"), F.col("previous_close")) * 100, 6))


SMOOTHED = ["ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "rsi_14", "atr_14"]


def with_smoothed(rows: DataFrame) -> DataFrame:
    """``rows`` (symbol, session, adjusted_close, high, low, close, ...) with EMA 12 and 26, MACD, RSI 14 and ATR 14.

    EMAs are seeded by the mean of their first values, the signal by that of the first nine MACDs; RSI and ATR smooth
    what a bar makes of the one before it by Wilder's factor, from the second bar on. All run as scans over blocks of days.
    """
    at = recursion.placed(rows, ("adjusted_close", "close"))
    x, step = F.col("adjusted_close"), F.col("adjusted_close") - F.col("previous_adjusted_close")
    prior, of = F.col("previous_close"), lambda *v: F.when(sum((c.isNull().cast("int") for c in v), F.lit(0)) == 0, F.greatest(*v))
    reach = of(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    zero = F.lit(0.0)
    out = recursion.smoothed(at, {
        "ema_12": recursion.exponential(x, 12), "ema_26": recursion.exponential(x, 26), "gain": recursion.wilder(of(step, zero), 14), "loss": recursion.wilder(of(-step, zero), 14), "atr_14": recursion.wilder(reach, 14),
    }).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    out = recursion.smoothed(out, {"macd_signal": recursion.exponential(F.col("macd"), 9, first=26)})
    rsi = F.when(F.col("loss") == 0, F.when(F.col("gain") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    out = out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).withColumn("rsi_14", F.when(F.col("gain").isNotNull(), rsi))
    return out.select(*rows.columns, *SMOOTHED)


def smoothed(bars: DataFrame) -> DataFrame:
    """EMA 12 and 26, MACD, RSI 14 and ATR 14 of each session."""
    rows = bars.select("symbol", "session", *[F.col(c).cast("double").alias(c) for c in ("adjusted_close", "high", "low", "close")])
    return with_smoothed(kept(rows, "bars")).select("symbol", "session", *SMOOTHED)


def observations(bars: DataFrame) -> DataFrame:
    """(symbol, session, daily_return, volume_ratio, volatility_20): one scan, and windows over one shuffle."""
    r = bars.select("symbol", "session", "volume", change("adjusted_close", 1).alias("daily_return"))
    every = F.count("daily_return").over(last(20)) == 20
    ratio = full(F.try_divide(F.col("volume"), F.avg("volume").over(last(20))), 20).alias("volume_ratio")
    return r.select("symbol", "session", "daily_return", ratio, F.when(every, F.stddev_samp("daily_return").over(last(20)) * F.sqrt(F.lit(float(YEAR)))).alias("volatility_20"))


def windowed(bars: DataFrame) -> DataFrame:
    """The bars' columns that ``smoothed`` reads, and all indicators that windows give, over one shuffle."""
    moves = [change("adjusted_close", k).alias(n) for n, k in (("daily_return", 1), ("weekly_return", 5), ("monthly_return", 21))]
    means = [full(F.avg("adjusted_close").over(last(p)), p).alias(f"sma_{p}") for p in (20, 50, 200)]
    mean, spread = F.avg("adjusted_close").over(last(20)), F.stddev_pop("adjusted_close").over(last(20))
    bands = [full(v, 20).alias(f"bollinger_{n}") for n, v in (("upper", mean + 2 * spread), ("middle", mean), ("lower", mean - 2 * spread))]
    volumes = [full(F.avg("volume").over(last(20)), 20).alias("volume_sma_20"), full(F.try_divide(F.col("volume"), F.avg("volume").over(last(20))), 20).alias("volume_ratio")]
    out = bars.select("symbol", "session", "adjusted_close", "high", "low", "close", *moves, *means, *bands, *volumes)
    every = F.count("daily_return").over(last(20)) == 20
    return out.withColumn("volatility_20", F.when(every, F.stddev_samp("daily_return").over(last(20)) * F.sqrt(F.lit(float(YEAR)))))


def unrounded(bars: DataFrame, benchmark: str) -> DataFrame:
    """All indicators of each session: windows over one shuffle, written once, and scans for the recursive ones; the
    benchmark's returns (a row a session) are joined."""
    key = ["symbol", "session"]
    wide = windowed(bars)
    names = [c for c in wide.columns if c not in (*key, "adjusted_close", "high", "low", "close")]
    wide = wide.select(*key, *[F.col(c).cast("double").alias(c) for c in wide.columns if c not in key])
    out = with_smoothed(kept(wide, "indicators")).select(*key, *names, *SMOOTHED)
    other = returns(bars.where(F.col("symbol") == benchmark)).select("session", F.col("daily_return").alias("__b"))
    out = out.join(other, "session", "left").withColumn("relative_strength", F.col("daily_return") - F.col("__b")).drop("__b")
    return out


def features(bars: DataFrame, benchmark: str) -> DataFrame:
    """All indicators of each session, as decimals of 6 places, rounded half to even; what is not finite is null."""
    key = ["symbol", "session"]
    out = unrounded(bars, benchmark)
    exact = lambda c: F.bround(F.when(~F.isnan(c) & (F.abs(c) < 1e13), F.col(c)).cast("decimal(32,18)"), 6).cast("decimal(20,6)").alias(c)
    return out.select(*key, *[exact(c) for c in out.columns if c not in key])


#: Sessions that an update writes again, those before them that warm the indicators up, and bars that a symbol needs.
REWRITE, WARM_UP, LEAST_BARS = 40, 260, 5


def updates(bars: DataFrame, benchmark: str, full_history: bool = False) -> DataFrame:
    """Feature rows to write: of each symbol with 5 completed bars the last 40 sessions, computed from the last 300.

    ``full_history``: all sessions, from all bars. Bars that are provisional don't count.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("session"))
    done = bars.where(~F.col("is_provisional")).drop("is_provisional")
    enough = done.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_BARS).select("symbol")
    done = done.join(enough, "symbol", "left_semi")
    if full_history:
        return features(done, benchmark)
    read = done.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= REWRITE + WARM_UP).drop("__n")
    return features(read, benchmark).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= REWRITE).drop("__n")


def window_start(last: Column, today: Column, first_load: int = 730, overlap: int = 5) -> Column:
    """The day that a load begins at: some days before the last session that is there, two years back without any."""
    return F.when(last.isNull(), F.date_sub(today, first_load)).otherwise(F.date_sub(last, overlap))
