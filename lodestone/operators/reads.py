"""Point, range and ranked reads, and plain aggregates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(df: DataFrame, column: str, start: date | str, end: date | str) -> DataFrame:
    """Rows of an inclusive window; both bounds reach the scan. An inverted window is an error."""
    if str(start) > str(end):
        raise ValueError("the window ends before it starts")
    kind = dict(df.dtypes)[column]
    return df.where(F.col(column).between(F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one of the largest ``order``; partial aggregation, no sort."""
    row = F.max_by(F.struct(*df.columns), order).alias("r")
    return df.groupBy(key).agg(row).select("r.*")


def recent(df: DataFrame, key: str, order: str, n: int | None, completed_only: bool = False) -> DataFrame:
    """The last ``n`` rows of each key (None: all); provisional rows go before the limit when ``completed_only``."""
    kept = df.where(~F.col("is_provisional")) if completed_only else df
    if n is None:
        return kept
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def bounds(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias("first_session"), F.max(order).alias("last_session"), F.count(F.lit(1)).alias("n"))


def period_return(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(last - first) / first of each key; null with fewer than two rows or a first value of zero."""
    ends = df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("n"))
    change = F.try_divide(F.col("last") - F.col("first"), F.col("first"))
    return ends.select(key, F.when(F.col("n") >= 2, F.round(change, 8)).alias("period_return"))


def with_tags(df: DataFrame, column: str, tags: list[str], match_all: bool = False) -> DataFrame:
    """Rows with any of the tags, or with all of them."""
    wanted = F.array(*map(F.lit, tags))
    return df.where(F.size(F.array_except(wanted, column)) == 0 if match_all else F.arrays_overlap(column, wanted))


def listing_search(df: DataFrame, text: str, limit: int, active_only: bool = False) -> DataFrame:
    """Rows whose symbol or name holds ``text``: exact symbols first, then prefixes, then short ones, then by symbol.
    ``active_only``: those that are active (is_active)."""
    t = text.strip()
    df = df.where("is_active") if active_only else df
    hit = F.upper("symbol").contains(t.upper()) | F.upper("name").contains(t.upper())
    order = [(F.upper("symbol") != t.upper()).cast("int"), (~F.upper("symbol").startswith(t.upper())).cast("int"), F.length("symbol"), F.col("symbol"), F.col("name")]
    return df.where(hit).orderBy(*order).limit(limit)


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more, limit 1 or more")
    return df.orderBy(*keys).offset(offset).limit(limit)


def histogram(df: DataFrame, value: str, marks: list[float]) -> DataFrame:
    """Cumulative bucket counts, a row a bound, by one aggregation."""
    counts = df.agg(*[F.count_if(F.col(value) <= m).alias(f"c{i}") for i, m in enumerate(marks)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(m)).alias("le"), F.col(f"c{i}").alias("n")) for i, m in enumerate(marks)])).alias("b")).select("b.le", "b.n")


def calendar(sessions: DataFrame, exchange: str = "exchange", day: str = "session") -> DataFrame:
    """Every day from an exchange's first to its last session: trading, or not and why."""
    span = sessions.groupBy(exchange).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(exchange, F.explode(F.sequence("a", "b")).alias("day"))
    met = days.join(sessions.select(exchange, F.col(day).alias("day"), F.lit(True).alias("open")).distinct(), [exchange, "day"], "left")
    note = F.when(F.col("open"), None).when(F.weekday("day") >= 5, "weekend").otherwise(F.concat(F.lit("no session observed on "), exchange, F.lit("; probable holiday")))
    return met.select(exchange, "day", F.coalesce("open", F.lit(False)).alias("is_trading_day"), note.alias("note"))


def consensus(df: DataFrame, counts: list[str]) -> DataFrame:
    """Mean of 5 counts of ratings, strong buy (1) to strong sell (5), and its label; null without ratings."""
    n = sum((F.col(c) for c in counts), F.lit(0))
    mean = F.try_divide(sum((F.col(c) * (i + 1) for i, c in enumerate(counts)), F.lit(0)), n)
    label: Column = F.when(mean <= 1.5, "strong_buy").when(mean <= 2.5, "buy").when(mean <= 3.5, "hold").when(mean <= 4.5, "sell").when(mean.isNotNull(), "strong_sell")
    return df.withColumn("mean", F.round(mean, 6)).withColumn("label", label)


# fixed values: days of a chart's window, and what its bars are cut to
CHARTS = {"1D": (1, "5 minutes"), "5D": (5, "30 minutes"), "1M": (31, "day"), "3M": (93, "day"), "6M": (186, "day"), "1Y": (366, "day"), "5Y": (1827, "week"), "MAX": (7305, "month")}


def candles(bars: DataFrame, chart: str, end: date | str, at: str = "session") -> DataFrame:
    """Bars (symbol, start, open, high, low, close, volume) of a chart's window up to ``end``, at the interval it is drawn at."""
    if chart not in CHARTS:
        raise ValueError(f"a chart is one of {', '.join(CHARTS)}")
    days, every = CHARTS[chart]
    until = F.lit(str(end)).cast("date")
    start = F.window(at, every)["start"] if " " in every else F.date_trunc(every, at)
    inside = bars.where((F.to_date(at) > F.date_sub(until, days)) & (F.to_date(at) <= until))
    return inside.groupBy("symbol", start.alias("start")).agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))


def normal(value: Column, upper: bool = True) -> Column:
    """A symbol (upper case) or an address (lower case) as it is stored: trimmed, in one case."""
    return F.upper(F.trim(value)) if upper else F.lower(F.trim(value))


def lookup(df: DataFrame, column: str, wanted: list[str], upper: bool = True) -> DataFrame:
    """Rows whose ``column`` is one of ``wanted``, however these are written."""
    values = sorted({w.strip().upper() if upper else w.strip().lower() for w in wanted})
    return df.where(F.col(column).isin(values))


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row (found): whether any row meets the condition."""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))


def named_like(df: DataFrame, text: str, columns: list[str], order: list[Column | str], limit: int = 20) -> DataFrame:
    """Rows with ``text`` in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    return df.where(hit).orderBy(*order).limit(limit)


def stale(df: DataFrame, before: str, active: str = "is_active", last: str = "last_session") -> DataFrame:
    """Active rows that have no last session, or one before a day."""
    return df.where(F.col(active) & (F.col(last).isNull() | (F.col(last) < F.lit(before).cast("date"))))


# fixed values: severities from the least to the worst
LADDER = ["low", "medium", "high", "extreme"]


def at_least(df: DataFrame, severity: str, column: str = "severity") -> DataFrame:
    """Rows of a severity or a worse one."""
    if severity not in LADDER:
        raise ValueError(f"a severity is one of {', '.join(LADDER)}")
    return df.where(F.col(column).isin(LADDER[LADDER.index(severity) :]))


def newest(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return df.orderBy(*order).limit(limit)


def news_window(news: DataFrame, since: str | None = None, until: str | None = None, tickers: list[str] | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Articles of a window that have any of the tickers and any of the tags, newest first; no bound or list means any."""
    if since is not None:
        news = news.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        news = news.where(F.col("published_at") <= F.lit(until).cast("timestamp_ntz"))
    if tickers:
        news = news.where(F.arrays_overlap(F.transform("tickers", F.upper), F.array(*[F.lit(t.strip().upper()) for t in tickers])))
    if tags:
        news = news.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return news if limit is None else newest(news, [F.desc("published_at"), "article"], limit)


def unscored(news: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """Articles without a sentiment from a time on, oldest first: a queue that is empty once all are scored."""
    queue = news.where(F.col("sentiment").isNull() & (F.col("published_at") >= F.lit(since).cast("timestamp_ntz")))
    return queue if limit is None else newest(queue, ["published_at", "article"], limit)


def window(start: date | None, end: date | None, today: date, default: int = 180, most: int = 730) -> tuple[date, date]:
    """The window that is asked for, by default the last ``default`` days; inverted ones and longer ones than ``most`` days are errors."""
    end = end or today
    start = start or end - timedelta(days=default)
    if start > end:
        raise ValueError("the window ends before it starts")
    if (end - start).days > most:
        raise ValueError(f"a window has {most} days at most")
    return start, end


def trading_state(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``days`` (exchange, day) with is_trading_day: true, false, or null where the calendar doesn't tell."""
    return days.join(calendar.select("exchange", "day", "is_trading_day"), ["exchange", "day"], "left")


def trading_day_before(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``days`` (exchange, day) with the last trading day up to each: all days of an exchange are walked once, in order."""
    marks = calendar.where("is_trading_day").select("exchange", "day", F.col("day").alias("open"), F.lit(0).alias("asked"))
    asked = days.select("exchange", "day", F.lit(None).cast("date").alias("open"), F.lit(1).alias("asked"))
    order = Window.partitionBy("exchange").orderBy("day", "asked")
    return marks.unionByName(asked).withColumn("last_open", F.max("open").over(order)).where("asked = 1").select("exchange", "day", "last_open")


def in_calendar(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows (exchange, session) of trading days; those of exchanges without a calendar all stay."""
    has = calendar.select("exchange", F.lit(True).alias("__has")).distinct()
    opens = calendar.where("is_trading_day").select("exchange", F.col("day").alias("session"), F.lit(True).alias("__open")).distinct()
    met = rows.join(F.broadcast(has), "exchange", "left").join(opens, ["exchange", "session"], "left")  # a row an exchange
    return met.where("__has is null or __open").drop("__has", "__open")


def age_seconds(df: DataFrame, order: str, today: str) -> DataFrame:
    """One row: the last completed ``order`` and its age in seconds, by whole days."""
    return df.agg(F.max(order).alias("last")).select("last", (F.datediff(F.lit(today).cast("date"), "last") * 86_400).cast("long").alias("age_seconds"))


def flag(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a column that tells whether ``members`` has the row's key."""
    return df.join(members.select(key, F.lit(True).alias(name)).distinct(), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def breadth(quotes: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """One row: how many advance, decline and stay, the mean return, and what the market is called then; with the number of
    ``anomalies``, if given.

    ``up``: six in ten of those that move advance; ``down``: four in ten or fewer; else ``mixed``; ``flat`` if none moves.
    """
    r = F.col("daily_return")
    counts = quotes.agg(F.count_if(r > 0).alias("advancers"), F.count_if(r < 0).alias("decliners"), F.count_if(r == 0).alias("unchanged"), F.round(F.avg(r), 6).alias("average_return"))
    share = F.try_divide(F.col("advancers"), F.col("advancers") + F.col("decliners"))
    told = counts.withColumn("regime", F.when(share.isNull(), "flat").when(share >= 0.6, "up").when(share <= 0.4, "down").otherwise("mixed"))
    return told if anomalies is None else told.join(F.broadcast(anomalies.agg(F.count(F.lit(1)).alias("anomalies"))))  # one row each


def next_position(items: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, next_position): one more than a list's last position, 0 for an empty list."""
    last = items.groupBy(key).agg(F.max("position").alias("__last"))
    return lists.join(last, key, "left").select(key, F.coalesce(F.col("__last") + 1, F.lit(0)).alias("next_position"))


def recent_conversations(chat: DataFrame, limit: int) -> DataFrame:
    """The conversations with the newest turns: (conv_id, last_turn, last_question)."""
    by = chat.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_question"))
    return by.orderBy(F.desc("last_turn"), "conv_id").limit(limit)


def report(runs: DataFrame) -> DataFrame:
    """Of runs (outcome, written): how many had each outcome, and what they wrote."""
    return runs.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("written").alias("written"))
