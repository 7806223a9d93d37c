"""Recorded provider payloads as tables: JSON articles, RSS items, filings in parallel arrays.

Payloads stand one to a file, or (``lines``) one to a line, and then a file of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = "articles array<struct<source: struct<name: string>, author: string, title: string, description: string, url: string, publishedAt: string, content: string>>"


def when(text: F.Column | str) -> F.Column:
    """A time with a zone, with or without parts of a second; null for anything else."""
    zoned = F.regexp_replace(text, r"Z$", "+00:00")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f"yyyy-MM-dd'T'HH:mm:ss{part}XXX")) for part in ("", "[.SSSSSS]", "[.SSS]")])


def number(text: str) -> F.Column:
    """A number of any form, null for what is none or not finite."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def whole(text: str) -> F.Column:
    return F.floor(number(text)).cast("long")


def day(text: str) -> F.Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def json_articles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of a news search's response; those without url, title or date go, as do removed ones."""
    one = spark.read.schema(ARTICLES).option("multiLine", not lines).json(path).select(F.explode("articles").alias("a")).select("a.*")
    out = one.select("url", "title", F.col("description").alias("summary"), "content", F.col("source.name").alias("source"), when(F.col("publishedAt")).alias("published_at"))
    return out.where("url <> '' and title <> '' and title <> '[Removed]' and published_at is not null")


def xml_rows(spark: SparkSession, path: str, tag: str, fields: str, inside: str, lines: bool) -> DataFrame:
    """The elements ``tag`` of XML documents, one to a file, or one to a line (of feeds: under ``inside``)."""
    if not lines:
        return spark.read.format("xml").option("rowTag", tag).schema(fields).load(path)
    rows = f"`{tag}`: array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(', '))}>>"
    kinds = f"`{inside}` struct<{rows}>" if inside else rows.replace(": array", " array", 1)
    at = F.col("x")[inside][tag] if inside else F.col("x")[tag]
    return spark.read.text(path).select(F.from_xml("value", F.lit(kinds)).alias("x")).select(F.inline(at))


def rss_items(spark: SparkSession, path: str, since: str | None = None, lines: bool = False) -> DataFrame:
    """Items of an RSS feed with a date that can be read, from ``since`` on."""
    raw = xml_rows(spark, path, "item", "title string, link string, description string, pubDate string", "channel", lines)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^\w+,\s*", ""), "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    out = raw.select(F.col("link").alias("url"), "title", F.col("description").alias("summary"), date.alias("published_at")).where("published_at is not null")
    return out if since is None else out.where(F.col("published_at") >= F.lit(since).cast("timestamp"))


def atom_entries(spark: SparkSession, path: str, since: str | None = None, lines: bool = False) -> DataFrame:
    """Entries of an Atom feed, dated by when they were published, else updated, else created; undated ones go."""
    schema = "title string, link struct<_href: string>, summary string, published string, updated string, created string"
    raw = xml_rows(spark, path, "entry", schema, "", lines)
    date = F.coalesce(when(F.col("published")), when(F.col("updated")), when(F.col("created")))
    out = raw.select(F.col("link._href").alias("url"), "title", "summary", date.alias("published_at")).where("published_at is not null")
    return out if since is None else out.where(F.col("published_at") >= F.lit(since).cast("timestamp"))


def latest(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy(F.desc("published_at"), "url").limit(limit)


def filings(df: DataFrame) -> DataFrame:
    """Filings (cik, arrays form, date, accession) as rows; a row whose date can't be read goes."""
    rows = df.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.explode(F.arrays_zip("form", "date", "accession")).alias("f")).select("cik", "f.*")
    return rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).where("date is not null").withColumn("url", F.concat(F.lit("https://filings.example/"), "cik", F.lit("/"), F.replace("accession", F.lit("-"), F.lit(""))))


def valid_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects): prices and volume are 0 or more, high is not under low."""
    good = F.coalesce((F.least("open", "high", "low", "close") >= 0) & (F.col("volume") >= 0) & (F.col("high") >= F.col("low")), F.lit(False))
    return bars.where(good), bars.where(~good)


def merged_by_url(articles: DataFrame) -> DataFrame:
    """One row a URL key: the first article by date, with the tickers of all."""
    key = F.sha2(F.lower(F.trim("url")), 256)
    first = F.min_by(F.struct("url", "title", "published_at"), F.struct("published_at", "title"))
    return articles.groupBy(key.alias("url_hash")).agg(first.alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers")).select("url_hash", "a.*", "tickers")


CANDLES = "code int, message string, status string, meta struct<symbol: string>, values array<struct<datetime: string, open: string, high: string, low: string, close: string, volume: string>>"


def json_candles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bars of a time series' response, oldest first in each symbol's order; an error's body and bars that can't be read give no row."""
    raw = spark.read.schema(CANDLES).option("multiLine", not lines).json(path).where("coalesce(status, 'ok') <> 'error'")
    one = raw.select(F.col("meta.symbol").alias("symbol"), F.explode("values").alias("v"))
    price = lambda c: F.col(f"v.{c}").try_cast("decimal(20,6)").alias(c)
    out = one.select("symbol", F.col("v.datetime").try_cast("timestamp").alias("at"), *map(price, ("open", "high", "low", "close")), F.coalesce(F.col("v.volume").try_cast("double").cast("long"), F.lit(0)).alias("volume"))
    return out.dropna(subset=["at", "open", "high", "low", "close"])


def json_quotes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Quotes of a provider (c, d, dp, h, l, o, pc, t: epoch seconds); one that is all zeros is of no known symbol and goes."""
    raw = spark.read.schema("c double, d double, dp double, h double, l double, o double, pc double, t long").option("multiLine", not lines).json(path)
    return raw.where("coalesce(c, 0) <> 0 or coalesce(pc, 0) <> 0").select(F.col("c").alias("price"), F.col("d").alias("change"), F.col("dp").alias("change_percent"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("o").alias("open"), F.col("pc").alias("previous_close"), F.timestamp_seconds("t").alias("at"))


def json_profiles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Company profiles; market value and shares come in millions and are whole units here. An empty profile gives no row."""
    raw = spark.read.schema("ticker string, name string, country string, currency string, exchange string, ipo string, marketCapitalization double, shareOutstanding double, finnhubIndustry string, weburl string").option("multiLine", not lines).json(path)
    return raw.where("ticker <> ''").select("ticker", "name", "country", "currency", "exchange", F.try_to_date("ipo", "yyyy-MM-dd").alias("ipo"), (F.col("marketCapitalization") * 1_000_000).alias("market_value"), (F.col("shareOutstanding") * 1_000_000).alias("shares"), F.col("finnhubIndustry").alias("industry"), F.col("weburl").alias("url"))


def resolve(catalogue: DataFrame) -> DataFrame:
    """(capability, provider): of a catalogue (capability, provider, priority), the first that declares each capability."""
    return catalogue.groupBy("capability").agg(F.min_by("provider", F.struct("priority", "provider")).alias("provider"))


def split(rows: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason against them, rejects with it)."""
    told = rows.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def valid_articles(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, rejects): url and title are there, and the time of publication has a zone."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    zoned = F.coalesce(F.col("published_at").rlike(r"(Z|[+-]\d\d:?\d\d)$") & when(F.col("published_at")).isNotNull(), F.lit(False))
    return split(raw, F.when(empty("url"), "no url").when(empty("title"), "no title").when(~zoned, "no time zone"))


def valid_sentiments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.col("confidence").between(0, 1) & F.col("polarity").between(-1, 1), F.lit(False))
    return rows.where(good), rows.where(~good)


def with_reason(rows: DataFrame) -> DataFrame:
    """Rows (asset_type, company, quantity, average_cost, confidence) with why they are refused, or ``accepted``."""
    reason = F.when((F.col("asset_type") == "equity") & F.col("company").isNull(), "equity without company")
    reason = reason.when((F.col("quantity") < 0) | (F.col("average_cost") < 0), "negative position")
    return rows.withColumn("reason", reason.when(~F.col("confidence").between(0, 1), "confidence out of range").otherwise("accepted"))


def json_metrics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(symbol, metric, value) of the metrics that have one."""
    raw = spark.read.schema("symbol string, metric map<string,double>").option("multiLine", not lines).json(path)
    return raw.select("symbol", F.explode("metric").alias("metric", "value")).where("value is not null")


def json_earnings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.schema("symbol string, period string, actual double, estimate double").option("multiLine", not lines).json(path)
    return raw.select("symbol", day("period").alias("period"), "actual", "estimate").where("period is not null")


def json_insiders(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trades of insiders; those without a price or a day that can be read go."""
    schema = "symbol string, data array<struct<name: string, change: double, transactionPrice: double, transactionDate: string>>"
    one = spark.read.schema(schema).option("multiLine", not lines).json(path).select("symbol", F.explode("data").alias("d"))
    out = one.select("symbol", "d.name", "d.change", F.col("d.transactionPrice").alias("price"), day("d.transactionDate").alias("traded_on"))
    return out.where("price is not null and traded_on is not null")


def json_universe(spark: SparkSession, path: str, mics: list[str], lines: bool = False) -> DataFrame:
    """Listings of the markets named, those without a symbol left out."""
    raw = spark.read.schema("symbol string, description string, mic string, type string").option("multiLine", not lines).json(path)
    some = raw.where(F.col("mic").isin(mics) & (F.trim("symbol") != ""))
    return some.select("symbol", F.col("description").alias("name"), "mic", F.col("type").alias("security_type"))


# fixed values: sections of reported statements
SECTIONS = {"ic": "income", "bs": "balance", "cf": "cash flow"}


def json_statements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(symbol, year, section, concept, value) of reported statements."""
    lines = "array<struct<concept: string, value: double>>"
    schema = f"symbol string, data array<struct<year: int, report: struct<{', '.join(f'{k}: {lines}' for k in SECTIONS)}>>>"
    one = spark.read.schema(schema).option("multiLine", not lines).json(path).select("symbol", F.explode("data").alias("d"))
    sections = F.array(*[F.struct(F.lit(v).alias("section"), F.col(f"d.report.{k}").alias("lines")) for k, v in SECTIONS.items()])
    each = one.select("symbol", "d.year", F.explode(sections).alias("s")).select("symbol", "year", "s.section", F.explode("s.lines").alias("l"))
    return each.select("symbol", "year", "section", "l.concept", "l.value").where("value is not null")
