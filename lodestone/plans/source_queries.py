"""Payloads of providers, made of the tables' rows and written as text: what the sources read back is what the tables have."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import feeds, shared

from .domain import bars, table
from .queries import BARS, query


def recorded(payloads: DataFrame) -> str:
    """A folder of text files with a line for each row (one text column)."""
    path = f"{shared.folder(payloads.sparkSession)}/payloads-{uuid.uuid4().hex}"
    payloads.write.text(path)
    return path


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def listed(rows: DataFrame, by: str, item: Column) -> DataFrame:
    """(by, items): the rows of each ``by`` as an array, in the order of their first field."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))


def order() -> Column:
    return F.col("o_orderkey")


def day() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


@query("""select 'https://n.example/' || o_orderkey as url, 'Order ' || o_orderkey as title, o_orderpriority as source, (cast(o_orderdate as date) + interval 10 hour)::timestamp::timestamptz as published_at
 from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""")
def source_articles(spark: SparkSession, d: str) -> DataFrame:
    """A response for each customer; removed articles and those without a title or a date are left out."""
    title = F.when(order() % 7 == 0, "[Removed]").when(order() % 11 == 0, "").otherwise(F.concat(F.lit("Order "), text(order())))
    when = F.when(order() % 13 == 0, "soon").when(order() % 2 == 0, F.concat(day(), F.lit("T10:00:00Z"))).otherwise(F.concat(day(), F.lit("T12:00:00.000+02:00")))
    one = F.struct(F.concat(F.lit("https://n.example/"), text(order())).alias("url"), F.struct(F.col("o_orderpriority").alias("name")).alias("source"), title.alias("title"), when.alias("publishedAt"))
    made = listed(table(spark, d, "orders"), "o_custkey", one).select(F.to_json(F.struct(F.lit("ok").alias("status"), F.col("items").alias("articles"))))
    return feeds.json_articles(spark, recorded(made), lines=True).select("url", "title", "source", "published_at")


def feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each customer with an item for each order; some have no date."""
    date = F.when(order() % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.when(order() % 2 == 0, " 10:00:00 GMT").otherwise(" 10:00:00 +0100"), F.lit("</pubDate>")))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    item = F.concat(F.lit("<item>"), tag("title", F.concat(F.lit("Order "), text(order()))), tag("link", F.concat(F.lit("https://f.example/"), text(order()))), tag("description", F.col("o_orderpriority")), date, F.lit("</item>"))
    feeds_of = listed(table(spark, d, "orders"), "o_custkey", F.struct(order().alias("k"), item.alias("i")))
    made = feeds_of.select(F.concat(F.lit("<rss><channel><title>Orders</title>"), F.array_join("items.i", ""), F.lit("</channel></rss>")))
    return feeds.rss_items(spark, recorded(made), "1996-01-01", lines=True)


FEED = """feed as (select 'https://f.example/' || o_orderkey as url, 'Order ' || o_orderkey as title, (cast(o_orderdate as date) + case when o_orderkey % 2 = 0 then interval 10 hour else interval 9 hour end)::timestamp::timestamptz as published_at, o_orderkey
 from orders where o_orderkey % 5 <> 0 and cast(o_orderdate as date) >= date '1996-01-01')"""


@query(f"with {FEED} select url, title, published_at from feed")
def source_rss(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).select("url", "title", "published_at")


@query("select 'https://a.example/' || o_orderkey as url, 'Order ' || o_orderkey as title, cast(o_orderdate as date)::timestamp::timestamptz as published_at from orders where o_orderkey % 4 <> 3")
def source_atom(spark: SparkSession, d: str) -> DataFrame:
    """Entries dated by when they were published, else updated, else created."""
    at = F.concat(day(), F.lit("T00:00:00Z"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    dates = F.when(order() % 4 == 0, F.concat(tag("published", at), tag("updated", F.lit("1999-01-01T00:00:00Z")))).when(order() % 4 == 1, tag("updated", at)).when(order() % 4 == 2, tag("created", at)).otherwise("")
    entry = F.concat(F.lit("<entry>"), tag("title", F.concat(F.lit("Order "), text(order()))), F.lit('<link href="https://a.example/'), text(order()), F.lit('"/>'), dates, F.lit("</entry>"))
    entries = listed(table(spark, d, "orders"), "o_custkey", F.struct(order().alias("k"), entry.alias("e")))
    made = entries.select(F.concat(F.lit("<feed>"), F.array_join("items.e", ""), F.lit("</feed>")))
    return feeds.atom_entries(spark, recorded(made), lines=True).select("url", "title", "published_at")


@query(f"with {FEED} select title, case when o_orderkey % 3 = 0 then 'AAA,BBB' else 'AAA' end as tickers from feed")
def source_merged(spark: SparkSession, d: str) -> DataFrame:
    """The feed, and a third of it again from another source that spells addresses otherwise: one article an address, with the tickers of both."""
    one = shared.kept(feed(spark, d), "feed").withColumn("tickers", F.array(F.lit("AAA")))
    again = one.where(F.regexp_extract("url", r"(\d+)$", 1).cast("long") % 3 == 0).withColumn("tickers", F.array(F.lit("BBB"), F.lit("AAA"))).withColumn("url", F.concat(F.upper("url"), F.lit(" ")))
    return feeds.merged_by_url(one.unionByName(again)).select("title", F.array_join("tickers", ",").alias("tickers"))


@query("select lpad(o_custkey::varchar, 10, '0') as cik, o_orderstatus as form, cast(o_orderdate as date) as date, lpad(o_custkey::varchar, 10, '0') || '/' || o_orderkey || '96' as at from orders where o_orderkey % 6 <> 0")
def source_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of each customer in parallel arrays."""
    rows = listed(table(spark, d, "orders"), "o_custkey", F.struct(order().alias("k"), F.col("o_orderstatus").alias("form"), F.when(order() % 6 == 0, "never").otherwise(day()).alias("date"), F.concat(text(order()), F.lit("-96")).alias("accession")))
    raw = rows.select(F.col("o_custkey").alias("cik"), *[F.col(f"items.{c}").alias(c) for c in ("form", "date", "accession")])
    return feeds.filings(raw).select("cik", "form", "date", F.replace("url", F.lit("https://filings.example/"), F.lit("")).alias("at"))


@query(f"with {BARS} select symbol, session::timestamp::timestamptz as opened, round(close, 6) as close, case when day(session) % 4 = 0 then 0 else volume end as volume from bars where day(session) % 5 <> 0 and symbol <> 'Brand#7'")
def source_candles(spark: SparkSession, d: str) -> DataFrame:
    """A response a symbol: prices as text, bars that can't be read, volumes that are missing, and one that is an error's."""
    b, k = bars(spark, d), F.day("session")
    price = lambda c: F.format_string("%.6f", c).alias(c)
    one = F.struct(F.date_format("session", "yyyy-MM-dd").alias("datetime"), F.when(k % 5 == 0, "x").otherwise(F.format_string("%.6f", "open")).alias("open"), *map(price, ("high", "low", "close")), F.when(k % 4 == 0, "").otherwise(text("volume")).alias("volume"))
    status = F.when(F.col("symbol") == "Brand#7", "error").otherwise("ok").alias("status")
    made = listed(b, "symbol", one).select(F.to_json(F.struct(status, F.struct("symbol").alias("meta"), F.col("items").alias("values"))))
    return feeds.json_candles(spark, recorded(made), lines=True).select("symbol", F.col("at").alias("opened"), F.col("close").cast("double").alias("close"), "volume")


@query("select o_totalprice as price, o_totalprice / 2 as previous_close, 100.0::double as change_percent, cast(o_orderdate as date)::timestamp::timestamptz as at from orders where o_orderkey % 9 <> 0")
def source_quotes(spark: SparkSession, d: str) -> DataFrame:
    """A quote for each order; those of an unknown symbol are all zeros."""
    known = lambda c: F.when(order() % 9 == 0, F.lit(0.0)).otherwise(c)
    price = F.col("o_totalprice")
    one = F.struct(known(price).alias("c"), known(price / 2).alias("d"), known(F.lit(100.0)).alias("dp"), known(price).alias("h"), known(price).alias("l"), known(price).alias("o"), known(price / 2).alias("pc"), F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")).alias("t"))
    return feeds.json_quotes(spark, recorded(table(spark, d, "orders").select(F.to_json(one))), lines=True).select("price", "previous_close", "change_percent", "at")


def part() -> Column:
    return F.col("p_partkey")


@query("select 'P' || p_partkey as ticker, p_name as name, date '1980-01-01' + (p_size)::int as ipo, p_retailprice * 1000000 as market_value, p_size * 1000000.0::double as shares from part where p_partkey % 8 <> 0")
def source_profiles(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("P"), text(part())).alias("ticker"), F.col("p_name").alias("name"), F.date_format(F.date_add(F.lit("1980-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd").alias("ipo"), F.col("p_retailprice").alias("marketCapitalization"), F.col("p_size").cast("double").alias("shareOutstanding"))
    made = table(spark, d, "part").select(F.when(part() % 8 == 0, "{}").otherwise(F.to_json(one)))
    return feeds.json_profiles(spark, recorded(made), lines=True).select("ticker", "name", "ipo", "market_value", "shares")


@query("select 'P' || p_partkey as symbol, '52WeekHigh' as metric, p_retailprice as value from part union all select 'P' || p_partkey, 'peTTM', p_size::double from part where p_partkey % 2 = 0")
def source_metrics(spark: SparkSession, d: str) -> DataFrame:
    held = F.create_map(F.lit("52WeekHigh"), F.col("p_retailprice"), F.lit("peTTM"), F.when(part() % 2 == 0, F.col("p_size").cast("double")), F.lit("beta"), F.lit(None).cast("double"))
    made = table(spark, d, "part").select(F.to_json(F.struct(F.concat(F.lit("P"), text(part())).alias("symbol"), held.alias("metric")), {"ignoreNullFields": "false"}))
    return feeds.json_metrics(spark, recorded(made), lines=True)


@query("select 'C' || o_custkey as symbol, cast(o_orderdate as date) as period, o_totalprice as actual, (o_orderkey % 4)::double as estimate, round((o_totalprice - o_orderkey % 4) / nullif(o_orderkey % 4, 0) * 100, 4) as surprise_percent from orders where o_orderkey % 6 <> 0")
def source_earnings(spark: SparkSession, d: str) -> DataFrame:
    """A list of reports for each customer; some have no period that can be read."""
    one = F.struct(F.when(order() % 6 == 0, "x").otherwise(day()).alias("period"), F.concat(F.lit("C"), text("o_custkey")).alias("symbol"), F.col("o_totalprice").alias("actual"), (order() % 4).cast("double").alias("estimate"))
    made = listed(table(spark, d, "orders"), "o_custkey", one).select(F.to_json("items"))
    e = feeds.json_earnings(spark, recorded(made), lines=True)
    return e.withColumn("surprise_percent", F.round(F.try_divide(F.col("actual") - F.col("estimate"), F.abs("estimate")) * 100, 4))


@query("select 'C' || o_custkey as symbol, o_orderpriority as name, (o_orderkey % 21 - 10)::double as change, o_totalprice as price, cast(o_orderdate as date) as traded_on from orders where o_orderkey % 3 <> 0 and o_orderkey % 7 <> 0")
def source_insiders(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("o_orderpriority").alias("name"), (order() % 21 - 10).cast("double").alias("change"), F.when(order() % 3 != 0, F.col("o_totalprice")).alias("transactionPrice"), F.when(order() % 7 == 0, "x").otherwise(day()).alias("transactionDate"))
    made = listed(table(spark, d, "orders"), "o_custkey", one).select(F.to_json(F.struct(F.concat(F.lit("C"), text("o_custkey")).alias("symbol"), F.col("items").alias("data"))))
    return feeds.json_insiders(spark, recorded(made), lines=True)


@query("select c_name as symbol, c_mktsegment as name, case when c_custkey % 3 = 0 then 'XNAS' else 'XNYS' end as mic, 'Common Stock' as security_type from customer where c_custkey % 3 <> 2 and c_custkey % 10 <> 0")
def source_universe(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    one = F.struct(F.when(c % 10 == 0, " ").otherwise(F.col("c_name")).alias("symbol"), F.col("c_mktsegment").alias("description"), F.when(c % 3 == 0, "XNAS").when(c % 3 == 1, "XNYS").otherwise("OOTC").alias("mic"), F.lit("Common Stock").alias("type"))
    made = listed(table(spark, d, "customer"), "c_nationkey", one).select(F.to_json("items"))
    return feeds.json_universe(spark, recorded(made), ["XNAS", "XNYS"], lines=True)


@query("""with s as (select 'C' || o_custkey as symbol, year(o_orderdate)::int as year, sum(round(o_totalprice * 100)::bigint)::double as revenue, count(*)::double as n from orders group by all)
 select symbol, year, 'income' as section, 'Revenue' as concept, revenue as value from s union all select symbol, year, 'income', 'Orders', n from s union all select symbol, year, 'balance', 'Assets', revenue * 2 from s where n > 1""")
def source_statements(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n"))
    line = lambda name, c: F.struct(F.lit(name).alias("concept"), c.alias("value"))
    report = F.struct(F.array(line("Revenue", F.col("revenue")), line("Orders", F.col("n"))).alias("ic"), F.array(line("Assets", F.when(F.col("n") > 1, F.col("revenue") * 2))).alias("bs"))
    made = listed(sums, "o_custkey", F.struct("year", report.alias("report"))).select(F.to_json(F.struct(F.concat(F.lit("C"), text("o_custkey")).alias("symbol"), F.col("items").alias("data"))))
    return feeds.json_statements(spark, recorded(made), lines=True)


@query("""select o_orderkey as k, case o_orderkey % 4 when 0 then null when 1 then null else o_orderkey + 0.5 end::double as number, case when o_orderkey % 5 <> 0 then floor(o_orderkey + 0.9) end::bigint as whole,
 case when o_orderkey % 3 <> 0 then cast(o_orderdate as date) end as day from orders""")
def source_coercions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and days of any spelling; what is none is null."""
    n = F.when(order() % 4 == 0, "n/a").when(order() % 4 == 1, "Infinity").otherwise(F.concat(F.lit(" "), text(order()), F.lit(".5 ")))
    w = F.when(order() % 5 == 0, "").otherwise(F.concat(text(order()), F.lit(".9")))
    raw = table(spark, d, "orders").select(order().alias("k"), n.alias("n"), w.alias("w"), F.when(order() % 3 == 0, "soon").otherwise(F.concat(day(), F.lit("T10:00:00Z"))).alias("d"))
    return raw.select("k", feeds.number("n").alias("number"), feeds.whole("w").alias("whole"), feeds.day("d").alias("day"))
