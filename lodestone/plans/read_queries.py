"""Filtered and ranked reads, lookups, joins of dimensions and small aggregates, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import indicators, portfolio, reads

from .domain import anomalies, articles, bars, listings, table
from .queries import BARS, RETURNS, query, trading_calendar

LISTINGS = """listings as (select s_suppkey as id, upper(replace(s_name, 'Supplier#0000', 'S')) as symbol, concat_ws(' ', n_name, s_name) as name, r_name as exchange,
 case when s_suppkey % 5 = 0 then 'etf' else 'equity' end as asset_type, s_suppkey % 7 <> 0 as is_active,
 case when s_suppkey % 4 <> 0 then date '1998-06-01' - (s_suppkey % 30)::int end as last_session,
 case when s_nationkey < 12 then 'a' else 'b' end as source, date '1998-06-01' - (s_suppkey % 11)::int as synced_at
 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
ARTICLES = """articles as (select doc_id as article, sha256(doc_id::varchar) as url_hash, string_split(text, chr(10))[1] as title, string_split(text, chr(10))[2] as summary,
 timestamp '1996-01-01' + doc_id * interval 1 hour as published_at,
 case when doc_id % 5 = 0 then [] else ['Brand#' || (doc_id % 25 + 1), 'Brand#' || (doc_id * 3 % 25 + 1)] end as tickers,
 case when doc_id % 3 = 0 then [source] else [] end as tags, case when doc_id % 4 <> 0 then case when lang = 'en' then 'bullish' else 'bearish' end end as sentiment from documents)"""
ANOMALIES = """anomalies as (select o_orderkey as id, 'Brand#' || (o_custkey % 25 + 1) as symbol, o_orderdate::date as session,
 ['return', 'volume', 'volatility'][o_orderkey % 3 + 1] as feature, ['low', 'medium', 'high', 'extreme'][o_orderkey % 4 + 1] as severity,
 (o_orderkey % 100) / 100 as confidence, ['up', 'down'][o_orderkey % 2 + 1] as direction,
 case when o_orderkey % 2 = 0 then 1 else -1 end * (o_orderkey % 13) / 100 as value, case when o_orderkey % 3 = 0 then 'told' end as explanation from orders)"""
CALENDAR = """s as (select n_name as exchange, cast(o_orderdate as date) as session from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
 span as (select exchange, unnest(generate_series(min(session)::timestamp, max(session)::timestamp, interval 1 day))::date as day from s group by exchange),
 calendar as (select span.exchange, span.day, s.session is not null as is_trading_day from span left join s on s.exchange = span.exchange and s.session = span.day)"""


@query(f"with {LISTINGS} select id, symbol, name from listings where symbol in ('S00001', 'S00007')")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return reads.lookup(listings(spark, d), "symbol", [" s00001", "S00007 ", "nowhere"]).select("id", "symbol", "name")


@query("select c_custkey, upper(trim('  ' || c_name || ' ')) as symbol, lower(trim(' ' || c_name)) || '@mail.example' as email from customer where lower(trim(c_name)) in ('customer#000000003', 'customer#000000011')")
def address_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("low", reads.normal(F.concat(F.lit(" "), "c_name"), upper=False))
    found = reads.lookup(c, "low", [" Customer#000000003", "CUSTOMER#000000011"], upper=False)
    return found.select("c_custkey", reads.normal(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("symbol"), F.concat("low", F.lit("@mail.example")).alias("email"))


@query(f"with {LISTINGS} select id, name from listings where contains(lower(name), 'nation_1') or contains(lower(exchange), 'nation_1') order by name limit 20")
def company_search(spark: SparkSession, d: str) -> DataFrame:
    return reads.named_like(listings(spark, d), " NATION_1", ["name", "exchange"], ["name"]).select("id", "name")


@query(f"with {LISTINGS} select id, symbol, asset_type from listings where is_active and asset_type = 'etf'")
def active_listings(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where(F.col("is_active") & (F.col("asset_type") == "etf")).select("id", "symbol", "asset_type")


@query(f"with {LISTINGS} select id, symbol, last_session from listings where is_active and (last_session is null or last_session < date '1998-05-15')")
def stale_queue(spark: SparkSession, d: str) -> DataFrame:
    return reads.stale(listings(spark, d), "1998-05-15").select("id", "symbol", "last_session")


@query(f"with {ARTICLES} select article, published_at from articles where published_at >= timestamp '1996-01-03' and published_at <= timestamp '1996-02-20' and list_has_any(tickers, ['Brand#4', 'Brand#9']) and list_has_any(tags, ['src3', 'src6', 'src8', 'src0']) order by published_at desc, article limit 50")
def news_window(spark: SparkSession, d: str) -> DataFrame:
    found = reads.news_window(articles(spark, d).withColumn("tickers", F.transform("tickers", lambda t: F.lower(t))), "1996-01-03", "1996-02-20", [" brand#4", "BRAND#9"], ["src3", "src6", "src8", "src0"], 50)
    return found.select("article", "published_at")


@query(f"with {ARTICLES} select article, published_at from articles where sentiment is null and published_at >= timestamp '1996-01-02' order by published_at, article limit 100")
def unscored_queue(spark: SparkSession, d: str) -> DataFrame:
    return reads.unscored(articles(spark, d), "1996-01-02", 100).select("article", "published_at")


@query(f"with {ARTICLES} select (select count(*) > 0 from articles where url_hash = sha256('7')) as found, (select count(*) from articles where published_at >= timestamp '1996-01-05') as since")
def news_exists(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    recent = F.count_if(F.col("published_at") >= F.lit("1996-01-05").cast("timestamp_ntz")).alias("since")
    return a.agg(F.coalesce(F.bool_or(F.col("url_hash") == F.sha2(F.lit("7"), 256)), F.lit(False)).alias("found"), recent)


@query(f"with {ANOMALIES}, {LISTINGS} select a.id, a.symbol, session, severity, l.name from anomalies a join listings l on l.id = cast(substr(a.symbol, 7) as int) where session between date '1996-01-01' and date '1997-12-31' and severity in ('high', 'extreme') and feature = 'return' order by session desc, a.id limit 100")
def anomaly_feed(spark: SparkSession, d: str) -> DataFrame:
    some = reads.between(anomalies(spark, d), "session", "1996-01-01", "1997-12-31").where("feature = 'return'")
    top = reads.newest(reads.at_least(some, "high"), [F.desc("session"), "id"], 100)
    names = listings(spark, d).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("symbol"), "name")
    return top.join(names, "symbol").select("id", "symbol", "session", "severity", "name")


@query(f"with {ANOMALIES} select id, symbol, session, confidence from anomalies where explanation is null order by session desc, confidence desc, id limit 50")
def unexplained_queue(spark: SparkSession, d: str) -> DataFrame:
    queue = anomalies(spark, d).where("explanation is null")
    return reads.newest(queue, [F.desc("session"), F.desc("confidence"), "id"], 50).select("id", "symbol", "session", "confidence")


@query(f"with {ANOMALIES} select id, session, feature, row_number() over (order by session desc, id) as place from anomalies where symbol = 'Brand#5' and session between date '1996-01-01' and date '1996-12-31'")
def ticker_anomalies(spark: SparkSession, d: str) -> DataFrame:
    own = reads.between(anomalies(spark, d), "session", "1996-01-01", "1996-12-31").where("symbol = 'Brand#5'")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session"), "id"))
    return own.select("id", "session", "feature", place.alias("place"))


def asked_days(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("exchange"), F.col("n_nationkey").alias("k"))
    days = F.sequence(F.lit("1994-12-20").cast("date"), F.lit("1995-03-01").cast("date"))
    return n.where("k < 20").select("exchange", F.explode(days).alias("day"))


ASKED = "asked as (select n_name as exchange, unnest(generate_series(timestamp '1994-12-20', timestamp '1995-03-01', interval 1 day))::date as day from nation where n_nationkey < 20)"


@query(f"with {CALENDAR}, {ASKED} select exchange, day, case when is_trading_day then 'open' when not is_trading_day then 'closed' else 'unknown' end as state from asked left join calendar using (exchange, day)")
def trading_day_state(spark: SparkSession, d: str) -> DataFrame:
    told = reads.trading_state(asked_days(spark, d), trading_calendar(spark, d))
    return told.select("exchange", "day", F.when(F.col("is_trading_day"), "open").when(~F.col("is_trading_day"), "closed").otherwise("unknown").alias("state"))


@query(f"with {CALENDAR}, {ASKED} select a.exchange, a.day, max(c.day) as last_open from asked a left join calendar c on c.exchange = a.exchange and c.is_trading_day and c.day <= a.day group by all")
def latest_trading_day(spark: SparkSession, d: str) -> DataFrame:
    return reads.trading_day_before(asked_days(spark, d), trading_calendar(spark, d))


@query(f"with {CALENDAR} select exchange, day from calendar where is_trading_day and day between date '1996-01-01' and date '1996-03-31'")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    return reads.between(trading_calendar(spark, d), "day", "1996-01-01", "1996-03-31").where("is_trading_day").select("exchange", "day")


@query("select p_partkey, p_name from part where contains(lower(p_name), '12') or contains(lower(p_brand), '12') or p_type = 'SMALL' order by length(p_name), p_name, p_partkey limit 25")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    hit = F.contains(F.lower("p_name"), F.lit("12")) | F.contains(F.lower("p_brand"), F.lit("12")) | (F.col("p_type") == "SMALL")
    return p.where(hit).orderBy(F.length("p_name"), "p_name", "p_partkey").limit(25).select("p_partkey", "p_name")


@query("select p_partkey, p_type from part where p_brand in ('Brand#3', 'Brand#8') and list_has_any(string_split(p_type, ' '), ['SMALL', 'PROMO'])")
def entities_by_kind(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(F.col("p_brand").isin("Brand#3", "Brand#8")).withColumn("tags", F.split("p_type", " "))
    return reads.with_tags(p, "tags", ["SMALL", "PROMO"]).select("p_partkey", "p_type")


@query(f"with {BARS}, {RETURNS} select symbol, session, round(daily_return, 6) as daily_return from rets where session between date '1996-06-30' - 180 and date '1996-06-30'")
def feature_window(spark: SparkSession, d: str) -> DataFrame:
    start, end = reads.window(None, None, date(1996, 6, 30))
    out = reads.between(indicators.returns(bars(spark, d)), "session", start, end)
    return out.select("symbol", "session", F.round("daily_return", 6).alias("daily_return"))


@query("select o_orderkey, o_orderpriority from orders where o_custkey = 5")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.owned(table(spark, d, "orders"), "o_custkey", 5).select("o_orderkey", "o_orderpriority")


@query("select conv_id, max(turn) as last_turn, arg_max(text, turn) filter (where role = 'user') as last_question from conversations group by conv_id order by last_turn desc, conv_id limit 20")
def recent_conversations(spark: SparkSession, d: str) -> DataFrame:
    return reads.recent_conversations(table(spark, d, "conversations"), 20)


@query("select o_custkey as symbol, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as report, max(o_orderdate) as generated_at from orders where o_orderpriority = '2-HIGH' and o_orderdate >= timestamp '2001-06-01' group by o_custkey")
def fresh_reports(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "orders").where((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")))
    return made.groupBy(F.col("o_custkey").alias("symbol")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("report"), F.max("o_orderdate").alias("generated_at"))


@query(f"with {BARS}, {LISTINGS} select b.symbol, b.close, l.name from bars b join listings l on l.id = cast(substr(b.symbol, 7) as int) where b.session = date '1996-07-01'")
def cross_section(spark: SparkSession, d: str) -> DataFrame:
    day = bars(spark, d).where(F.col("session") == F.lit("1996-07-01").cast("date"))
    names = listings(spark, d).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("symbol"), "name")
    return day.join(names, "symbol").select("symbol", "close", "name")


@query("select distinct o_custkey as user, p_brand as symbol from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where o_orderpriority = '1-URGENT' and o_custkey < 100")
def tracked_symbols(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_custkey < 100")
    return portfolio.tracked(lists.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("list")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("ticker")), table(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("symbol")))


@query(f"with {LISTINGS}, tracked as (select distinct l_suppkey as id from lineitem where l_shipdate >= timestamp '2001-06-01' and l_quantity > 45) select id, symbol, id in (select id from tracked) as tracked from listings")
def tracked_listings(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45))
    return reads.flag(listings(spark, d), recent.select(F.col("l_suppkey").alias("id")), "id", "tracked").select("id", "symbol", "tracked")


@query("with i as (select distinct o_custkey as user, o_orderpriority as list, p_brand as symbol from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where o_custkey < 200) select user, list, string_agg(symbol, ',' order by symbol) as symbols, count(*) as n from i group by all")
def nested_watchlists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey < 200").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("list"))
    i, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    met = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    nested = portfolio.nested(met.select("user", "list", F.col("p_brand").alias("symbol")), ["user", "list"])
    return nested.select("user", "list", F.array_join("items.symbol", ",").alias("symbols"), F.size("items").cast("long").alias("n"))


@query(f"with {LISTINGS} select exchange as slug, string_agg(symbol, ',' order by symbol) as symbols from listings where is_active group by exchange")
def slug_symbols(spark: SparkSession, d: str) -> DataFrame:
    by = listings(spark, d).where("is_active").groupBy(F.col("exchange").alias("slug")).agg(F.array_sort(F.collect_list("symbol")).alias("s"))
    return by.select("slug", F.array_join("s", ",").alias("symbols"))


@query(f"with {BARS} select max(session) as last, (date '2002-01-01' - max(session)) * 86400 as age_seconds from bars where session < (select max(session) from bars)")
def data_age(spark: SparkSession, d: str) -> DataFrame:
    from .domain import flagged

    return reads.age_seconds(flagged(bars(spark, d)).where(~F.col("is_provisional")), "session", "2002-01-01")


@query(f"with {LISTINGS} select exchange, max(synced_at) as synced_at, count(*) filter (where is_active) as active, count(*) as n from listings group by exchange")
def universe_stats(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("exchange").agg(F.max("synced_at").alias("synced_at"), F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("n"))


@query(f"with {BARS}, {RETURNS}, r as (select * from rets where session = date '1996-07-01'), c as (select count(*) filter (where daily_return > 0) as advancers, count(*) filter (where daily_return < 0) as decliners, count(*) filter (where daily_return = 0) as unchanged, round(avg(daily_return), 6) as average_return from r) select *, case when advancers + decliners = 0 then 'flat' when advancers / (advancers + decliners) >= 0.6 then 'up' when advancers / (advancers + decliners) <= 0.4 then 'down' else 'mixed' end as regime from c")
def market_breadth(spark: SparkSession, d: str) -> DataFrame:
    r = indicators.returns(bars(spark, d)).where(F.col("session") == F.lit("1996-07-01").cast("date"))
    return reads.breadth(r)


@query(f"with {LISTINGS} select symbol, name from listings where is_active and (contains(symbol, 'S0000') or contains(upper(name), 'S0000')) order by (symbol <> 'S0000')::int, (not starts_with(symbol, 'S0000'))::int, length(symbol), symbol, name limit 10")
def active_listing_search(spark: SparkSession, d: str) -> DataFrame:
    return reads.listing_search(listings(spark, d), "s0000 ", 10, active_only=True).select("symbol", "name")


@query(f"""with {BARS}, {RETURNS}, {ANOMALIES}, r as (select * from rets where session = date '1996-07-01'), c as (select count(*) filter (where daily_return > 0) as advancers, count(*) filter (where daily_return < 0) as decliners, count(*) filter (where daily_return = 0) as unchanged, round(avg(daily_return), 6) as average_return from r)
 select *, case when advancers + decliners = 0 then 'flat' when advancers / (advancers + decliners) >= 0.6 then 'up' when advancers / (advancers + decliners) <= 0.4 then 'down' else 'mixed' end as regime, (select count(*) from anomalies where session = date '1996-07-01') as anomalies from c""")
def market_day(spark: SparkSession, d: str) -> DataFrame:
    """The market on a day, with the number of findings."""
    on = F.col("session") == F.lit("1996-07-01").cast("date")
    return reads.breadth(indicators.returns(bars(spark, d)).where(on), anomalies(spark, d).where(on))


@query("with l as (select distinct c_custkey as list from customer), i as (select o_custkey as list, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) - 1 as position from orders) select l.list, coalesce(max(position) + 1, 0) as next_position from l left join i using (list) group by l.list")
def next_position(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")) - 1
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("list"), nth.alias("position"))
    return reads.next_position(items, table(spark, d, "customer").select(F.col("c_custkey").alias("list")).distinct(), "list")


@query("with l as (select o_custkey as user, o_orderpriority as name, min(o_orderdate) as created_at from orders group by all), f as (select *, row_number() over (partition by user order by created_at, name) = 1 as is_default from l) select user, name, row_number() over (partition by user order by (not is_default)::int, name) as place from f")
def watchlist_order(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("created_at"))
    return portfolio.ordered(portfolio.with_default(lists)).select("user", "name", "place")


@query(f"with {BARS}, q as (select symbol, arg_max(close, session) as close from bars where symbol <> 'Brand#2' group by symbol), asked as (select unnest(['Brand#1', 'Brand#2', 'Brand#3', 'Brand#99']) as symbol) select symbol, close from asked join q using (symbol)")
def batch_quotes(spark: SparkSession, d: str) -> DataFrame:
    closes = reads.latest(bars(spark, d).where("symbol <> 'Brand#2'"), "symbol", "session")
    return portfolio.priced([" brand#1", "Brand#2", "Brand#3", "Brand#99"], closes)


@query("select k, n, round((n - e) / nullif(abs(e), 0) * 100, 4) as surprise_percent, round(e - n, 4) as spread from (select c_custkey as k, c_acctbal as n, (c_custkey % 5 - 2) * 100.0 as e from customer)")
def earnings_surprise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("n"), ((F.col("c_custkey") % 5 - 2) * 100.0).alias("e"))
    return c.select("k", "n", F.round(portfolio.surprise(F.col("n"), F.col("e")), 4).alias("surprise_percent"), F.round(portfolio.spread(F.col("n"), F.col("e")), 4).alias("spread"))


@query("select s_suppkey as symbol, case when s_suppkey % 6 = 0 then date '1998-06-01' - 730 else date '1998-06-01' - (s_suppkey % 40)::int - 5 end as start from supplier")
def ingestion_window(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    last = F.when(k % 6 != 0, F.date_sub(F.lit("1998-06-01").cast("date"), (k % 40).cast("int")))
    return table(spark, d, "supplier").select(k.alias("symbol"), indicators.window_start(last, F.lit("1998-06-01").cast("date")).alias("start"))


@query("select outcome, count(*) as n, sum(written)::bigint as written from (select case when o_orderkey % 9 = 0 then 'failed' when o_orderkey % 7 = 0 then 'skipped' else 'succeeded' end as outcome, case when o_orderkey % 9 = 0 or o_orderkey % 7 = 0 then 0 else o_orderkey % 5 end as written from orders) group by outcome")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 9 == 0, "failed").when(k % 7 == 0, "skipped").otherwise("succeeded")
    runs = table(spark, d, "orders").select(outcome.alias("outcome"), F.when((k % 9 == 0) | (k % 7 == 0), 0).otherwise(k % 5).alias("written"))
    return reads.report(runs)
