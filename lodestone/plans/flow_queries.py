"""Writes as next states of tables, detection runs, validation and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import anomaly, indicators, merge, reads
from lodestone.sources import feeds, shared, tables
from lodestone.streaming import quotes, state

from .domain import anomalies, articles, bars, flagged, listings, table
from .queries import BARS, OBSERVED, RETURNS, ZED, forest_sql, observations, query
from .read_queries import ANOMALIES, ARTICLES, LISTINGS


@query(f"with {BARS}, last as (select symbol, max(session) as l from bars where session < (select max(session) from bars) group by symbol) select symbol, session, close from bars join last using (symbol) where session <= l")
def feature_sweep(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    done = flagged(b).where(~F.col("is_provisional")).groupBy("symbol").agg(F.max("session").alias("session"))
    return merge.delete_after(b.select("symbol", "session", "close"), done, "symbol", "session")


@query(f"with {ANOMALIES} select id, feature, severity, case when id % 4 = 0 then null else explanation end as explanation from anomalies")
def anomaly_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = anomalies(spark, d).select("id", "feature", "severity", "explanation")
    again = old.where("id % 4 = 0").withColumn("explanation", F.lit(None).cast("string"))
    return merge.upsert(old, again, ["id", "feature"])


@query("select distinct doc_id as source_id, part as chunk_index, case when doc_id % 3 = 0 then 'new' else 'old' end as version from documents, range(3) r(part) where not (doc_id % 3 = 0 and part = 2)")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id")).distinct()
    parts = lambda n, v: docs.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("chunk_index"), F.lit(v).alias("version"))
    return merge.replace_for(parts(3, "old"), parts(2, "new").where("source_id % 3 = 0"), "source_id")


CHUNKED = "chunked as (select doc_id as source_id, case when doc_id % 3 = 0 then 'm1' else 'm2' end as embedding_model from documents where doc_id % 2 = 0)"


def chunked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").where("doc_id % 2 = 0").select(k.alias("source_id"), F.when(k % 3 == 0, "m1").otherwise("m2").alias("embedding_model"))


@query(f"with {CHUNKED} select source_id, embedding_model from chunked where embedding_model is distinct from 'm1'")
def drop_model_chunks(spark: SparkSession, d: str) -> DataFrame:
    return merge.without_model(chunked(spark, d), "m1")


@query(f"with {CHUNKED} select distinct source_id from chunked where embedding_model = 'm2'")
def sources_of_model(spark: SparkSession, d: str) -> DataFrame:
    return chunked(spark, d).where("embedding_model = 'm2'").select("source_id").distinct()


@query(f"with {CHUNKED}, {ARTICLES} select article, published_at from articles where article not in (select source_id from chunked where embedding_model = 'm1') and published_at >= timestamp '1996-01-03' order by published_at desc, article limit 200")
def pending_index(spark: SparkSession, d: str) -> DataFrame:
    news = articles(spark, d).where(F.col("published_at") >= F.lit("1996-01-03").cast("timestamp_ntz")).select("article", "published_at")
    return reads.newest(merge.lacking(news, chunked(spark, d), "m1"), [F.desc("published_at"), "article"], 200)


@query(f"with {ARTICLES} select url_hash, coalesce(case when article % 4 = 0 then 'neutral' end, sentiment) as sentiment from articles")
def set_sentiments(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).select("article", "url_hash", "sentiment")
    scored = a.where("article % 4 = 0").select("url_hash", F.lit("neutral").alias("sentiment"))
    return merge.coalesce_set(a, scored.unionByName(scored), "url_hash", "sentiment").select("url_hash", "sentiment")


@query(f"with {LISTINGS}, n as (select symbol, name || ' ' || k as name, k from listings, range(3) r(k) where id % 2 = 0) select symbol, name from n where k = 2 union all select symbol, name from listings where id % 2 <> 0")
def universe_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = listings(spark, d).select("symbol", "name", "id").withColumn("k", F.lit(0))
    batch = old.where("id % 2 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("name", F.concat_ws(" ", "name", "k"))
    return merge.upsert(old, batch, ["symbol"], order="k").select("symbol", "name")


@query(f"with {ANOMALIES} select id, case when id % 10 = 1 then 'because ' || symbol else explanation end as explanation, case when id % 10 = 1 then 2 else 0 end as documents from anomalies")
def attach_explanation(spark: SparkSession, d: str) -> DataFrame:
    a = anomalies(spark, d).withColumn("documents", F.array().cast("array<long>"))
    told = a.where("id % 10 = 1").select("id", F.concat(F.lit("because "), "symbol").alias("explanation"), F.array("id", F.col("id") + 1).alias("documents"))
    return merge.attach(a, told).select("id", "explanation", F.size("documents").alias("documents"))


@query("select conv_id, turn, role from conversations union all select conv_id, max(turn) + 1, 'user' from conversations group by conv_id")
def chat_append(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return merge.append(old, old.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), F.lit("user").alias("role")))


@query("select o_custkey as symbol, o_orderpriority as model, max(o_orderdate) as generated_at from orders group by all")
def report_store(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("generated_at"), "o_orderkey")
    old = made.where("o_orderkey % 2 = 0").groupBy("symbol", "model").agg(F.max("generated_at").alias("generated_at"))
    new = merge.newer(made.where("o_orderkey % 2 = 1").select("symbol", "model", "generated_at"), old, ["symbol", "model"], "generated_at")
    return merge.upsert(old, new, ["symbol", "model"], order="generated_at")


EXCHANGES = "case when cast(substr(symbol, 7) as int) <= 12 then 'east' else 'west' end"
RUN = f"""{OBSERVED}, cal as (select distinct 'east' as exchange, session, day(session) % 9 <> 0 as is_trading_day from bars),
 last500 as (select *, {EXCHANGES} as exchange from obs qualify row_number() over (partition by symbol order by session desc) <= 500 and count(*) over (partition by symbol) >= 60),
 kept as (select l.* from last500 l left join cal c using (exchange, session) where l.exchange = 'west' or coalesce(c.is_trading_day, false)),
 recent as (select symbol, session from kept qualify row_number() over (partition by symbol order by session desc) <= 30),
 {ZED[len(OBSERVED) + 2:].replace("from obs ", "from kept ")}"""


def detection_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, d)
    obs = indicators.observations(b).withColumn("exchange", F.when(F.substring("symbol", 7, 3).cast("int") <= 12, "east").otherwise("west"))
    days = b.select(F.lit("east").alias("exchange"), F.col("session").alias("day"), (F.day("session") % 9 != 0).alias("is_trading_day")).distinct()
    return obs, days


@query(f"with {RUN} select f.* from found f join recent using (symbol, session)")
def detection_run(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.run(*detection_input(spark, d), lone=False).drop("method")


STRENGTH = f"strength as (select a.symbol, a.session, a.daily_return - b.daily_return as relative_strength from rets a left join (select * from rets where symbol = 'Brand#1') b using (session))"


@query(f"""with {RUN}, {STRENGTH}, whole as (select k.symbol, k.session, k.daily_return as f0, k.volume_ratio as f1, k.volatility_20 as f2, s.relative_strength as f3 from kept k join strength s using (symbol, session)
 where k.daily_return is not null and k.volume_ratio is not null and k.volatility_20 is not null and s.relative_strength is not null), {forest_sql()}
 select f.*, 'zscore' as method from found f join recent using (symbol, session) union all
 select symbol, session, 'return', null, abs(decision), null, severity, confidence, 'isolation_forest' from lone join recent using (symbol, session)""")
def detection_both(spark: SparkSession, d: str) -> DataFrame:
    """Both detectors' findings."""
    obs, days = detection_input(spark, d)
    strength = indicators.relative_strength(bars(spark, d), "Brand#1")
    return anomaly.run(obs.join(strength, ["symbol", "session"]), days)


@query("select n_nationkey as sessions, date '1998-06-01' - (floor(n_nationkey * 1.6)::int + 7) as since from nation")
def detection_since(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("sessions"))
    return n.select("sessions", anomaly.default_since(F.lit("1998-06-01").cast("date"), F.col("sessions")).alias("since"))


@query(f"with {ZED} select symbol, session, feature, med as median, n as observations from found join med using (symbol, feature)".replace("med as median", "round(med, 6) as median"))
def anomaly_context(spark: SparkSession, d: str) -> DataFrame:
    told = anomaly.detect(observations(spark, d), context=True)
    c = F.from_json("context", "median double, mad double, observations long")
    return told.withColumn("c", c).select("symbol", "session", "feature", "c.median", "c.observations")


@query("select case when url is null or url = '' then 'no url' when page_id % 7 = 0 then 'no title' when page_id % 11 = 0 then 'no time zone' else 'accepted' end as reason, count(*) as n from (select page_id, case when page_id % 5 = 0 then '' else url end as url from pages) group by reason")
def article_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    raw = table(spark, d, "pages").select(
        F.when(k % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.when(k % 7 == 0, " ").otherwise("t").alias("title"),
        F.when(k % 11 == 0, "1996-01-01T00:00:00").otherwise("1996-01-01T00:00:00Z").alias("published_at"),
    )
    good, bad = feeds.valid_articles(raw)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n"))


@query("select c_custkey, c_acctbal / 5000 between 0 and 1 and c_acctbal / 8000 between -1 and 1 as valid from customer")
def sentiment_validation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("confidence"), (F.col("c_acctbal") / 8000).alias("polarity"))
    good, bad = feeds.valid_sentiments(c)
    return good.select("c_custkey", F.lit(True).alias("valid")).unionByName(bad.select("c_custkey", F.lit(False).alias("valid")))


@query(f"with {LISTINGS} select id, case when asset_type = 'equity' and id % 4 = 1 then 'equity without company' when id % 9 = 2 then 'negative position' when id % 8 = 3 then 'confidence out of range' else 'accepted' end as reason from listings")
def row_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    rows = listings(spark, d).select("id", "asset_type", F.when(k % 4 != 1, k).alias("company"), F.when(k % 9 == 2, -1.0).otherwise(1.0).alias("quantity"), F.lit(0.0).alias("average_cost"), F.when(k % 8 == 3, 1.5).otherwise(0.5).alias("confidence"))
    return feeds.with_reason(rows).select("id", "reason")


#: Days that part the events' month; those of a third arrive together.
FIRST, SECOND = "2024-01-11", "2024-01-21"


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """(file, symbol, ts, event_id, version, price): events as they arrive, a file after the other. Some come a file late, some two,
    some are sent again with the next file, and some are corrected with it (version 1)."""
    k = F.col("event_id")
    base = F.when(F.col("ts") < FIRST, 0).when(F.col("ts") < SECOND, 1).otherwise(2)
    slow = F.when(k % 10 == 3, 1).when(k % 10 == 4, 2).otherwise(0)
    own = F.array(F.struct((base + slow).alias("file"), F.lit(0).alias("version"), F.col("value").alias("price")))
    again = F.array(F.struct((base + 1).alias("file"), F.lit(0).alias("version"), F.col("value").alias("price")))
    right = F.array(F.struct((base + 1).alias("file"), F.lit(1).alias("version"), (F.col("value") + 1).alias("price")))
    none = F.slice(own, 1, 0)
    sent = F.concat(own, F.when((k % 7 == 2) & (slow == 0), again).otherwise(none), F.when((k % 11 == 5) & (slow == 0), right).otherwise(none))
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.explode(sent).alias("s")).select("s.file", "symbol", "ts", "event_id", "s.version", "s.price")


ARRIVALS = f"""base as (select *, case when ts < timestamp '{FIRST}' then 0 when ts < timestamp '{SECOND}' then 1 else 2 end as base, case event_id % 10 when 3 then 1 when 4 then 2 else 0 end as slow from events),
 arr as (select base + slow as file, event_type as symbol, ts, event_id, 0 as version, value as price from base
  union all select base + 1, event_type, ts, event_id, 0, value from base where event_id % 7 = 2 and slow = 0
  union all select base + 1, event_type, ts, event_id, 1, value + 1 from base where event_id % 11 = 5 and slow = 0),
 mark as (select f.file, (select max(ts) from arr where arr.file <= f.file - 2) - interval 1 day as wm from (select distinct file from arr) f),
 taken as (select arr.* from arr join mark using (file) where wm is null or ts > wm qualify row_number() over (partition by event_id, version order by file) = 1)"""


def arrived(spark: SparkSession, d: str) -> DataFrame:
    every = shared.kept(arrivals(spark, d), "arrivals")
    return state.arriving(spark, [every.where(F.col("file") == k).drop("file") for k in range(5)])


@query(f"with {ARRIVALS} select symbol, event_id, price from taken qualify lag(price) over (partition by symbol order by file, ts, event_id) is distinct from price")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed prices over five batches, with value state and timers; what comes again or behind the watermark is dropped."""
    with state.state_store(spark):
        return shared.finished(state.changes(arrived(spark, d)))


@query(f"""with {ARRIVALS}, seen as (select distinct file, symbol from taken),
 closes as (select seen.file, seen.symbol, t.ts::date as session, arg_max(price, row(ts, event_id, version)) as close from seen join taken t on t.symbol = seen.symbol and t.file <= seen.file group by all),
 two as (select *, lag(close) over w as before, row_number() over (partition by file, symbol order by session desc) as nth from closes window w as (partition by file, symbol order by session)),
 sent as (select * from two where nth = 1 qualify row(session, close) is distinct from lag(row(session, close)) over (partition by symbol order by file))
 select symbol, strftime(session, '%Y-%m-%d') as session, format('{{:.2f}}', close) as close, case when before <> 0 then format('{{:.4f}}', round((close - before) / before * 100, 4)) end as change_percent from sent""")
def stream_messages(spark: SparkSession, d: str) -> DataFrame:
    with state.state_store(spark):
        return shared.finished(state.messages(arrived(spark, d)))


def late_bars(spark: SparkSession, d: str) -> tuple[tables.Table, list[tuple[int, int, int, int]]]:
    made = tables.stored(spark, "late-bars", "symbol string, session date, close double, seen array<long>", ("symbol", "session"), "cast(date_trunc('week', session) as date)")
    ticks = arrived(spark, d).select("symbol", F.to_date("ts").alias("session"), F.col("price").alias("close"), F.array(F.unix_micros("ts"), F.col("event_id").cast("long"), F.col("version").cast("long")).alias("seen"))
    return made, tables.merged_stream(ticks, made, "seen")


@query(f"with {ARRIVALS} select symbol, ts::date as session, arg_max(price, row(ts, event_id, version)) as close from arr group by all")
def stream_late_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes in a stored table by week: five batches with late and corrected ticks touch the weeks they have ticks of."""
    return late_bars(spark, d)[0].read(spark).drop("seen")


@query(f"""with {ARRIVALS}, k as (select file, symbol, ts::date as session, max(row(ts, event_id, version)) as r from arr group by all),
 n as (select *, max(r) over (partition by symbol, session order by file rows between unbounded preceding and 1 preceding) as before from k),
 c as (select file, count(*) filter (where before is null) as inserted, count(*) filter (where before is not null and before <= r) as matched from n group by file)
 select file as batch, (select count(*) from arr where arr.file = c.file) as rows, inserted, matched from c""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each batch as the stream's progress reports them, and the keys that its merge inserted and matched."""
    return spark.createDataFrame(late_bars(spark, d)[1], "batch long, rows long, inserted long, matched long")


@query(f"with {OBSERVED} select symbol, session, case when day(session) % 3 <> 0 then round(daily_return, 9) end as daily_return, round(volume_ratio * case when day(session) % 3 = 0 then 2 else 1 end, 9) as volume_ratio from obs")
def feature_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows written again with all their columns: a value that can't be told any more becomes null."""
    made = tables.stored(spark, "features", "symbol string, session date, daily_return double, volume_ratio double", ("symbol", "session"), "year(session)")
    rows = shared.kept(indicators.observations(bars(spark, d)).select("symbol", "session", "daily_return", "volume_ratio"), "observations")
    made.merge(rows)
    again = rows.where(F.day("session") % 3 == 0).select("symbol", "session", F.lit(None).cast("double").alias("daily_return"), (F.col("volume_ratio") * 2).alias("volume_ratio"))
    made.merge(again)
    return made.read(spark).select("symbol", "session", *[F.round(c, 9).alias(c) for c in ("daily_return", "volume_ratio")])


FOUND = "found as (select symbol, session, feature, case when id % 2 = 0 then 'zscore' else 'isolation_forest' end as method, id, value, explanation from anomalies)"


@query(f"with {ANOMALIES}, {FOUND}, last as (select symbol, session, feature, method, max(id) as id from found group by all) select l.symbol, l.session, l.feature, l.method, l.id, case when l.id % 5 = 0 then null else f.value end as value from last l join found f using (id)")
def anomaly_keys(spark: SparkSession, d: str) -> DataFrame:
    """Findings by symbol, session, feature and method: of several the last one stands, then a fifth loses its value."""
    made = tables.stored(spark, "found", "symbol string, session date, feature string, method string, id long, value double", ("symbol", "session", "feature", "method"), "year(session)")
    rows = anomalies(spark, d).select("symbol", "session", "feature", F.when(F.col("id") % 2 == 0, "zscore").otherwise("isolation_forest").alias("method"), "id", "value")
    made.merge(rows, order="id")
    made.merge(made.read(spark).where("id % 5 = 0").withColumn("value", F.lit(None).cast("double")))
    return made.read(spark)


DAYS = "days as (select n_name as exchange, cast(o_orderdate as date) as day, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"


@query(f"with {DAYS} select exchange, day, n > 1 as is_trading_day, case when day(day) = 1 then null when n > 1 then 'busy' else 'quiet' end as note from days")
def calendar_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An exchange's days, then the first of each month again without its note."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    days = met.groupBy(F.col("n_name").alias("exchange"), F.to_date("o_orderdate").alias("day")).agg((F.count(F.lit(1)) > 1).alias("is_trading_day"))
    made = tables.stored(spark, "calendar", "exchange string, day date, is_trading_day boolean, note string", ("exchange", "day"), "year(day)")
    made.merge(days.withColumn("note", F.when(F.col("is_trading_day"), "busy").otherwise("quiet")))
    made.merge(made.read(spark).where(F.day("day") == 1).withColumn("note", F.lit(None).cast("string")))
    return made.read(spark)


@query(f"with {DAYS} select count(*) filter (where exchange <> 'FRANCE') as first_inserted, 0 as first_matched, count(*) filter (where exchange = 'FRANCE') as inserted, count(*) filter (where exchange <> 'FRANCE' and year(day) = 1996) as matched from days where exchange <> 'FRANCE' or year(day) = 1996")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    """(inserted, matched) of two merges."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    days = shared.kept(met.select(F.col("n_name").alias("exchange"), F.to_date("o_orderdate").alias("day")).distinct(), "days")
    made = tables.stored(spark, "days", "exchange string, day date", ("exchange", "day"), "year(day)")
    first = made.merge(days.where("exchange <> 'FRANCE'"))
    then = made.merge(days.where("year(day) = 1996"))
    return spark.createDataFrame([(*first, *then)], "first_inserted long, first_matched long, inserted long, matched long")


@query("select event_id, event_type as symbol from events where event_id % 3 <> 0")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    seen = shared.finished(quotes.distinct(quotes.source(spark, d, "events.parquet"), ["event_id"]))
    done = table(spark, d, "events").where("event_id % 3 = 0").select("event_id")
    return seen.join(done, "event_id", "left_anti").select("event_id", "symbol")


@query(f"with {BARS}, {RETURNS} select 'bars' as stage, count(*) as n from bars union all select 'returns', count(*) from rets union all select 'extremes', count(*) from (select 1 from rets qualify row_number() over (partition by symbol order by daily_return desc nulls last, session) <= 3)")
def daily_run(spark: SparkSession, d: str) -> DataFrame:
    from .daily import run

    top = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("daily_return"), "session")
    stages = [
        ("bars", lambda t: bars(spark, d)),
        ("returns", lambda t: indicators.returns(t["bars"])),
        ("extremes", lambda t: t["returns"].withColumn("n", F.row_number().over(top)).where("n <= 3")),
        ("broken", lambda t: t["no such table"]),
    ]
    return run(spark, stages)[1].where("outcome = 'succeeded'").select("stage", F.col("rows").alias("n"))
