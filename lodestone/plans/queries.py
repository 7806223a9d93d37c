"""The engine's queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import display, tagging, text
from lodestone.operators import anomaly, evidence, forest, graph, indicators, merge, portfolio, proposals, reads
from lodestone.sources import feeds, shared
from lodestone.streaming import quotes, state

from .domain import bars, edges, flagged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BENCHMARK = "Brand#1"
BARS = """bars as (select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as session,
 arg_min(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
 arg_max(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as close,
 sum(cast(round(l_extendedprice * 100) as bigint) * cast(l_quantity as bigint))::double / sum(l_quantity) / 100 as adjusted_close, cast(sum(l_quantity) as bigint) as volume
 from lineitem join part on l_partkey = p_partkey group by all)"""
RETURNS = """rets as (select symbol, session, (adjusted_close - lag(adjusted_close) over w) / nullif(lag(adjusted_close) over w, 0) as daily_return
 from bars window w as (partition by symbol order by session))"""
NUMBERED = "numbered as (select *, row_number() over (partition by symbol order by session) as n from bars)"
OBSERVED = f"""{BARS}, {RETURNS}, obs as (select b.symbol, b.session, r.daily_return,
 case when row_number() over w >= 20 then b.volume / avg(b.volume) over (partition by b.symbol order by b.session rows 19 preceding) end as volume_ratio,
 case when count(r.daily_return) over (partition by b.symbol order by b.session rows 19 preceding) = 20
 then stddev_samp(r.daily_return) over (partition by b.symbol order by b.session rows 19 preceding) * sqrt(252) end as volatility_20
 from bars b join rets r using (symbol, session) window w as (partition by b.symbol order by b.session))"""
ZED = f"""{OBSERVED}, long as (select symbol, session, 'daily_return' as feature, daily_return as value from obs where daily_return is not null
 union all select symbol, session, 'volume_ratio', volume_ratio from obs where volume_ratio is not null
 union all select symbol, session, 'volatility_20', volatility_20 from obs where volatility_20 is not null),
 med as (select symbol, feature, median(value) as med, count(*) as n from long group by all),
 mads as (select symbol, feature, median(abs(value - med)) as mad from long join med using (symbol, feature) group by all),
 zed as (select symbol, session, feature, value, (value - med) / nullif(1.4826 * mad, 0) as z, n from long join med using (symbol, feature) join mads using (symbol, feature)),
 found as (select symbol, session, feature, round(value, 6) as value, round(abs(z), 6) as score,
 case when value > 0 then 'up' when feature <> 'volume_ratio' and value < 0 then 'down' else 'neutral' end as direction,
 case when abs(z) >= 8 then 'extreme' when abs(z) >= 5 then 'high' when abs(z) >= 3.5 then 'medium' else 'low' end as severity,
 round(case when abs(z) <= 3 then 0 else 1 - exp(-(abs(z) - 3) / 2) end, 6) as confidence
 from zed where n >= 60 and abs(z) >= 3 and (feature <> 'volume_ratio' or z > 0))"""
EDGES = """edges as (select source, target, 'supplies' as kind, round(q / sum(q) over (partition by target), 6) as weight, round(least(1.0, q / sum(q) over (partition by target) * 20), 6) as confidence
 from (select n_name as source, p_brand as target, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all))"""
BOTH = "both_ways as (select source as here, target as there, true as forward, weight, confidence from edges union all select target, source, false, weight, confidence from edges)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"with {BARS} select * from bars")
def bars_weekly(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


@query(f"with {BARS} select * from bars qualify row_number() over (partition by symbol order by session desc) = 1")
def latest_bar(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest(bars(spark, d), "symbol", "session")


@query(f"with {BARS} select * from (select * from bars where session < (select max(session) from bars)) qualify row_number() over (partition by symbol order by session desc) <= 5")
def recent_bars(spark: SparkSession, d: str) -> DataFrame:
    return reads.recent(flagged(bars(spark, d)), "symbol", "session", 5, completed_only=True).drop("is_provisional")


@query(f"with {BARS} select * from bars where session between date '1996-01-01' and date '1996-06-30'")
def bars_range(spark: SparkSession, d: str) -> DataFrame:
    return reads.between(bars(spark, d), "session", "1996-01-01", "1996-06-30")


@query(f"with {BARS} select symbol, min(session) as first_session, max(session) as last_session, count(*) as n from bars group by symbol")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    return reads.bounds(bars(spark, d), "symbol", "session")


@query(f"with {BARS} select symbol, case when count(*) >= 2 then round((arg_max(adjusted_close, session) - arg_min(adjusted_close, session)) / nullif(arg_min(adjusted_close, session), 0), 8) end as period_return from bars group by symbol")
def period_return(spark: SparkSession, d: str) -> DataFrame:
    return reads.period_return(bars(spark, d), "symbol", "session", "adjusted_close")


@query(f"with {BARS} select symbol, session, " + ", ".join(f"round((adjusted_close - lag(adjusted_close, {k}) over w) / nullif(lag(adjusted_close, {k}) over w, 0), 6) as {n}" for n, k in (("daily_return", 1), ("weekly_return", 5), ("monthly_return", 21))) + " from bars window w as (partition by symbol order by session)")
def returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.returns(bars(spark, d)), "daily_return", "weekly_return", "monthly_return")


@query(f"with {BARS} select symbol, session, " + ", ".join(f"case when row_number() over w >= {p} then round(avg({v}) over (partition by symbol order by session rows {p - 1} preceding), 4) end as {n}" for n, v, p in (("sma_20", "adjusted_close", 20), ("sma_50", "adjusted_close", 50), ("sma_200", "adjusted_close", 200), ("volume_sma_20", "volume", 20))) + " from bars window w as (partition by symbol order by session)")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.averages(bars(spark, d)), "sma_20", "sma_50", "sma_200", "volume_sma_20", places=4)


@query(f"with {BARS}, s as (select symbol, session, row_number() over w as n, avg(adjusted_close) over f as m, stddev_pop(adjusted_close) over f as sd from bars window w as (partition by symbol order by session), f as (partition by symbol order by session rows 19 preceding)) select symbol, session, case when n >= 20 then round(m + 2 * sd, 3) end as bollinger_upper, case when n >= 20 then round(m, 3) end as bollinger_middle, case when n >= 20 then round(m - 2 * sd, 3) end as bollinger_lower from s")
def bollinger_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.bollinger(bars(spark, d)), "bollinger_upper", "bollinger_middle", "bollinger_lower", places=3)


@query(f"with {OBSERVED} select symbol, session, round(volatility_20, 6) as volatility_20, round(volume_ratio, 6) as volume_ratio from obs")
def volatility_and_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.observations(bars(spark, d)).drop("daily_return"), "volatility_20", "volume_ratio")


@query(f"with {BARS}, {RETURNS} select a.symbol, a.session, round(a.daily_return - b.daily_return, 6) as relative_strength from rets a left join (select * from rets where symbol = '{BENCHMARK}') b using (session)")
def relative_strength(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.relative_strength(bars(spark, d), BENCHMARK), "relative_strength")


@query(f"with {BARS} select symbol, session, close, previous_close, round((close - previous_close) / nullif(previous_close, 0) * 100, 6) as change_percent from (select *, lag(close) over (partition by symbol order by session) as previous_close from bars) qualify row_number() over (partition by symbol order by session desc) = 1")
def quote_change(spark: SparkSession, d: str) -> DataFrame:
    return indicators.quotes(bars(spark, d))


SMOOTHED = ["ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "rsi_14", "atr_14"]


def ema_sql(name: str, source: str, value: str, period: int) -> str:
    return f"{name}_seed as (select symbol, max(n) as n, avg({value}) as e from {source} where n <= {period} group by symbol having count(*) = {period}), {name} as (select symbol, n, e from {name}_seed union all select b.symbol, b.n, r.e + (b.{value} - r.e) * 2.0 / {period + 1} from {name} r join {source} b on b.symbol = r.symbol and b.n = r.n + 1)"


def wilder_sql(name: str, value: str) -> str:
    return f"{name}_seed as (select symbol, 15 as n, avg({value}) as e from steps where n between 2 and 15 group by symbol having count(*) = 14), {name} as (select symbol, n, e from {name}_seed union all select b.symbol, b.n, (r.e * 13 + b.{value}) / 14 from {name} r join steps b on b.symbol = r.symbol and b.n = r.n + 1)"


RECURSIVE = (
    f"with recursive {BARS}, {NUMBERED}, steps as (select symbol, n, greatest(adjusted_close - lag(adjusted_close) over w, 0) as gain, greatest(lag(adjusted_close) over w - adjusted_close, 0) as loss, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as reach from numbered window w as (partition by symbol order by session)), "
    f"{ema_sql('fast', 'numbered', 'adjusted_close', 12)}, {ema_sql('slow', 'numbered', 'adjusted_close', 26)}, macds as (select symbol, n - 25 as n, f.e - s.e as m from fast f join slow s using (symbol, n)), {ema_sql('signal', 'macds', 'm', 9)}, {wilder_sql('gains', 'gain')}, {wilder_sql('losses', 'loss')}, {wilder_sql('atr', 'reach')}"
)
SMOOTHED_SQL = (
    "select b.symbol, b.session, round(f.e, 3) as ema_12, round(s.e, 3) as ema_26, round(f.e - s.e, 3) as macd, round(g.e, 3) as macd_signal, round(f.e - s.e - g.e, 3) as macd_histogram, round(case when l.e = 0 then case when u.e > 0 then 100.0 else 50.0 end else 100 - 100 / (1 + u.e / l.e) end, 4) as rsi_14, round(a.e, 3) as atr_14 from numbered b left join fast f using (symbol, n) left join slow s using (symbol, n) left join signal g on g.symbol = b.symbol and g.n = b.n - 25 left join gains u on u.symbol = b.symbol and u.n = b.n left join losses l on l.symbol = b.symbol and l.n = b.n left join atr a on a.symbol = b.symbol and a.n = b.n"
)


@query(f"{RECURSIVE} {SMOOTHED_SQL}")
def recursive_indicators(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.smoothed(bars(spark, d))
    return out.select("symbol", "session", *[F.round(c, 4 if c == "rsi_14" else 3).alias(c) for c in SMOOTHED])


UNROUNDED = SMOOTHED_SQL.replace(", 3) as", ", 12) as").replace(", 4) as", ", 12) as")
SHARES = ["daily_return", "weekly_return", "monthly_return", "volume_ratio", "volatility_20", "relative_strength", "rsi_14"]
PRICES = ["sma_20", "sma_50", "sma_200", "bollinger_upper", "bollinger_middle", "bollinger_lower", "volume_sma_20", "ema_12", "ema_26", "macd", "macd_signal", "macd_histogram", "atr_14"]
THIRD = ", ".join(f"round({c}, {4 if c in SHARES else 3}) as {c}" for c in SHARES + PRICES)


@query(f"""{RECURSIVE}, sm as ({UNROUNDED}), w as (select symbol, session, row_number() over w as n,
 (adjusted_close - lag(adjusted_close) over w) / nullif(lag(adjusted_close) over w, 0) as d1, (adjusted_close - lag(adjusted_close, 5) over w) / nullif(lag(adjusted_close, 5) over w, 0) as d5,
 (adjusted_close - lag(adjusted_close, 21) over w) / nullif(lag(adjusted_close, 21) over w, 0) as d21, avg(adjusted_close) over m20 as a20, stddev_pop(adjusted_close) over m20 as s20,
 avg(adjusted_close) over (partition by symbol order by session rows 49 preceding) as a50, avg(adjusted_close) over (partition by symbol order by session rows 199 preceding) as a200, avg(volume) over m20 as v20, volume
 from bars window w as (partition by symbol order by session), m20 as (partition by symbol order by session rows 19 preceding)),
 v as (select symbol, session, case when count(d1) over m = 20 then stddev_samp(d1) over m * sqrt(252) end as vol from w window m as (partition by symbol order by session rows 19 preceding)),
 b as (select session, d1 as bd from w where symbol = '{BENCHMARK}'),
 raw as (select w.symbol, w.session, round(d1, 12) as daily_return, round(d5, 12) as weekly_return, round(d21, 12) as monthly_return, case when n >= 20 then round(a20, 12) end as sma_20, case when n >= 50 then round(a50, 12) end as sma_50,
 case when n >= 200 then round(a200, 12) end as sma_200, case when n >= 20 then round(a20 + 2 * s20, 12) end as bollinger_upper, case when n >= 20 then round(a20, 12) end as bollinger_middle, case when n >= 20 then round(a20 - 2 * s20, 12) end as bollinger_lower,
 case when n >= 20 then round(v20, 12) end as volume_sma_20, case when n >= 20 then round(volume / v20, 12) end as volume_ratio, round(vol, 12) as volatility_20, round(d1 - bd, 12) as relative_strength,
 ema_12, ema_26, macd, macd_signal, macd_histogram, rsi_14, atr_14 from w join v using (symbol, session) join sm using (symbol, session) left join b using (session))
 select symbol, session, {THIRD} from raw""")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.unrounded(bars(spark, d), BENCHMARK)
    return out.select("symbol", "session", *[F.round(F.col(c), 4 if c in SHARES else 3).alias(c) for c in SHARES + PRICES])


@query("with s as (select n_name as exchange, cast(o_orderdate as date) as session from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all), span as (select exchange, unnest(generate_series(min(session)::timestamp, max(session)::timestamp, interval 1 day))::date as day from s group by exchange) select span.exchange, span.day, s.session is not null as is_trading_day, case when s.session is not null then null when isodow(span.day) >= 6 then 'weekend' else 'no session observed on ' || span.exchange || '; probable holiday' end as note from span left join s on s.exchange = span.exchange and s.session = span.day")
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return reads.calendar(met.select(F.col("n_name").alias("exchange"), F.to_date("o_orderdate").alias("session")).distinct())


@query(f"with {BARS}, {RETURNS}, m as (select symbol, median(daily_return) as med from rets group by symbol), mads as (select symbol, median(abs(daily_return - med)) as mad from rets join m using (symbol) group by symbol) select symbol, session, round((daily_return - med) / nullif(1.4826 * mad, 0), 6) as z from rets join m using (symbol) join mads using (symbol)")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    r = indicators.returns(bars(spark, d)).select("symbol", "session", "daily_return")
    return rounded(anomaly.robust_z(r, "daily_return", "symbol").select("symbol", "session", "z"), "z")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return indicators.observations(bars(spark, d))


@query(f"with {ZED} select * from found")
def zscore_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.detect(observations(spark, d))


@query(f"with {ZED} select feature, severity, direction, count(*) as n from found group by all")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.detect(observations(spark, d)).groupBy("feature", "severity", "direction").agg(F.count(F.lit(1)).alias("n"))


def forest_sql(trees: int = 200, features: int = 4, share: float = 0.02, least: int = 60) -> str:
    """lone (symbol, session, decision, severity, confidence) of a table whole (symbol, session, f0, f1 ...): forests grown level by level."""
    ks = range(features)
    many = lambda form: ", ".join(form.format(k=k) for k in ks)
    deep = 8
    out = [
        f"sized as (select symbol, count(*) as n, least({forest.POOL}, count(*)) as pool, least({forest.SAMPLE}, count(*)) as size, ceil(log2(greatest(2, least({forest.SAMPLE}, count(*)))))::int as lim from whole group by symbol having count(*) >= {least})",
        f"pool as (select w.* from whole w join sized using (symbol) qualify row_number() over (partition by symbol order by md5(symbol || '|' || session)) <= {forest.POOL})",
        f"fit0 as materialized (select symbol, tree, 1::bigint as node, {many('f{k}')} from pool, range({trees}) t(tree) qualify row_number() over (partition by symbol, tree order by md5(symbol || '|' || tree || '|' || session)) <= {forest.SAMPLE})",
        f"row0 as materialized (select symbol, session, tree, 1::bigint as node, {many('f{k}')} from whole join sized using (symbol), range({trees}) t(tree))",
    ]
    x, lows, highs = (f"[{many(c + '{k}')}]" for c in ("f", "l", "h"))
    for k in range(deep + 1):
        ranks = ", ".join(f"case when h{j} > l{j} then ('0x' || substr(h, {9 + 6 * j}, 6))::bigint else -1 end" for j in ks)
        out += [
            f"sum{k} as (select symbol, tree, node, count(*) as c, {many('min(f{k}) as l{k}, max(f{k}) as h{k}')} from fit{k} group by symbol, tree, node)",
            f"rank{k} as (select *, md5(symbol || '|' || tree || '|' || node) as h, [{ranks}] as ranks from sum{k})",
            f"node{k} as materialized (select r.symbol, tree, node, c, case when c <= 1 or lim <= {k} or list_max(ranks) < 0 then 0 else list_position(ranks, list_max(ranks)) end as axis, {lows}[axis] + ('0x' || left(h, 8))::bigint / 4294967296.0::double * ({highs}[axis] - {lows}[axis]) as cut from rank{k} r join sized using (symbol))",
            f"end{k} as (select symbol, session, {k} + case when c > 2 then 2 * (ln(c - 1) + 0.5772156649::double) - 2 * (c - 1) / c::double when c = 2 then 1 else 0 end as path from row{k} join node{k} using (symbol, tree, node) where axis = 0)",
        ]
        if k < deep:
            out += [f"{t}{k + 1} as materialized (select symbol, {extra} tree, node * 2 + case when {x}[axis] >= cut then 1 else 0 end as node, {many('f{k}')} from {t}{k} join node{k} using (symbol, tree, node) where axis > 0)" for t, extra in (("fit", ""), ("row", "session,"))]
    ends = " union all ".join(f"select * from end{k}" for k in range(deep + 1))
    out += [
        f"mean as (select symbol, session, sum(path) / {trees} as path from ({ends}) group by symbol, session)",
        "scores as (select symbol, session, round(pow(2.0::double, -path / (2 * (ln(size - 1) + 0.5772156649::double) - 2 * (size - 1) / size::double)), 9) as score from mean join sized using (symbol))",
        f"far as (select *, round(quantile_cont(score, {1 - share}) over (partition by symbol) - score, 9) as decision from scores)",
        "lone as (select symbol, session, decision, case when 40 * abs(decision) >= 8 then 'extreme' when 40 * abs(decision) >= 5 then 'high' when 40 * abs(decision) >= 3.5 then 'medium' else 'low' end as severity, case when 40 * abs(decision) <= 3 then 0.0::double else 1 - exp(-(40 * abs(decision) - 3) / 2) end as confidence from far where decision < 0)",
    ]
    return ", ".join(out)


@query(f"""with {OBSERVED}, whole as (select o.symbol, o.session, o.daily_return as f0, volume_ratio as f1, volatility_20 as f2, o.daily_return - b.daily_return as f3 from obs o join rets b on b.symbol = '{BENCHMARK}' and b.session = o.session
 where o.daily_return is not null and volume_ratio is not null and volatility_20 is not null and b.daily_return is not null), {forest_sql()} select symbol, session, decision, severity, round(confidence, 6) as confidence from lone""")
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    both = observations(spark, d).join(indicators.relative_strength(bars(spark, d), BENCHMARK), ["symbol", "session"])
    found = anomaly.isolation_forest(both, ["daily_return", "volume_ratio", "volatility_20", "relative_strength"])
    return rounded(found, "confidence")


@query("select page_id, sha256(lower(trim(url))) as url_hash from pages qualify row_number() over (partition by sha256(lower(trim(url))) order by page_id) = 1")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("url_hash"))
    return p.groupBy("url_hash").agg(F.min("page_id").alias("page_id")).select("page_id", "url_hash")


@query("select doc_id, cast(len([s for s in string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01') if s <> '']) as int) as sentences, cast(len(regexp_extract_all(lower(text), '[a-z'']+')) as int) as words, cast((length(text) - length(replace(text, ' the ', ''))) / 5 as int) as the from documents")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(t)).alias("sentences"), F.size(text.tokens(t)).alias("words"), text.phrase_count(t, " the ").alias("the"))


@query(f"with {EDGES}, {BOTH} select * from both_ways where here = 'Brand#1' and confidence >= 0.5")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(edges(spark, d), "Brand#1", 0.5).drop("kind")


@query(f"with recursive {EDGES}, {BOTH}, r as (select 'Brand#1' as node, 0 as depth union select there, depth + 1 from r join both_ways on here = node and confidence >= 0.9 where depth < 3) select node, min(depth) as depth from r group by node")
def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(edges(spark, d), "Brand#1", 3, 0.9)


@query(f"with recursive {EDGES}, {BOTH}, r as (select 'Brand#1' as node, 0 as depth union select there, depth + 1 from r join both_ways on here = node and confidence >= 0.9 where depth < 2) select * from edges where confidence >= 0.9 and source in (select node from r) and target in (select node from r)")
def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(edges(spark, d), "Brand#1", 2, 0.9)


@query(f"with {EDGES} select kind, count(*) as edges, count(distinct source) as sources, count(distinct target) as targets from edges group by kind")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(edges(spark, d))


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then -1.0 else c_acctbal end as c_acctbal from customer union all select c_custkey + 10000000, c_name, -1.0 from customer where c_custkey % 7 = 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    fix = old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0))
    more = old.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", F.lit(-1.0).alias("c_acctbal"))
    return merge.upsert(old, fix.unionByName(more), ["c_custkey"])


@query("select s_suppkey, s_name, case when s_nationkey < 12 then 'a' else 'b' end as source, not (s_nationkey < 12 and s_suppkey % 2 = 1) as is_active from supplier")
def deactivate_missing(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") < 12, "a").otherwise("b").alias("source"), F.lit(True).alias("is_active"))
    return merge.deactivate_missing(old, old.where("s_suppkey % 2 = 0"), "s_suppkey", "a")


@query("select o_custkey as key, min(o_orderdate) as first, max(o_orderdate) as last from orders group by o_custkey")
def widen_watermarks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("first"), F.col("o_orderdate").alias("last"), "o_orderkey")
    old = o.where("o_orderkey % 2 = 0").groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merge.widen(old, o.where("o_orderkey % 2 = 1"), "key")


@query("select page_id, url from pages where page_id % 2 = 0 union all select min(page_id), split_part(url, '/', 3) from pages where page_id % 2 = 1 and split_part(url, '/', 3) not in (select url from pages where page_id % 2 = 0) group by 2")
def insert_only(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    new = p.where("page_id % 2 = 1").withColumn("url", F.split_part("url", F.lit("/"), F.lit(3)))
    return merge.insert_only(p.where("page_id % 2 = 0"), new, ["url"])


@query("select s_name as symbol, n_name as name from supplier join nation on s_nationkey = n_nationkey where contains(upper(s_name), '00001') or contains(upper(n_name), '00001') order by (upper(s_name) <> '00001')::int, (not starts_with(upper(s_name), '00001'))::int, length(s_name), s_name, n_name limit 10")
def listing_search(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return reads.listing_search(s.select(F.col("s_name").alias("symbol"), F.col("n_name").alias("name")), "00001", 10)


@query("select p_brand, cast(count(*) filter (where list_has_any(tags, ['SMALL', 'TIN'])) as bigint) as any_tag, cast(count(*) filter (where list_has_all(tags, ['SMALL', 'TIN'])) as bigint) as all_tags from (select p_brand, string_split(p_type, ' ') as tags from part) group by p_brand")
def tag_matches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.split("p_type", " ").alias("tags"))
    one, both = (reads.with_tags(p, "tags", ["SMALL", "TIN"], every).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")) for every in (False, True))
    return p.select("p_brand").distinct().join(one.withColumnRenamed("n", "any_tag"), "p_brand", "left").join(both.withColumnRenamed("n", "all_tags"), "p_brand", "left").select("p_brand", F.coalesce("any_tag", F.lit(0)).alias("any_tag"), F.coalesce("all_tags", F.lit(0)).alias("all_tags"))


POSITIONS = f"{BARS}, pos as (select o_custkey as user, p_brand as symbol, sum(l_quantity) as quantity, sum(cast(round(l_extendedprice * 100) as bigint))::double / sum(l_quantity) / 100 as average_cost from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by all), closes as (select symbol, arg_max(close, session) as close from bars where session < (select max(session) from bars) and symbol <> 'Brand#2' group by symbol), valued as (select user, symbol, round(quantity * average_cost, 4) as cost, round(quantity * close, 4) as market_value, round(quantity * close - quantity * average_cost, 4) as gain, round((quantity * close - quantity * average_cost) / nullif(quantity * average_cost, 0) * 100, 4) as gain_percent from pos left join closes using (symbol))"


def valued(spark: SparkSession, d: str) -> DataFrame:
    o, i, p = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"), table(spark, d, "part").select("p_partkey", "p_brand")
    met = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    pos = met.groupBy(F.col("o_custkey").alias("user"), F.col("p_brand").alias("symbol")).agg(F.sum("l_quantity").alias("quantity"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum("l_quantity") / 100).alias("average_cost"))
    closes = reads.latest(flagged(bars(spark, d)).where(~F.col("is_provisional") & (F.col("symbol") != "Brand#2")), "symbol", "session")
    return portfolio.value(pos, closes)


@query(f"with {POSITIONS} select * from valued")
def position_values(spark: SparkSession, d: str) -> DataFrame:
    return valued(spark, d)


@query(f"with {POSITIONS} select user, round(sum(cost), 2) as cost, case when count(market_value) = count(*) then round(sum(market_value), 2) end as market_value, count(*) as positions from valued group by user")
def portfolio_totals(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.totals(valued(spark, d))


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def conversation_replay(spark: SparkSession, d: str) -> DataFrame:
    return reads.recent(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", 2)


@query("select o_orderkey, o_totalprice from orders order by o_orderkey, o_totalprice limit 25 offset 50")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], 50, 25)


@query("select le, (select count(*) from orders where o_totalprice <= le) as n from (select unnest([1000.0, 50000.0, 100000.0, 250000.0, 500000.0])::double as le)")
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reads.histogram(table(spark, d, "orders"), "o_totalprice", [1e3, 5e4, 1e5, 2.5e5, 5e5])


RATES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("with c as (select o_custkey, " + ", ".join(f"count(*) filter (where o_orderpriority = '{r}') as r{i}" for i, r in enumerate(RATES, 1)) + " from orders group by o_custkey), m as (select *, (r1 + 2 * r2 + 3 * r3 + 4 * r4 + 5 * r5) / nullif(r1 + r2 + r3 + r4 + r5, 0) as m from c) select o_custkey, r1, r2, r3, r4, r5, round(m, 6) as mean, case when m <= 1.5 then 'strong_buy' when m <= 2.5 then 'buy' when m <= 3.5 then 'hold' when m <= 4.5 then 'sell' when m is not null then 'strong_sell' end as label from m")
def rating_consensus(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderpriority") == r).alias(f"r{i}") for i, r in enumerate(RATES, 1)])
    return reads.consensus(c, ["r1", "r2", "r3", "r4", "r5"])


@query(f"with {BARS}, x as (select *, case when session = (select max(session) from bars) then -1 else volume end as v from bars) select symbol, count(*) filter (where v >= 0 and least(open, high, low, close) >= 0 and high >= low) as good, count(*) filter (where not (v >= 0 and least(open, high, low, close) >= 0 and high >= low)) as bad from x group by symbol")
def bar_validation(spark: SparkSession, d: str) -> DataFrame:
    b = flagged(bars(spark, d)).withColumn("volume", F.when(F.col("is_provisional"), -1).otherwise(F.col("volume")))
    good, bad = feeds.valid_bars(b)
    return good.select("symbol", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select("symbol", F.lit(0).alias("g"), F.lit(1).alias("b"))).groupBy("symbol").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


def ticking(spark: SparkSession, d: str) -> DataFrame:
    """The events as ticks in three batches by time, then one of a nameless symbol long after: the watermark passes all windows,
    which are written once, when they close, and leave the state."""
    ticks = table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    third = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    end = ticks.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("symbol"), (F.col("ts") + F.expr("interval 10 days")).alias("ts"), F.lit(0.0).alias("price"))
    return state.arriving(spark, [*[ticks.where(third == k) for k in range(3)], end.unionByName(end)])


@query("select event_type as symbol, date_trunc('day', ts)::timestamptz as start, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*) as n from events group by all")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return shared.finished(quotes.bars(ticking(spark, d), "1 day")).where("symbol <> ''")


@query("with e as (select *, unnest([0, 1]) as k from events), w as (select event_type as symbol, date_trunc('hour', ts) - k * interval 1 hour as start, ts, event_id, value from e) select symbol, start::timestamptz as start, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*) as n from w group by all")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return shared.finished(quotes.bars(ticking(spark, d), "2 hours", "1 hour")).where("symbol <> ''")


@query('with g as (select event_type as symbol, ts, case when ts - lag(ts) over w >= interval 10 minute or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by event_type order by ts, event_id)), s as (select symbol, ts, sum(fresh) over (partition by symbol order by ts rows unbounded preceding) as k from g) select symbol, min(ts)::timestamptz as start, (max(ts) + interval 10 minute)::timestamptz as "end", count(*) as n from s group by symbol, k')
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return shared.finished(quotes.sessions(ticking(spark, d), "10 minutes")).where("symbol <> ''")


@query("select distinct event_id from events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    return shared.finished(quotes.distinct(quotes.source(spark, d, "events.parquet"), ["event_id"])).select("event_id")


@query("with b as (select o_custkey % 50 as question, o_orderkey as source, 'Order ' || o_orderkey as title, o_orderdate as published_at, o_orderpriority as text, (o_orderkey % 40) / 1000.0 as score, case when o_orderkey % 3 = 0 then 'keyword+vector' else 'vector' end as matched_by, case when o_orderkey % 5 <> 0 then (o_orderkey % 100) / 100.0 end as similarity from orders), e as (select * from b where score >= 0.015), ok as (select question from e group by question having max(similarity) >= 0.97) select question, count(*) as pieces, round(least(0.95, 0.4 * least(count(*) / 6, 1.0) + 0.35 * least(max(score) / 0.03, 1.0) + 0.25 * (count(*) filter (where contains(matched_by, '+'))) / count(*)), 3) as confidence from e join ok using (question) group by question")
def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.confidence(evidence.supported(pieces(spark, d), 0.97))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).alias("question"), k.alias("source"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("text"), ((k % 40) / 1000).alias("score"), F.when(k % 3 == 0, "keyword+vector").otherwise("vector").alias("matched_by"), F.when(k % 5 != 0, (k % 100) / 100).alias("similarity"))


@query("with b as (select o_custkey % 50 as question, *, row_number() over (partition by o_custkey % 50 order by o_orderkey % 40 desc, o_orderkey) as i from orders) select question, string_agg('[' || i || '] Order ' || o_orderkey || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' || chr(10) || o_orderpriority, chr(10) || chr(10) order by i) as context from b where i <= 8 group by question")
def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    return evidence.context(pieces(spark, d))


@query("select conv_id, turn, case when regexp_matches(text, '(?i)\\b(it|its|that|this|they|them|those|the company|the stock|same)\\b') and before is not null then before || ' ' || text else text end as resolved from (select *, lag(text) over (partition by conv_id order by turn, text) as before from conversations where role = 'user')")
def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    return evidence.resolved(table(spark, d, "conversations"))


@query("with q as (select vec_id, embedding::double[] as q from embeddings where vec_id < 6), t as (select q.vec_id, max(list_cosine_similarity(e.embedding::double[], q.q)) as m from embeddings e, q where e.vec_id >= 6 group by q.vec_id), m as (select min(m) filter (where vec_id < 3) as a, max(m) filter (where vec_id >= 3) as b from t) select round(a, 6) as lowest_on, round(b, 6) as highest_off, case when a > b then round((a + b) / 2, 3) end as floor from m")
def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    six = [list(r["embedding"]) for r in e.where("vec_id < 6").orderBy("vec_id").collect()]  # the stated questions
    return evidence.relevance_floor(e.where("vec_id >= 6"), "embedding", six[:3], six[3:])


TAGS = {"companies": {"zeta": ["stupid", "trash"], "acme": ["clown"]}, "segments": {"north": ["moron", "idiot"], "south": ["garbage"]}, "symbols": {"acme": ["ACM"], "zeta": ["ZTA", "ZTB"]}}


@query(r"""with t as (select doc_id, lower(coalesce(text, '')) as t from documents), h as (select doc_id, regexp_matches(t, '\b(clown)\b') as a, regexp_matches(t, '\b(stupid|trash)\b') as z, regexp_matches(t, '\b(moron|idiot)\b') as n, regexp_matches(t, '\b(garbage)\b') as s, regexp_extract_all(t, '\b(stupid|trash|clown|moron|idiot|garbage)\b') as k from t)
 select doc_id, concat_ws(',', case when a then 'acme' end, case when z then 'zeta' end) as companies, concat_ws(',', case when n then 'north' end, case when s then 'south' end) as tags, cast(len(list_distinct(k)) as int) as keywords, concat_ws(',', case when a then 'ACM' end, case when z then 'ZTA,ZTB' end) as tickers, a or z or n or s as relevant from h""")
def article_tags(spark: SparkSession, d: str) -> DataFrame:
    t = tagging.tag(table(spark, d, "documents").select("doc_id", "text"), "text", **TAGS)
    return t.select("doc_id", F.array_join("companies", ",").alias("companies"), F.array_join("tags", ",").alias("tags"), F.size("keywords").alias("keywords"), F.array_join("tagged_tickers", ",").alias("tickers"), "relevant")


ASSERTED = "case when doc_id % 3 = 0 then ['ZTB', 'OWN'] when doc_id % 3 = 1 then null else []::varchar[] end"


@query(rf"""with t as (select page_id, url, {ASSERTED.replace("doc_id", "page_id")} as own, lower(coalesce(html, '')) as t from pages),
 h as (select *, regexp_matches(t, '\b(clown)\b') as a, regexp_matches(t, '\b(stupid|trash)\b') as z, regexp_matches(t, '\b(moron|idiot|garbage)\b') as n from t),
 x as (select page_id, lower(sha256(lower(trim(url)))) as url_hash, list_concat(coalesce(own, []), case when a then ['ACM'] else [] end, case when z then ['ZTA', 'ZTB'] else [] end) as all_of, a or z or n or len(coalesce(own, [])) > 0 as stays from h)
 select page_id, url_hash, array_to_string(list_transform(list_filter(list_zip(all_of, range(len(all_of))), lambda p: list_position(all_of, p[1]) = p[2] + 1), lambda p: p[1]), ',') as tickers from x where stays""")
def article_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Tagged pages with the tickers that their source asserts first, then those of the text."""
    k = F.col("page_id")
    own = F.when(k % 3 == 0, F.array(F.lit("ZTB"), F.lit("OWN"))).when(k % 3 == 2, F.array().cast("array<string>"))
    pages = table(spark, d, "pages").select("page_id", "url", F.col("html").alias("text"), own.alias("asserted"))
    out = tagging.normalise(tagging.tag(pages, "text", **TAGS))
    return out.select("page_id", "url_hash", F.array_join("tickers", ",").alias("tickers"))


SUPPLIED = """e as (select c_custkey as doc_id, lower(c_name) as c, lower(n_name) as n, lower(r_name) as r, lower(c_name) || ' supplies parts to ' || lower(n_name) || ' and to ' || lower(r_name) || ' each year' as text from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(f"""with {SUPPLIED}, newest as (select * from e qualify row_number() over (order by doc_id desc) <= 500), ask as (select * from newest where doc_id % 13 <> 0),
 made as (select doc_id, unnest([{{'s': c, 't': n}}, {{'s': c, 't': r}}, {{'s': n, 't': r}}], recursive := true) from ask where doc_id % 5 <> 0 and doc_id % 7 <> 0),
 found as (select s as source_slug, t as target_slug, 'supplies' as relation, min(doc_id) as doc_id, {proposals.KINDS["supplies"][0]} as confidence, 'pending' as status from made group by s, t),
 stored as (select c as source_slug, n as target_slug, 'supplies' as relation, -1 as doc_id, 0.5 as confidence, 'refused' as status from e where doc_id % 11 = 0)
 select * from stored union all select * from found where (source_slug, target_slug) not in (select (source_slug, target_slug) from stored)""")
def extraction_pass(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of the newest 500 documents, held against their texts; those that were reviewed stay as they are."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    met = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    text_of = F.concat("c", F.lit(" supplies parts to "), "n", F.lit(" and to "), "r", F.lit(" each year"))
    docs = met.select(F.col("c_custkey").alias("doc_id"), F.lower("c_name").alias("c"), F.lower("n_name").alias("n"), F.lower("r_name").alias("r")).withColumn("text", text_of)
    docs = shared.kept(docs, "documents")
    k = F.col("doc_id")
    pair = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("target"))
    relation, quote = F.when(k % 7 == 0, "uses").otherwise("supplies"), F.when(k % 5 == 0, "too short").otherwise(F.col("text"))
    asked = docs.select("doc_id", F.explode(F.array(pair("c", "n"), pair("c", "r"), pair("n", "r"))).alias("p"), relation.alias("relation"), quote.alias("quote")).select("doc_id", "p.*", "relation", "quote")
    each = docs.select("doc_id", F.explode(F.array("c", "n", "r")).alias("entity"))
    named = each.where((k % 13 != 0) | (F.col("entity") == "never"))
    stored = docs.where(k % 11 == 0).select(F.col("c").alias("source_slug"), F.col("n").alias("target_slug"), F.lit("supplies").alias("relation"), F.lit(-1).cast("long").alias("doc_id"), F.lit(0.5).alias("confidence"), F.lit("refused").alias("status"))
    names = each.select(F.col("entity").alias("name"), F.col("entity").alias("slug")).distinct()
    return proposals.extract(docs.select("doc_id", "text"), asked, names, named, stored, 500)


@query("""with p as (select doc_id, text, split_part(text, ' ', 1) as source, split_part(text, ' ', 2) as target, case doc_id % 4 when 0 then 'supplies' when 1 then 'uses' when 2 then 'acquired' else 'owns' end as relation, case when doc_id % 5 = 0 then 'a sentence that the text has not' else substr(text, 1, 60) end as quote from documents),
 n as (select distinct lower(split_part(text, ' ', 1)) as name from documents where text is not null), c as (select *, coalesce(lower(trim(quote)), '') as q, coalesce(lower(trim(source)), '') as s, coalesce(lower(trim(target)), '') as t from p)
 select case when s not in (select name from n) or t not in (select name from n) then 'unknown_entity' when s = t then 'self_relationship' when relation = 'owns' then 'unknown_relation' when relation = 'uses' then 'relation_not_extractable' when length(q) < 25 or not coalesce(contains(lower(text), q), false) then 'quote_not_in_source' when not (contains(q, s) and contains(q, t)) then 'quote_missing_an_entity'
 when not (case when relation = 'supplies' then regexp_matches(q, 'suppl|provide|ship|deliver|sell') else regexp_matches(q, 'acqui|buyout|takeover|purchase of|merg') end) then 'quote_lacks_relational_cue' else 'accepted' end as reason, count(*) as n from c group by reason""")
def proposal_causes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    names = docs.select(F.lower(word(1)).alias("name")).where("name is not null").distinct().select("name", F.col("name").alias("slug"))
    k = F.col("doc_id")
    made = docs.select("doc_id", word(1).alias("source"), word(2).alias("target"), F.when(k % 4 == 0, "supplies").when(k % 4 == 1, "uses").when(k % 4 == 2, "acquired").otherwise("owns").alias("relation"), F.when(k % 5 == 0, "a sentence that the text has not").otherwise(F.substring("text", 1, 60)).alias("quote"))
    return proposals.causes(proposals.validate(made, docs, names))


@query(f"with {EDGES}, {BOTH} select here, there, forward, here || ' → ' || case when forward then 'supplies' else 'is supplied by' end || ' → ' || there as phrase from both_ways")
def graph_phrases(spark: SparkSession, d: str) -> DataFrame:
    return graph.phrases(graph.both_ways(edges(spark, d))).select("here", "there", "forward", "phrase")


@query(f"with {BARS} select symbol, date_trunc('month', session)::timestamptz as start, arg_min(open, session) as open, max(high) as high, min(low) as low, arg_max(close, session) as close, cast(sum(volume) as bigint) as volume from bars where session > date '1998-06-30' - 7305 and session <= date '1998-06-30' group by all")
def chart_all(spark: SparkSession, d: str) -> DataFrame:
    return reads.candles(bars(spark, d), "MAX", "1998-06-30").withColumn("start", F.col("start").cast("timestamp"))


#: The rows of ``feature_rows`` over what an update reads: completed bars, the last 300 of symbols with 5 or more.
UPDATES = ORACLE_SQL["feature_rows"].replace(BARS, BARS.replace("bars as (", "every_bar as (", 1) + """, bars as (select * from every_bar where session < (select max(session) from every_bar)
 qualify row_number() over (partition by symbol order by session desc) <= 300 and count(*) over (partition by symbol) >= 5)""", 1)
#: Features are decimals of six places, so what is compared is rounded from these.
UPDATES = UPDATES.replace(THIRD, ", ".join(f"round({c}::decimal(38, 6), {4 if c in SHARES else 3})::double as {c}" for c in SHARES + PRICES))


@query(f"select * from ({UPDATES}) qualify row_number() over (partition by symbol order by session desc) <= 40")
def feature_updates(spark: SparkSession, d: str) -> DataFrame:
    """All twenty columns of the rows that an update writes."""
    out = indicators.updates(flagged(bars(spark, d)), BENCHMARK)
    return out.select("symbol", "session", *[F.round(c, 4 if c in SHARES else 3).cast("double").alias(c) for c in SHARES + PRICES])


FACTS = """select c_custkey, array_to_string([ '[' || i || '] ' || x for x, i in list_filter([ 'Name: ' || c_name, case when c_acctbal >= 0 then 'Balance: ' || case when c_acctbal * 1e6 >= 1e9 then format('{:,.2f} billion USD', c_acctbal * 1e6 / 1e9) when c_acctbal * 1e6 >= 1e6 then format('{:,.2f} million USD', c_acctbal * 1e6 / 1e6) else format('{:,.2f} USD', c_acctbal * 1e6) end end, 'Segment: ' || nullif(c_mktsegment, ''), 'Nation: ' || format('{:,}', c_nationkey)], lambda x: x is not null)], chr(10)) as lines from customer"""


@query(FACTS)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    worth = F.when(F.col("c_acctbal") >= 0, display.money(display.absolute("c_acctbal")))
    facts = [("Name", F.col("c_name")), ("Balance", worth), ("Segment", display.shown(c, "c_mktsegment")), ("Nation", display.shown(c, "c_nationkey"))]
    return c.select("c_custkey", display.fact_lines(c, facts).alias("lines"))


@query("with l as (select distinct o_custkey as user, o_orderpriority as name, min(o_orderdate) over (partition by o_custkey, o_orderpriority) as created_at from orders) select user, name, created_at, row_number() over (partition by user order by created_at, name) = 1 as is_default from l")
def watchlists(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("created_at"))
    return portfolio.with_default(lists)


@query("select s_nationkey as capability, arg_min(s_name, s_suppkey) as provider from supplier group by s_nationkey")
def provider_registry(spark: SparkSession, d: str) -> DataFrame:
    return feeds.resolve(table(spark, d, "supplier").select(F.col("s_nationkey").alias("capability"), F.col("s_name").alias("provider"), F.col("s_suppkey").alias("priority")))
