"""Queries over relations of all kinds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph

from .domain import KINDS, relations
from .queries import EDGES, query

RELATIONS = f"""{EDGES}, rel as (select source, target, {KINDS}[(i + j) % 13 + 1] as kind, ((i * 3 + j * 5) % 10 + 1) / 10 as weight,
 ((i + j * 2) % 6 + 5) / 10 as confidence, case when (i + j) % 3 = 0 then date '1995-01-01' + (i * 20)::int end as valid_from,
 case when (i + j) % 4 = 0 then date '1996-06-01' + (j * 10)::int end as valid_to
 from (select source, target, cast(substr(target, 7, 3) as int) as i, n_nationkey as j from edges join nation on n_name = source) where (i * 7 + j * 3) % 5 = 0)"""
BOTH = "both_ways as (select source as here, target as there, true as forward, * exclude (source, target) from rel union all select target, source, false, * exclude (source, target) from rel)"
CHAIN = "('supplies', 'manufactures', 'customer_of', 'depends_on', 'produces')"


def verb_sql() -> str:
    return "case " + " ".join(f"when kind = '{k}' then case when forward then '{a}' else '{b}' end" for k, (a, b) in graph.VERBS.items()) + " end"


def impact_sql(origin: str, shock: float, hops: int, least: float) -> str:
    share = "case " + " ".join(f"when kind = '{k}' then {t}" for k, (t, _) in graph.TRANSMISSION.items()) + " end"
    way = "case " + " ".join(f"when kind = '{k}' then {w}" for k, (_, w) in graph.TRANSMISSION.items()) + " end"
    step = f"""step as (select here, there, weight, confidence as c, {share} as t, ({way}) * case when forward then 1 else -1 end as w, {verb_sql()} as verb
      from both_ways where confidence >= {least} and (forward or kind in {CHAIN} or kind in ('partners_with', 'competes_with')))"""
    levels = [f"h0 as (select '{origin}' as node, {shock}::double as score, 1.0::double as confidence, 0 as way, '{origin}' as path, true as goes)"]
    for d in range(1, hops + 1):
        before = " union all ".join(f"select node from h{k} where goes" for k in range(d - 1)) or "select null where false"
        levels.append(f"""h{d} as (select there as node, score * t * weight as score, least(confidence, c) as confidence, case when w = 0 then way else w end as way,
          path || ' → ' || verb || ' ' || there as path, t > 0 as goes from h{d - 1} join step on here = node
          where goes and node not in ({before}) and there <> '{origin}' and (w = 0 or way = 0 or w = way) and abs(score * t * weight) >= {graph.FLOOR})""")
    found = " union all ".join(f"select * from h{d}" for d in range(1, hops + 1))
    return f"""with {RELATIONS}, {BOTH}, {step}, {", ".join(levels)}, found as ({found}),
      best as (select node, string_agg(path, '; ' order by n) as paths from (select node, path, row_number() over (partition by node order by -abs(score), path) as n from found) where n <= 3 group by node),
      impact as (select node, round(sum(score), 4) as score, round(max(confidence), 3) as confidence, any_value(paths) as paths from found join best using (node) group by node),
      told as (select *, case when score > 0 then 'benefits' when score < 0 then 'at_risk' else 'neutral' end as direction from impact)"""


@query(f"{impact_sql('Brand#1', 1.0, 3, 0.5)} select * from told")
def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.propagate(relations(spark, d), "Brand#1", 1.0, 3)


@query(f"{impact_sql('Brand#7', -1.0, 2, 0.6)} select *, row_number() over (partition by direction order by abs(score) desc, node) as rank from told where direction <> 'neutral' qualify rank <= 5")
def graph_winners_losers(spark: SparkSession, d: str) -> DataFrame:
    return graph.winners_and_losers(graph.propagate(relations(spark, d), "Brand#7", -1.0, 2, 0.6), 5)


@query(f"with {RELATIONS} select * from rel where valid_to is null or valid_to >= date '1996-09-01'")
def edges_current(spark: SparkSession, d: str) -> DataFrame:
    return graph.current(relations(spark, d), "1996-09-01")


@query(f"with {RELATIONS} select * from rel where (valid_to is null or valid_to >= date '1995-07-01') and (valid_from is null or valid_from <= date '1995-07-01')")
def edges_as_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.as_of(relations(spark, d), "1995-07-01")


@query(f"with {RELATIONS}, {BOTH} select * from both_ways where here = 'Brand#3' and kind in {CHAIN} and (valid_to is null or valid_to >= date '1995-07-01') and (valid_from is null or valid_from <= date '1995-07-01')")
def supply_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(graph.as_of(relations(spark, d), "1995-07-01"), "Brand#3", kinds=graph.SUPPLY_CHAIN)


WALK = f"""with recursive {RELATIONS}, live as (select * from rel where confidence >= 0.7 and (valid_to is null or valid_to >= date '1996-09-01')),
 two as (select source as here, target as there from live union all select target, source from live),
 r as (select 'Brand#3' as node, 0 as depth union select there, depth + 1 from r join two on here = node where depth < 2)"""


@query(f"{WALK} select * from live where source in (select node from r) and target in (select node from r)")
def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(graph.current(relations(spark, d), "1996-09-01"), "Brand#3", 2, 0.7)


@query(f"{WALK}, e as (select * from live where source in (select node from r) and target in (select node from r)) select node, node = 'Brand#3' as is_root from (select source as node from e union select target from e union select 'Brand#3')")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = graph.neighbourhood(graph.current(relations(spark, d), "1996-09-01"), "Brand#3", 2, 0.7)
    return graph.nodes_of(found, "Brand#3")


def names(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d)
    both = r.select(F.col("source").alias("node")).unionByName(r.select(F.col("target").alias("node"))).distinct()
    return both.select("node", F.upper("node").alias("name"))


@query(f"with {RELATIONS} select *, upper(source) as source_name, upper(target) as target_name from rel")
def edges_named(spark: SparkSession, d: str) -> DataFrame:
    return graph.named(relations(spark, d), names(spark, d))


@query(f"with {RELATIONS} select source, target, kind, confidence, upper(source) as source_name, upper(target) as target_name, row_number() over (order by confidence desc, source, target) as place from rel qualify place <= 20")
def pending_proposals(spark: SparkSession, d: str) -> DataFrame:
    waiting = relations(spark, d).select("source", "target", "kind", "confidence")
    return graph.pending(graph.named(waiting, names(spark, d)), 20)


@query(f"""with {RELATIONS}, x as (select *, case when source = 'NATION_13' then weight * 2 else weight end as w2 from rel)
 select source, target, kind, source <> target and confidence between 0 and 1 and w2 between 0 and 1 as valid from x""")
def edge_validation(spark: SparkSession, d: str) -> DataFrame:
    odd = relations(spark, d).withColumn("weight", F.when(F.col("source") == "NATION_13", F.col("weight") * 2).otherwise(F.col("weight")))
    good, bad = graph.valid_edges(odd)
    told = lambda df, v: df.select("source", "target", "kind", F.lit(v).alias("valid"))
    return told(good, True).unionByName(told(bad, False))


@query(f"""with {RELATIONS}, known as (select distinct n_name as node from nation where n_nationkey % 6 <> 0 union all select distinct p_brand from part)
 select source, target, kind, source not in (select node from known) or target not in (select node from known) as skipped from rel""")
def graph_seed(spark: SparkSession, d: str) -> DataFrame:
    from .domain import table

    n = table(spark, d, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("node"))
    known = n.unionByName(table(spark, d, "part").select(F.col("p_brand").alias("node")).distinct())
    stored, skipped = graph.resolved(relations(spark, d), known)
    told = lambda df, v: df.select("source", "target", "kind", F.lit(v).alias("skipped"))
    return told(stored, False).unionByName(told(skipped, True))
