"""Relationship graphs: neighbours, reachability, and shocks that travel along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import kept


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end (here, there, forward): joins on an end are equi joins then, never an OR."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), F.lit(True).alias("forward"), *rest)
    return out.unionByName(edges.select(F.col("target").alias("here"), F.col("source").alias("there"), F.lit(False).alias("forward"), *rest))


def current(edges: DataFrame, today: str) -> DataFrame:
    """Edges that hold without a date asked for: not ended before ``today``; when they began doesn't count."""
    return edges.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(today).cast("date")))


def as_of(edges: DataFrame, day: str) -> DataFrame:
    """Edges that held on a day: both bounds count, a null one is open."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(day).cast("date"))
    return current(edges, day).where(begun)


def neighbours(edges: DataFrame, node: str, least: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    some = edges.where(F.col("confidence") >= least)
    return both_ways(some if kinds is None else some.where(F.col("kind").isin(kinds))).where(F.col("here") == node)


def reachable(edges: DataFrame, root: str, hops: int, least: float = 0.0) -> DataFrame:
    """(node, depth): nodes within ``hops`` edges in either direction, with the fewest hops; the root has 0.

    The edges and each hop's nodes are written once, so that the plan of a hop doesn't hold those before it.
    """
    if hops < 0:
        raise ValueError("hops must be 0 or more")
    seen = front = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    if hops:
        step = kept(both_ways(edges.where(F.col("confidence") >= least)).select(F.col("here").alias("node"), "there").distinct(), "steps")
    for d in range(1, hops + 1):
        met = front.join(step, "node").select(F.col("there").alias("node")).distinct()
        front = kept(met.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth")), "front")
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, root: str, hops: int, least: float = 0.0) -> DataFrame:
    """All edges whose two ends are reachable."""
    nodes = reachable(edges, root, hops, least).select("node")
    some = edges.where(F.col("confidence") >= least)
    return some.join(nodes, edges["source"] == nodes["node"], "left_semi").join(nodes, edges["target"] == nodes["node"], "left_semi")


SUPPLY_CHAIN = ["supplies", "manufactures", "customer_of", "depends_on", "produces"]


def neighbourhood(edges: DataFrame, root: str, hops: int, least: float = 0.0) -> DataFrame:
    """Edges around a node: its own for one hop, else those among all that is reachable."""
    if hops <= 1:
        return edges.where((F.col("confidence") >= least) & ((F.col("source") == root) | (F.col("target") == root)))
    return subgraph(edges, root, hops, least)


# fixed values: share of a shock that an edge of a kind hands on, and the way it leads along its arrow
# (1 towards demand, -1 towards supply, 0 across the chain)
TRANSMISSION = {
    "supplies": (0.85, 1), "manufactures": (0.85, 1), "customer_of": (0.7, -1), "depends_on": (0.8, -1), "produces": (0.7, 1),
    "uses": (0.5, -1), "deploys": (0.6, -1), "partners_with": (0.45, 0), "invests_in": (0.5, 0), "competes_with": (-0.35, 0),
    "acquired": (0.6, 0), "operates": (0.4, 1), "located_in": (0.1, 0),
}
#: Kinds that read alike from both ends.
SYMMETRIC = ["partners_with", "competes_with"]
#: Scores under it are no effect.
FLOOR = 0.05


#: Paths of a node that are told.
TOLD = 3


def states(hop: DataFrame) -> DataFrame:
    """Paths that are at one node with one way, score and confidence as one row: how many they are (``n``), and the first
    TOLD of their texts. They go on alike, so nothing tells them apart from here."""
    key = ["node", "way", "score", "confidence", "on"]
    few = F.row_number().over(Window.partitionBy(*key).orderBy("path"))
    texts = hop.select(*key, F.explode("paths").alias("path")).withColumn("__nth", few).where(F.col("__nth") <= TOLD)
    told = texts.groupBy(*key).agg(F.sort_array(F.collect_list("path")).alias("paths"))  # TOLD rows at most
    return hop.groupBy(*key).agg(F.sum("n").alias("n")).join(told, key)


def propagate(edges: DataFrame, origin: str, shock: float = 1.0, hops: int = 3, least: float = 0.5, floor: float = FLOOR) -> DataFrame:
    """(node, score, confidence, direction, paths): what a shock at ``origin`` does to others, hop by hop.

    Along an edge the score is multiplied by its kind's transmission and its weight; scores under ``floor`` end, as do
    edges under the confidence ``least``. Edges lead backwards only if symmetric or of the supply chain. A path that
    went up or down the chain doesn't turn; steps across it are free. None comes back to the origin. A step that turns
    the sign counts and ends its path; a node hands on what arrives at the first depth where something can go on from
    it. Scores of paths add up, the confidence is that of the surest path (its weakest edge), and ``paths`` has the
    three strongest.

    What goes on is a state, not a path: all paths that are at a node with the same way, score and confidence are one
    row with their number and three texts. (The floor is asked of each path's score, so states of unequal scores can't
    be added up before the end.) A step that ends its path, and the last hop, is not kept for another; sums and
    maxima are pre-aggregated, and the three strongest are cut in each task before a node's rows meet.
    """
    rules = F.create_map(*[x for k, (t, w) in TRANSMISSION.items() for x in (F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(w).alias("way")))])
    step = both_ways(edges.where(F.col("confidence") >= least)).withColumn("rule", rules[F.col("kind")]).where("rule is not null")
    step = phrases(step.where(F.col("forward") | F.col("kind").isin(SYMMETRIC + SUPPLY_CHAIN)))
    way = F.when(F.col("forward"), F.col("rule.way")).otherwise(-F.col("rule.way"))
    step = step.select(F.col("here").alias("node"), "there", "weight", F.col("confidence").alias("c"), F.col("rule.t").alias("t"), way.alias("step_way"), F.split_part("phrase", F.lit(" → "), F.lit(2)).alias("verb"))
    step = kept(step, "steps")
    kinds = "node string, way int, score double, confidence double, n long, paths array<string>"
    front = edges.sparkSession.createDataFrame([(origin, 0, float(shock), 1.0, 1, [origin])], kinds)
    settled = front.select("node")
    found = front.limit(0)
    for _ in range(hops):
        hop = front.join(step, "node").where((F.col("there") != origin) & ((F.col("step_way") == 0) | (F.col("way") == 0) | (F.col("way") == F.col("step_way"))))
        hop = hop.select(
            F.col("there").alias("node"), F.when(F.col("step_way") == 0, F.col("way")).otherwise(F.col("step_way")).alias("way"), (F.col("score") * F.col("t") * F.col("weight")).alias("score"),
            F.least("confidence", "c").alias("confidence"), "n", F.transform("paths", lambda p: F.concat(p, F.lit(" → "), "verb", F.lit(" "), "there")).alias("paths"), (F.col("t") > 0).alias("on"),
        ).where(F.abs("score") >= floor)
        hop = kept(states(hop), "hop")
        found = found.unionByName(hop.drop("on"))
        front = hop.where("on").drop("on").join(settled, "node", "left_anti")
        settled = settled.unionByName(front.select("node").distinct())
    out = found.groupBy("node").agg(F.round(F.sum(F.col("n") * F.col("score")), 4).alias("score"), F.round(F.max("confidence"), 3).alias("confidence"))
    strongest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.abs("score")), "path"))
    best = found.select("node", "score", F.explode("paths").alias("path")).withColumn("nth", strongest).where(F.col("nth") <= TOLD)
    texts = best.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list(F.struct("nth", "path")))["path"], "; ").alias("paths"))
    direction = F.when(F.col("score") > 0, "benefits").when(F.col("score") < 0, "at_risk").otherwise("neutral")
    return out.join(texts, "node").select("node", "score", "confidence", "paths").withColumn("direction", direction)


def winners_and_losers(impact: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` strongest of those that benefit and of those at risk, with their rank on either side."""
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(F.abs("score")), "node"))
    return impact.where("direction <> 'neutral'").withColumn("rank", rank).where(F.col("rank") <= limit)


def named(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends (entities: node, name)."""
    of = lambda end: entities.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
    return edges.join(of("source"), "source").join(of("target"), "target")


def pending(proposals: DataFrame, limit: int) -> DataFrame:
    """The surest proposals first, with their place."""
    place = F.row_number().over(Window.orderBy(F.desc("confidence"), "source", "target"))
    top = proposals.orderBy(F.desc("confidence"), "source", "target").limit(limit)
    return top.withColumn("place", place)  # of the rows that the limit leaves


def nodes_of(edges: DataFrame, root: str) -> DataFrame:
    """(node, is_root) of the edges' ends, each once; the root is there without any edge too."""
    one = edges.sparkSession.createDataFrame([(root,)], "node string")
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).unionByName(one)
    return ends.distinct().withColumn("is_root", F.col("node") == root)


def valid_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects): no node has an edge to itself, confidence and weight are from 0 to 1."""
    good = F.coalesce((F.col("source") != F.col("target")) & F.col("confidence").between(0, 1) & F.col("weight").between(0, 1), F.lit(False))
    return edges.where(good), edges.where(~good)


def resolved(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations whose two ends are entities, the skipped ones with an unknown end)."""
    known = lambda df, end: df.join(entities.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    stored = known(known(relations, "source"), "target")
    key = ["source", "target", "kind"]
    return stored, relations.join(stored.select(*key), key, "left_anti")


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


# fixed values: how an edge is read along its direction, and against it
VERBS = {
    "supplies": ("supplies", "is supplied by"), "manufactures": ("manufactures for", "is manufactured by"), "customer_of": ("buys from", "sells to"),
    "depends_on": ("depends on", "is depended on by"), "produces": ("produces", "is produced by"), "uses": ("uses", "is used by"), "deploys": ("deploys", "is deployed by"),
    "partners_with": ("partners with", "partners with"), "invests_in": ("invests in", "is backed by"), "competes_with": ("competes with", "competes with"),
    "acquired": ("acquired", "was acquired by"), "operates": ("operates", "is operated by"), "located_in": ("located in", "hosts"),
}


def phrases(steps: DataFrame) -> DataFrame:
    """Steps (here, there, forward, kind, ...) with ``phrase``, which reads the edge in the direction travelled."""
    table = F.create_map(*[x for k, (a, b) in VERBS.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    verb = F.coalesce(F.get(table[F.col("kind")], F.when(F.col("forward"), 0).otherwise(1)), F.col("kind"))
    return steps.withColumn("phrase", F.concat("here", F.lit(" → "), verb, F.lit(" → "), "there"))
