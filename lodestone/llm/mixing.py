"""Mixing sources to target weights by entropy balancing: rates are exponentially tilted, then rounded into copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, saved

#: A source's target, and a document's rate, stop at so many times the source or document.
MOST = 3
WEIGHTS = (5, 2, 1)
#: Sums over documents are of integers, so that their order changes no bit: tokens are counted in such parts.
PARTS = 1000
#: Documents that get extra copies are chosen in buckets of about so many of one source and size.
BUCKET = 2000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words in each whole text, 0 for null."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, rounds: int = 100) -> DataFrame:
    """One row a source: source_size and target.

    Sources in code point order, null last, weigh ``weights``, repeating, and share all words. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is above. A source's target is
    the less of that cap and weight * level; the level rises, an aggregate over the sources a round, until those under
    it are full. Sources may be as many as hosts are: their places are told by a range sort, and no window has them all.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    nth = numbered(by, [], ["none", "source"], "sources").drop("size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    rows = saved(nth.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "weights")
    level, full = 0.0, -1
    for _ in range(rounds):
        under = F.col("cap") <= F.lit(level) * F.col("w")
        sums = rows.agg(F.sum("source_size").alias("all"), F.count_if(under).alias("n"), F.sum(F.when(under, F.col("cap"))).alias("cap"), F.sum(F.when(~under, F.col("w"))).alias("w")).first()
        if sums["n"] == full or not sums["w"]:
            break
        full, level = sums["n"], (sums["all"] - (sums["cap"] or 0.0)) / sums["w"]
    else:
        raise RuntimeError(f"the level of targets did not settle in {rounds} rounds")
    return rows.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """Copies that a document gets before rounding: exp(tilt * size / mean), ``most`` at the most."""
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def balance(classes: DataFrame, goals: DataFrame, most: int = MOST, tolerance: float = 1e-7, rounds: int = 60) -> DataFrame:
    """``goals`` with each source's ``tilt``: the minimum of the entropy balancing dual, by Newton's method.

    ``classes``: (source, size, n), documents of a size. With rates q(x) = min(most, exp(tilt * x)), x = size / mean,
    the dual is convex in the tilt and its gradient is the words taken less the target. Each iteration is one
    aggregation over the classes; a step that leaves the bracket of what is known is halved instead.
    """
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    tops = classes.where("size > 0").groupBy("source").agg(F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = goals.alias("g").join(tops.alias("c"), same, "left").select("g.*", F.coalesce("c.least", F.lit(1)).cast("double").alias("least"), F.coalesce("c.mean", F.lit(1.0)).alias("mean"))
    x = F.col("least") / F.col("mean")
    share = F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1))
    state = state.withColumn("lo", F.least(F.log(share), F.lit(0.0)) / x).withColumn("hi", F.lit(math.log(most)) / x)
    state = state.withColumn("done", (F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))).withColumn("tilt", F.when(F.col("done"), F.col("hi")).otherwise(F.greatest("lo", F.least("hi", F.log(share)))))
    state = saved(state, "tilts")
    for _ in range(rounds):
        each = classes.alias("c").join(state.alias("g"), same).where("not g.done and c.size > 0").select("g.source", "c.size", "c.n", "g.mean", rate(F.col("g.tilt"), F.col("c.size"), F.col("g.mean"), most).alias("q"))
        slope = F.when(F.col("q") < most, F.col("q") * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = each.groupBy("source").agg(*[F.sum(F.round(PARTS * F.col("n") * F.col("size") * v).cast("decimal(38,0)")).cast("double").alias(k) for k, v in (("taken", F.col("q")), ("slope", slope))])
        new = state.alias("g").join(sums.alias("c"), same, "left").select("g.*", (F.col("c.taken") / PARTS).alias("taken"), (F.col("c.slope") / PARTS).alias("slope"))
        over = F.col("taken") - F.col("target")
        hit = F.abs(over) <= tolerance * F.col("target") + 0.5
        new = new.withColumn("lo", F.when(over < 0, F.greatest("lo", "tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.least("hi", "tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - over / F.nullif(F.col("slope"), F.lit(0.0))
        new = new.withColumn("tilt", F.when(F.col("done") | hit, F.col("tilt")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("done", F.col("done") | hit | (F.col("hi") - F.col("lo") < 1e-12))
        state = saved(new.drop("taken", "slope"), "tilts")
        if state.where("not done").isEmpty():
            return state
    raise RuntimeError(f"tilts did not settle in {rounds} rounds")


def whole_copies(classes: DataFrame, state: DataFrame, most: int = MOST, near: float = 5e-4, rounds: int = 8) -> DataFrame:
    """Copies of each class (source, size, n, copies), whole numbers whose words come near each source's target.

    The running sum of n * rate over a source's sizes, the largest first, is rounded, and a class gets by how much its
    sum is above the one before. What one class has too much the next ones have too little, so a source is off by
    less than its largest size, in one pass. That is mostly far less; where it is over ``near`` of the target, the
    largest size that isn't over the gap gives or takes as many copies as fit, and so on in up to ``rounds`` rounds, each of which brings it nearer.
    """
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    full = F.col("g.target") >= most * F.col("g.source_size")
    exact = F.when(full, F.lit(float(most))).otherwise(rate(F.col("g.tilt"), F.col("c.size"), F.col("g.mean"), most)) * F.col("c.n")
    now = classes.alias("c").join(state.alias("g"), same).select("c.source", "c.size", "c.n", F.col("g.target").alias("target"), F.round(exact, 6).cast("decimal(30,6)").alias("exact"))
    order = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)  # a row a size
    upto = F.sum("exact").over(order)
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    now = now.withColumn("upto", upto).select("source", "size", "n", "target", (whole(F.col("upto")) - whole(F.col("upto") - F.col("exact"))).alias("copies"))
    now = saved(now, "copies")
    for _ in range(rounds):
        gaps = now.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.max("target").alias("goal"))
        gaps = gaps.where(F.abs("gap") > near * F.col("goal"))
        room = F.when(F.col("g.gap") > 0, most * F.col("c.n") - F.col("c.copies")).otherwise(F.col("c.copies"))
        fits = now.alias("c").join(gaps.alias("g"), same).where((F.col("c.size") > 0) & (F.col("c.size") <= F.abs("g.gap")) & (room > 0))
        move = fits.groupBy("g.source").agg(F.max(F.struct(F.col("c.size").alias("size"), F.least(room, F.floor(F.abs("g.gap") / F.col("c.size"))).alias("q"), F.signum("g.gap").alias("way"))).alias("m"))
        move = saved(move.select("source", "m.size", (F.col("m.q") * F.col("m.way")).cast("long").alias("by")), "moves")
        if move.isEmpty():
            return now
        hit = F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.size") == F.col("g.size"))
        now = saved(now.alias("c").join(move.alias("g"), hit, "left").select("c.source", "c.size", "c.n", "c.target", (F.col("c.copies") + F.coalesce("g.by", F.lit(0))).alias("copies")), "copies")
    return now


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Rates solve, for each source, the entropy balancing problem with its target as the constraint on words and
    ``most`` as the bound of a rate. Copies of a class of documents (one source and size) are split evenly; which of
    its documents get one more is told by a hash of the id, in buckets, so a class may hold any share of the rows.
    Sources and ids may be null. Empty and null texts have size 0 and are taken once, which takes no words. Rows
    that repeat share a rank by hash but each count. An empty table gives no rows. Other columns are ignored.
    """
    sized = saved(sizes(docs), "sizes")
    goals = saved(targets(sized, weights, most), "targets")
    classes = saved(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    dealt = whole_copies(classes, balance(classes, goals, most), most)
    # each class's copies are dealt over buckets by cumulative rounding, in each bucket by rank
    plan = dealt.select("source", "size", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("n"))).alias("base"), F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("copies") % F.col("n")).alias("extra"), "n", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    luck = F.xxhash64(F.lit("mix"), "d.doc_id")
    placed = sized.alias("d").join(plan.alias("p"), same("d", "p")).select("d.doc_id", "d.source", "d.size", "p.base", "p.extra", "p.n", luck.alias("luck"), F.pmod(luck, "p.buckets").alias("bucket"))
    rank = Window.partitionBy("source", "size", "bucket").orderBy("luck", "doc_id")
    counts = placed.where("extra > 0").groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("extra").alias("extra"))
    so_far = F.sum("k").over(Window.partitionBy("source", "size").orderBy("bucket"))  # a row a bucket
    cut = lambda x: F.floor(F.col("extra") * x / F.col("n"))
    quota = counts.select("source", "size", "bucket", (cut(so_far) - cut(so_far - F.col("k"))).alias("quota"))
    ranked = placed.where("extra > 0").withColumn("rank", F.row_number().over(rank))
    most_of = ranked.alias("d").join(quota.alias("p"), same("d", "p") & (F.col("d.bucket") == F.col("p.bucket"))).select("d.doc_id", "d.source", "d.size", (F.col("d.base") + (F.col("d.rank") <= F.col("p.quota")).cast("long")).alias("copies"))
    chosen = placed.where("extra = 0").select("doc_id", "source", "size", F.col("base").alias("copies")).unionByName(most_of)
    out = chosen.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return out.select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target", "d.copies", (F.col("d.copies") * F.col("d.size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to ``most`` times); columns stay as they are.

    Rows that are equal in doc_id, source and size share their copies: as many in all as the mix gives them together.
    """
    sizes_of = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs.select("doc_id", "source", "text"), weights, most).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__of"), "__sum", "__rows")
    keyed = docs.withColumn("__size", sizes_of)
    met = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__of")))
    alone = met.where("__rows = 1").select(*docs.columns, F.col("__sum").alias("__copies"))
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__of").orderBy("text"))
    upto = lambda n: F.floor((n * F.col("__sum")) / F.col("__rows"))
    again = met.where("__rows > 1").withColumn("__copies", upto(nth) - upto(nth - 1)).select(*docs.columns, "__copies")
    return alone.unionByName(again).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__again")).select(*docs.columns)
