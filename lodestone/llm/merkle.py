"""A Merkle manifest of a table: digests of rows, trees of them, and proofs that are looked up by coordinates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved

#: Consecutive nodes that become one.
FAN, BITS = 8, 3
#: Runs of a level that are broadcast at the most: 32 * FAN bytes each, and some columns.
SMALL = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels(size: Column) -> Column:
    """Levels of a tree below its top: how often FAN nodes become one until one is left."""
    return sum(((size > FAN**k).cast("int") for k in range(1, 21)), (size > 1).cast("int"))


def grown(leaves: DataFrame, name: str) -> list[tuple[DataFrame, int]]:
    """The node tables of trees (tree, index, levels, node), one for each level: (tree, run, levels, nodes, up) and its
    row count. A row is a run of FAN consecutive nodes (the last of a tree may have fewer), 32 bytes each in ``nodes``,
    and their common node ``up``, which is the next level's node at index ``run``."""
    out: list[tuple[DataFrame, int]] = []
    now = leaves.where("levels > 0")
    while True:
        runs = now.groupBy("tree", F.shiftright("index", BITS).alias("run")).agg(F.any_value("levels").alias("levels"), F.array_sort(F.collect_list(F.struct("index", "node"))).alias("in"))
        runs = runs.select("tree", "run", "levels", F.expr("aggregate(in, cast('' as binary), (a, x) -> concat(a, x.node))").alias("nodes"))
        runs = saved(runs.withColumn("up", F.unhex(F.sha2(F.lower(F.hex("nodes")).cast("binary"), 256))), name)
        n = runs.count()
        if not n:
            return out
        out.append((runs, n))
        now = runs.where(F.col("levels") > len(out)).select("tree", F.col("run").alias("index"), "levels", F.col("up").alias("node"))


def coordinates(index: str, n: Column, base: Column, top: bool) -> Column:
    """Where a leaf's siblings stand: for each of ``n`` levels its step, level, run, and the own place in the run."""
    one = lambda k: F.struct(
        (base + k).alias("step"), F.lit(top).alias("top"), k.alias("level"), F.call_function("shiftright", F.col(index), BITS * (k + 1)).alias("run"),
        F.call_function("shiftright", F.col(index), BITS * k).bitwiseAND(FAN - 1).cast("int").alias("own"),
    )
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: k < n), one)


def proofs(rows: DataFrame, tree: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None) -> DataFrame:
    """One row for each row of ``rows``: its ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of a row's ``fields``. Leaves of one ``tree`` value stand by ``order`` (null first, ties by
    leaf); every FAN consecutive nodes become their digest until one, the subroot, is left; subroots by tree value
    (null first, bytewise) likewise become the root. All levels are written as tables of runs. A leaf's siblings are
    told by its index and its tree's size alone: coordinates (level, run) are exploded, joined with the node tables,
    ordered, concatenated and folded. Levels of up to SMALL runs are broadcast, so that the few nodes at the top, which
    all leaves ask for, meet no shuffle; a node of the others is asked for by a share of the leaves that falls as fast
    as nodes multiply.

    ``claimed``: the text of the last field as somebody hands it in; null: as it is. The proof is folded from its leaf,
    and ``verified`` tells whether that gives the root. Without ``claimed`` every row must verify.

    Nulls have their own sign in leaves; a null tree value is a tree. Equal rows are leaves side by side with the same
    digest. A tree of one leaf is its leaf; an empty table gives no rows. Other columns are ignored.
    """
    own = [F.col(c).cast("string") for c in fields]
    mine = digest(own)
    other = mine if claimed is None else F.when(claimed.isNull(), mine).otherwise(digest([*own[:-1], claimed]))
    read = rows.select(F.col(tree).alias("tree_key"), F.col(order).alias("key"), mine.alias("leaf"), other.alias("handed"))
    leaves = numbered(saved(read, "digests"), ["tree_key"], ["key", "leaf"], "leaves")  # the range sort reads its input twice
    # trees by number: their keys in order
    trees = saved(numbered(leaves.groupBy("tree_key").agg(F.any_value("size").alias("leaves")), [], ["tree_key"], "trees").select("tree_key", F.col("index").alias("tree"), F.col("size").alias("many")), "numbers")
    leaves = leaves.alias("a").join(trees.alias("b"), F.col("a.tree_key").eqNullSafe(F.col("b.tree_key"))).select("key", "leaf", "handed", "index", "tree", levels(F.col("size")).alias("levels"))
    leaves = saved(leaves, "leaves")
    low = grown(leaves.select("tree", "index", "levels", F.col("leaf").alias("node")), "runs")
    subroots = leaves.where("levels = 0").select("tree", F.col("leaf").alias("node"))
    for k, (runs, _) in enumerate(low):
        subroots = subroots.unionByName(runs.where(F.col("levels") == k + 1).select("tree", F.col("up").alias("node")))
    many = trees.count()
    top = grown(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("index"), levels(F.lit(many)).alias("levels"), "node"), "top-runs")

    deep = F.col("levels")
    steps = F.concat(coordinates("index", deep, F.lit(0), False), coordinates("tree", levels(F.lit(many)), deep, True))
    asked = leaves.select("tree", "index", F.explode(steps).alias("c")).select("tree", "index", "c.*").withColumn("in_tree", F.when(F.col("top"), 0).otherwise(F.col("tree")))
    parts = []
    for small in (False, True):
        some = [(is_top, k, runs) for is_top, grew in ((False, low), (True, top)) for k, (runs, n) in enumerate(grew) if (n <= SMALL) == small]
        if some:
            nodes = functools.reduce(DataFrame.unionByName, [runs.select(F.lit(is_top).alias("top"), F.lit(k).alias("level"), F.col("tree").alias("in_tree"), "run", "nodes", "up") for is_top, k, runs in some])
            here = functools.reduce(Column.__or__, [(F.col("top") == F.lit(is_top)) & (F.col("level") == k) for is_top, k, _ in some])
            parts.append(asked.where(here).join(F.broadcast(nodes) if small else nodes, ["top", "level", "in_tree", "run"]).select("tree", "index", F.struct("step", "own", "nodes", "up").alias("s")))
    none = F.expr("cast(array() as array<struct<step: int, own: int, nodes: binary, up: binary>>)")
    if parts:
        paths = functools.reduce(DataFrame.unionByName, parts).groupBy("tree", "index").agg(F.array_sort(F.collect_list("s")).alias("path"))
        whole = leaves.join(paths, ["tree", "index"], "left").withColumn("path", F.coalesce("path", none))
    else:  # no row, or a single one
        whole = leaves.withColumn("path", none)
    before, after = "substring(s.nodes, 1, 32 * s.own)", f"substring(s.nodes, 32 * s.own + 33, {32 * FAN})"
    siblings = F.expr(f"aggregate(path, cast('' as binary), (a, s) -> concat(a, {before}, {after}))")
    folded = F.expr(f"aggregate(path, handed, (a, s) -> unhex(sha2(cast(lower(hex(concat({before}, a, {after}))) as binary), 256)))")
    text = lambda c: F.lower(F.hex(c))
    root = F.coalesce(F.try_element_at("path", F.lit(-1))["up"], F.col("leaf"))
    subroot = F.when(F.col("levels") > 0, F.get("path", F.col("levels") - 1)["up"]).otherwise(F.col("leaf"))
    return whole.select(
        F.col("key").alias(order), text("leaf").alias("leaf"), text(subroot).alias("subroot"), text(root).alias("root"), F.sha2(text(siblings).cast("binary"), 256).alias("proof_sha256"),
        text(folded).alias("folded_root"), (folded == root).alias("verified"),
    )
