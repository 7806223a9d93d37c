"""Helpers that the operators share: saved intermediate tables, connected components, hashed tokens."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, and its complement, as the contracts have them: anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame, name: str, out: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts its lineage, and a lost executor costs no rerun. What its
    job has shuffled goes at once, not when the driver happens to collect its garbage. ``out``: see ``scratch``."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = SCOPES.get()[:-1] if out else SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that are saved in each open ``scratch``, the innermost last.
SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved meanwhile go at its end, but those saved with ``out``, which go with the scratch around it."""
    own: list[str] = []
    token = SCOPES.set((*SCOPES.get(), own))
    try:
        yield
    finally:
        SCOPES.reset(token)
        for path in own:
            delete(spark, path)


#: Saved tables of one driver stand in a folder of their own.
RUN = f"lodestone-{uuid.uuid4().hex}"


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{RUN}"


def release(spark: SparkSession) -> None:
    """Deletes the tables that this driver's operators have saved; results that were not written yet need them."""
    delete(spark, run_dir(spark))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``index``, a row's place from 0 among its group in ``order``, and ``size``, the group's rows; saved.

    Rows are range sorted by group and order, whatever share one group holds; what a partition has of a group is
    counted, and the places begin where the partitions before it end. Rows that are equal in all of these may stand in
    any order; they are spread over partitions like others.
    """
    keys = [F.col(c) for c in [*group, *order]] + [F.col("__row")]
    laid = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    laid = saved(laid.drop("__row").withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__at", 33).alias("__part")
    of = Window.partitionBy(*group)  # a row for each partition that has rows of the group
    firsts = laid.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    firsts = firsts.withColumn("size", F.sum("n").over(of)).withColumn("first", F.col("first") - F.coalesce(F.sum("n").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("a.__part") == F.col("b.__part")
    for c in group:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = laid.withColumn("__part", part).alias("a").join(firsts.alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a.__at") - F.col("b.first")).alias("index"), "b.size")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root) for each node, root its smallest.

    Each round every node hands the smallest of its neighbours to its larger neighbours, then to its smaller ones
    (alternating star contraction: logarithmically many rounds). Minima are pre-aggregated on the map side. A node with
    over a thousandth of all edges is a hub; at most 2,000 nodes are, so theirs are broadcast, and no task gets a hub's
    edges. Every round's edges are saved.
    """
    edges = saved(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before and now[0] == now[1]:
            break
        before, many = now, max(1000, now[0] // 1000)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours point to the smallest node around
        large = with_least(both, many, F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # of a node's smaller neighbours, all point to the smallest
        met = with_least(saved(large, "edges"), many, F.col("m"))
        two = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = saved(met.select(F.explode(two).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def with_least(edges: DataFrame, many: int, value: Column) -> DataFrame:
    """``edges`` (u, v) with m, of u and its least v; those of nodes with over ``many`` edges get it by a broadcast."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", value.alias("m"), (F.col("n") > many).alias("hub")), "least")
    hubs = edges.join(F.broadcast(least.where("hub").select(F.col("u").alias("h"), F.col("m").alias("hm"))), F.col("u") == F.col("h"), "left")
    hubs = hubs.select("u", "v", "h", "hm")
    rest = hubs.where("h is null").select("u", "v").join(least.where("not hub").select("u", "m"), "u").select("u", "v", "m")
    return hubs.where("h is not null").select("u", "v", F.col("hm").alias("m")).unionByName(rest)


#: Right tiles that go with one copy of a left tile, and rows of tiles in a task, about.
TOGETHER, ROWS = 16, 64


def tile_pairs(tiles: DataFrame, offsets: list[tuple[int, ...]], payload: list[str], name: str) -> DataFrame:
    """Pairs of pieces whose integer cells are equal or differ by one of ``offsets`` (a half space), for ``met``.

    ``tiles``: rows (space, cell array<int>, piece, *payload), a piece holding a bounded number of items. Which pieces
    meet is told by their numbers alone. A left piece then travels once with up to TOGETHER right ones: each group's
    rows (side, own, *payload) stand together in one partition, the left piece (side 0) first; ``own``: it meets itself.
    """
    tiles = saved(tiles.withColumn("tile", F.monotonically_increasing_id()), name)
    ids = tiles.select("space", "cell", "piece", "tile")
    zero = [0] * len(offsets[0])
    far = F.array(*[F.array(*[F.lit(int(x)) for x in o]) for o in [zero, *offsets]])
    left = ids.select("space", "cell", "piece", F.col("tile").alias("l"), F.explode(far).alias("o"))
    left = left.select("space", F.zip_with("cell", "o", lambda a, b: a + b).alias("to"), F.col("piece").alias("l_piece"), "l", F.exists("o", lambda x: x != 0).alias("other"))
    right = ids.select("space", F.col("cell").alias("to"), F.col("piece").alias("r_piece"), F.col("tile").alias("r"))
    pairs = left.join(right, ["space", "to"]).where(F.col("other") | (F.col("r_piece") >= F.col("l_piece"))).select("l", "r")
    nth = F.row_number().over(Window.partitionBy("l").orderBy("r")) - 1
    pairs = saved(pairs.withColumn("chunk", F.floor(nth / TOGETHER)), f"{name}-pairs")
    spread = max(partitions(tiles.sparkSession), pairs.count() // ROWS)
    lefts = pairs.groupBy("l", "chunk").agg(F.max(F.col("l") == F.col("r")).alias("own"))
    rows = lefts.select("l", "chunk", F.lit(0).alias("side"), "own", F.col("l").alias("tile"))
    rows = rows.unionByName(pairs.where("l <> r").select("l", "chunk", F.lit(1).alias("side"), F.lit(False).alias("own"), F.col("r").alias("tile")))
    full = rows.join(tiles.select("tile", *payload), "tile")
    return full.repartition(spread, "l", "chunk").sortWithinPartitions("l", "chunk", "side", "tile").select("side", "own", *payload)


def met(batches: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[tuple[tuple, tuple, bool]]:
    """(left, right, whether they are one piece) of each pair of pieces, in the rows that ``tile_pairs`` gives."""
    left: tuple = ()
    for batch in batches:
        side, own = batch["side"].to_pylist(), batch["own"].to_pylist()
        for i in range(len(batch)):
            row = tuple(batch[c][i] for c in payload)
            if side[i]:
                yield left, row, False
            else:
                left = row
                if own[i]:
                    yield left, left, True


def half_space(dims: int, reach: int, within) -> list[tuple[int, ...]]:
    """Non-zero integer offsets up to ``reach`` in each coordinate for which ``within`` holds, one of each pair o, -o."""
    grid = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * dims, indexing="ij"), -1).reshape(-1, dims)
    return [tuple(int(v) for v in o) for o in grid if tuple(o) > (0,) * dims and within(o)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``a``-``b``: as connected as they are, with one edge at most for each node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        label_next = new[label]
        if (label_next == label).all():
            break
        label = label_next
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
