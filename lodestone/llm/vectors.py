"""Embedding near-duplicates: an epsilon grid order join over leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, half_space, met, saved, tile_pairs

#: Vectors in one piece of a grid cell at most, about: it bounds what a task holds.
PIECE = 16_384
#: Sequence intervals of at most so many vectors are compared by one matrix product.
LEAF = 512
#: Principal dimensions that make the grid, and those that bound intervals.
GRID, BOUNDS = 2, 8


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest component first, so that nothing overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): rows (key, d1, d2) of usable vectors, and one row (node, d1, d2, low, n, vec) for each text of one.

    Equal vectors are one class, told by two 64-bit digests, so that a group of copies is one node however large it is.
    """
    usable = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(column, lambda x: x != 0)
    keyed = vectors.select(F.col(key).alias("__id"), F.col(column).alias("__vec"), F.coalesce(usable, F.lit(False)).alias("__ok"))
    plus = F.transform("__vec", lambda x: x + F.lit(0).cast("float"))  # -0.0 counts as 0.0
    keyed = keyed.select("__id", "__ok", F.when(F.col("__ok"), plus).alias("__vec"))
    keyed = saved(keyed.select("__id", "__ok", "__vec", F.xxhash64("__vec").alias("d1"), F.xxhash64(F.lit("vector"), "__vec").alias("d2")), "vectors")
    grouped = keyed.where("__ok").groupBy("d1", "d2").agg(F.min("__id").alias("low"), F.count(F.lit(1)).alias("n"), F.any_value("__vec").alias("vec"))
    return keyed.drop("__vec"), saved(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def principal(groups: DataFrame, k: int) -> dict[int, np.ndarray]:
    """Leading principal axes of the most frequent vector length; vectors of other lengths use their first coordinates."""
    often = groups.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if often is None or often["n"] < 2:
        return {}
    scale = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = groups.where(F.size("vec") == often["d"]).select(F.transform("vec", lambda x: x.cast("double") / scale).alias("vec"))
    unit = unit.where(F.forall("vec", lambda x: ~F.isnan(x))).select(array_to_vector("vec").alias("v"))
    return {often["d"]: PCA(k=min(k, often["d"]), inputCol="v", outputCol="p").fit(unit).pc.toArray()}


def place(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], width: float, grid: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch["vec"]
        flat, at = vecs.flatten().to_numpy(zero_copy_only=False), np.diff(vecs.offsets.to_numpy())
        ends = np.cumsum(at)
        cells = np.zeros((len(at), grid), dtype=np.int32)
        for d in np.unique(at):
            rows = np.nonzero(at == d)[0]
            x = units(flat[(ends[rows] - d)[:, None] + np.arange(d)])
            p = x @ axes[d][:, :grid] if d in axes else x[:, :grid]
            cells[rows[:, None], np.arange(p.shape[1])] = np.floor(p / width)
        cell = pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1)), grid).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), cell, batch["node"], batch["n"], vecs], names=["space", "cell", "node", "n", "vec"])


class Sequence:
    """Vectors in grid order of their principal coordinates, with the bounds of their nested intervals."""

    def __init__(self, node: np.ndarray, n: np.ndarray, x: np.ndarray, axes: np.ndarray | None, width: float):
        p = x @ axes if axes is not None else x[:, :BOUNDS]
        order = np.lexsort(np.floor(p / width).T[::-1])
        self.node, self.n, self.x, p = node[order], n[order], x[order], p[order]
        self.single = self.x.astype(np.float32)
        self.p, self.bounds = p, {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.bounds:
            self.bounds[a, b] = self.p[a:b].min(axis=0), self.p[a:b].max(axis=0)
        return self.bounds[a, b]


def join(left: Sequence, right: Sequence, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of linked vectors of two sequences; with ``same``, j after i. Distant intervals are skipped whole."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    slack = max(1e-4, 1e-6 * left.x.shape[1])
    todo = [(0, len(left.node), 0, len(right.node))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and c < a:
            continue
        (low, high), (low2, high2) = left.box(a, b), right.box(c, d)
        gap = np.maximum(0, np.maximum(low2 - high, low - high2))
        if gap @ gap > reach * reach:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
            todo += [(a, m, c, n), (m, b, c, n), (a, m, n, d), (m, b, n, d)]
            continue
        i, j = np.nonzero(left.single[a:b] @ right.single[c:d].T >= cosine - slack)
        if same and a == c:
            i, j = i[keep := j > i], j[keep]
        if not len(i):
            continue
        if len(i) * 20 > (b - a) * (d - c):
            ok = (left.x[a:b] @ right.x[c:d].T)[i, j] >= cosine
        else:
            ok = np.einsum("ij,ij->i", left.x[a + i], right.x[c + j]) >= cosine
        yield a + i[ok], c + j[ok]


def near_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding", grid: int = GRID) -> DataFrame:
    """One row for each row of ``vectors``: key, n_links, component_id, kept.

    Rows link when their vectors' cosine, in double precision, is ``cosine`` or more; labels and other columns are
    ignored. component_id is the smallest key that links reach, kept whether it is the row's own. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Repeated rows are rows of their own and link with each other. A null key takes part but names no component; a
    component of null keys alone has component_id null and is kept. Equal vectors are compared once, for all of them.
    """
    spark = vectors.sparkSession
    width = float(np.sqrt(max(1e-12, 2 - 2 * cosine)) + 1e-6)
    members, groups = classes(vectors, key, column)
    axes = spark.sparkContext.broadcast(principal(groups, BOUNDS))
    cells = groups.select("node", "n", "vec")
    kind = dict(groups.dtypes)["vec"]
    cells = saved(cells.mapInArrow(lambda bs: place(bs, axes.value, width, grid), f"space int, cell array<int>, node long, n long, vec {kind}"), "cells")
    # cells of unit vectors: (2 / width + 2) ^ grid at most for a vector length, so their sizes may be broadcast
    sizes = F.broadcast(cells.groupBy("space", "cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("__n")))
    tiles = cells.join(sizes, ["space", "cell"]).groupBy("space", "cell", F.pmod(F.xxhash64("node"), "__n").alias("piece")).agg(F.collect_list(F.struct("node", "n", "vec")).alias("rows"))
    pairs = tile_pairs(tiles, half_space(grid, 1, lambda o: True), ["rows"], "tiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequence(rows: pa.StructArray) -> Sequence:
            vec = rows.field("vec")
            x = units(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
            return Sequence(rows.field("node").to_numpy(), rows.field("n").to_numpy(), x, axes.value.get(x.shape[1]), width)

        known: tuple = ()
        for l_row, r_row, same in met(batches, ["rows"]):
            if not known or known[0] is not l_row:
                known = l_row, sequence(l_row[0].values)
            left = known[1]
            right = left if same else sequence(r_row[0].values)
            one, two = np.zeros(len(left.node), dtype=np.int64), np.zeros(len(right.node), dtype=np.int64)
            a, b = [], []
            for i, j in join(left, right, cosine, same):
                np.add.at(one, i, right.n[j])
                np.add.at(two, j, left.n[i])
                x, y = forest(left.node[i], right.node[j]) if len(i) else (i, j)
                a.append(x)
                b.append(y)
            if not a:
                continue
            x, y = forest(np.concatenate(a), np.concatenate(b))
            if same:
                one, two = one + two, np.zeros(0, dtype=np.int64)
            node, links = np.concatenate([left.node, right.node[: len(two)]]), np.concatenate([one, two])
            on = links > 0
            void = pa.nulls(int(on.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), void], names=["node", "links", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.nulls(len(x), pa.int64()), pa.array(y, pa.int64())], names=["node", "links", "other"])

    found = saved(pairs.mapInArrow(compare, "node long, links long, other long"), "links")
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    rooted = groups.select("node", "d1", "d2", "low", "n").join(roots, "node", "left").join(links, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(low, "root").select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = members.where("__ok").join(named, ["d1", "d2"]).select(F.col("__id").alias(key), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = members.where("not __ok").select(F.col("__id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
