"""Isolation forests whose samples, axes and cuts a hash chooses: a forest a symbol, grown on a bounded pool and laid beside the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.shared import kept

#: Rows of a symbol that its trees' samples are drawn from, and rows of a sample.
POOL, SAMPLE = 4096, 256
#: Rows of a symbol that are scored in one task, about.
PIECE = 50_000


def md5(*parts: object) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode(), usedforsecurity=False).hexdigest()


def depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def levels(size: int) -> int:
    return int(np.ceil(np.log2(max(2, size))))


def grown(symbol: str, sessions: list[str], x: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axis, cut, count) of the nodes of ``trees`` trees by tree and heap place (root 1); axis -1: a leaf of ``count`` points.

    A tree's sample are the rows of the first hashes of (symbol, tree, session). A node's hash of (symbol, tree, place)
    gives the cut's share between its points' least and largest value, and a rank to each axis along which they differ:
    the highest is cut. All trees grow level by level.
    """
    size = min(SAMPLE, len(x))
    limit = levels(size)
    wide = 1 << (limit + 1)
    axis, cut, count = np.full(trees * wide, -1, np.int8), np.zeros(trees * wide), np.zeros(trees * wide, np.int32)
    point = np.concatenate([np.argsort([md5(symbol, t, s) for s in sessions], kind="stable")[:size] for t in range(trees)])
    node = np.repeat(np.arange(trees) * wide + 1, size)
    for level in range(limit + 1):
        here, at = np.unique(node, return_inverse=True)
        count[here] = np.bincount(at)
        if level == limit:
            break
        low, high = np.full((len(here), x.shape[1]), np.inf), np.full((len(here), x.shape[1]), -np.inf)
        np.minimum.at(low, at, x[point])
        np.maximum.at(high, at, x[point])
        hashes = [[md5(symbol, h // wide, h % wide, *([b] if b else [])) for b in range(-(-x.shape[1] // 4))] for h in here.tolist()]
        rank = np.array([[int(h[k // 4][8 + 6 * (k % 4) : 14 + 6 * (k % 4)], 16) for k in range(x.shape[1])] for h in hashes])
        rank = np.where(high > low, rank, -1)
        inner = (count[here] > 1) & (rank.max(axis=1) >= 0)
        best, row = rank.argmax(axis=1), np.arange(len(here))
        share = np.array([int(h[0][:8], 16) for h in hashes]) / 4294967296.0
        axis[here[inner]] = best[inner]
        cut[here[inner]] = (low[row, best] + share * (high[row, best] - low[row, best]))[inner]
        stay = inner[at]
        point, node = point[stay], node[stay]
        if not len(node):
            break
        right = x[point, axis[node]] >= cut[node]
        node = node // wide * wide + 2 * (node % wide) + right
    return axis, cut, count


def scores(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, count: np.ndarray, trees: int, size: int) -> np.ndarray:
    """2 ^ (-mean path / expected path) of each row, to nine places; all rows go down all trees at once."""
    wide = len(axis) // trees
    base = np.arange(trees) * wide
    node, path = np.ones((len(x), trees), dtype=np.int64), np.zeros((len(x), trees))
    rows = np.arange(len(x))[:, None]
    for _ in range(levels(size)):
        at = base + node
        inner = axis[at] >= 0
        right = x[rows, np.maximum(axis[at], 0)] >= cut[at]
        node, path = np.where(inner, 2 * node + right, node), path + inner
    total = path + depth(count[base + node])
    return np.round(2.0 ** (-total.mean(axis=1) / depth(size)), 9)


def scored(rows: DataFrame, features: list[str], trees: int, least: int) -> DataFrame:
    """(symbol, session, score) of the rows (symbol, session, features) of symbols with ``least`` or more.

    Forests are grown on up to POOL rows of a symbol, those of the first hashes of (symbol, session), and saved, a row a
    symbol of 13 bytes a node. A symbol's rows are dealt in pieces, and its forest goes to each of them, so a
    series of any length is scored in many tasks, in batches.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({f: F.col(f).cast("double") for f in features})
    enough = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("symbol").orderBy(F.md5(F.concat_ws("|", "symbol", F.date_format("session", "yyyy-MM-dd")).cast("binary")))
    pool = rows.join(enough.select("symbol"), "symbol", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= POOL)

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session")
        axis, cut, count = grown(g["symbol"].iloc[0], [str(s) for s in g["session"]], g[features].to_numpy(dtype=float), trees)
        return pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "size": [min(SAMPLE, len(g))], "axis": [axis.tobytes()], "cut": [cut.tobytes()], "count": [count.tobytes()]})

    grows = kept(pool.select("symbol", "session", *features).groupBy("symbol").applyInPandas(grow, "symbol string, size int, axis binary, cut binary, count binary"), "forests")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    every = grows.join(enough.withColumn("pieces", pieces), "symbol").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    none = {f: F.lit(None).cast("double") for f in features}
    left = every.select("symbol", "piece", F.lit(0).alias("side"), F.lit(None).cast("date").alias("session"), *[v.alias(f) for f, v in none.items()], "size", "axis", "cut", "count")
    dealt = rows.join(enough.withColumn("pieces", pieces).select("symbol", "pieces"), "symbol").withColumn("piece", F.pmod(F.xxhash64("session"), "pieces").cast("int"))
    right = dealt.select("symbol", "piece", F.lit(1).alias("side"), "session", *features, F.lit(None).cast("int").alias("size"), *[F.lit(None).cast("binary").alias(c) for c in ("axis", "cut", "count")])
    laid = left.unionByName(right).repartition("symbol", "piece").sortWithinPartitions("symbol", "piece", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for batch in batches:
            side = batch["side"].to_numpy()
            cuts = [0, *(np.nonzero(np.diff(side))[0] + 1).tolist(), len(side)] if len(side) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if side[a] == 0:  # the last of them: a piece has one
                    row = {c: part[c][-1].as_py() for c in ("size", "axis", "cut", "count")}
                    forest = np.frombuffer(row["axis"], np.int8), np.frombuffer(row["cut"], float), np.frombuffer(row["count"], np.int32), row["size"]
                    continue
                for i in range(0, len(part), 512):
                    some = part.slice(i, 512)
                    x = np.stack([some[f].to_numpy(zero_copy_only=False) for f in features], axis=1)
                    yield pa.RecordBatch.from_arrays([some["symbol"], some["session"], pa.array(scores(x, *forest[:3], trees, forest[3]))], names=["symbol", "session", "score"])

    return laid.select("side", "symbol", "session", *features, "size", "axis", "cut", "count").mapInArrow(score, "symbol string, session date, score double")
