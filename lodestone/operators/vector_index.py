"""A stored vector index: rows by the cell of their nearest centroid, probed by distance and ranked by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import kept

#: Rows that centroids and the number of probes are fitted on, at the most; also the rows of the driver's matrices.
SAMPLE = 20_000
#: Cells at the most: centroids of 64 dimensions are 2 MB then, and go to every task.
MOST_CELLS = 4096
#: Queries of one cell, and rows, that meet in one task, about.
CHUNK, PIECE = 1024, 50_000
#: Cell of vectors without a direction: they score 0 with everything, and every query asks it.
NOWHERE = -1
#: Rows and cells that are compared at a time.
CELLS = 1 << 18


def slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows that a matrix of them and ``cells`` has CELLS entries, about."""
    step = max(1, CELLS // cells)
    for batch in batches:
        yield from (batch.slice(i, step) for i in range(0, len(batch), step))


@dataclass(frozen=True)
class Index:
    """An index at ``path``: ``rows`` (cell; key, vector, and the columns kept for filters), sorted by those columns."""

    path: str
    dims: int
    centroids: np.ndarray
    probes: int
    counts: dict[int, int]
    least: dict[int, float]
    kinds: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.kinds).parquet(f"{self.path}/rows")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def sphere_means(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows by k-means on the sphere; rows stand in a random order, and the first are the start."""
    c = x[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        some = (sums * sums).sum(axis=1) > 0
        c[some] = unit(sums[some])
    return c


def needed(x: np.ndarray, c: np.ndarray, k: int, recall: float, asked: int = 500) -> int:
    """Cells a query has to probe so that the ``recall`` share of its ``k`` nearest rows is found, on the sample.

    Neighbours in a sample are farther than those in the table, and spread over more cells: the number is a safe one.
    """
    q = x[: min(asked, len(x))]
    near = (x @ c.T).argmax(axis=1)
    order = np.argsort(-(q @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), axis=1)
    best = np.argsort(-(q @ x.T), axis=1)[:, : min(k, len(x))]
    return int(np.quantile(np.take_along_axis(place, near[best], axis=1), recall, method="higher")) + 1


def write(vectors: DataFrame, key: str, column: str, path: str, keep: tuple[str, ...] = (), k: int = 20, recall: float = 0.95) -> Index:
    """Indexes every row of ``vectors`` whose vector is of the commonest length and finite; others can't be compared.

    Centroids are fitted on up to SAMPLE rows that a hash of the key picks, as many as the square root of the rows;
    so is the number of cells that a query probes for ``recall`` of its ``k`` nearest rows. All rows are then assigned in
    batches and written by cell, a large cell as several files; the least cosine to its centroid is noted for each.
    """
    spark = vectors.sparkSession
    sized = vectors.where(F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    dims = sized.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, many = (dims["dims"], dims["count"]) if dims else (1, 0)
    rows = sized.where(F.size(column) == dims).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"), *keep)
    some = rows.where(F.exists("vector", lambda v: v != 0))
    luck = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30))
    sample = some.where(luck < int((1 << 30) * min(1.0, SAMPLE / max(many, 1)))).select("vector", luck.alias("luck"), "key").toArrow().sort_by([("luck", "ascending"), ("key", "ascending")])
    x = unit(matrix(sample["vector"].combine_chunks(), dims)) if len(sample) else np.eye(1, dims)
    c = sphere_means(x, max(1, min(MOST_CELLS, len(x), round(many**0.5))))
    probes = needed(x, c, k, recall)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(c)):
            own = matrix(batch["vector"], dims)
            cos = unit(own) @ c.T
            cell = np.where(np.abs(own).sum(axis=1) > 0, cos.argmax(axis=1), NOWHERE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(cos.max(axis=1))], names=[*batch.schema.names, "cell", "cos"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    laid = rows.mapInArrow(assigned, f"{kinds}, cell int, cos double")
    files = max(1, many // (PIECE * len(c)))
    laid = laid.repartition(max(len(c) // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", F.pmod(F.xxhash64("key"), F.lit(files)))
    laid.sortWithinPartitions("cell", *keep, "key").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    about = spark.read.schema("cos double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")).collect()  # a row a cell
    return Index(path, dims, c, probes, {r["cell"]: r["n"] for r in about}, {r["cell"]: r["least"] for r in about}, f"{kinds}, cos double, cell int")


def to_probe(queries: DataFrame, index: Index, probes: int, passing: dict[int, int], want: int) -> DataFrame:
    """(query_id, query, cell): the cells of the nearest centroids, ``probes`` at least, and on until they hold ``want``
    rows that pass; cells without any are left out. With a column ``last``: instead all others that may hold a row as
    near as that, by the angle between query and centroid and the widest angle of the cell's rows."""
    c, dims = index.centroids, index.dims
    counts = np.array([passing.get(i, 0) for i in range(len(c))])
    wide = np.array([np.arccos(np.clip(index.least.get(i, 1.0), -1, 1)) for i in range(len(c))])
    nowhere = passing.get(NOWHERE, 0) > 0
    rest = "last" in queries.columns

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(c)):
            cos = np.clip(unit(matrix(batch["query"], dims)) @ c.T, -1, 1)
            order = np.argsort(-cos, axis=1, kind="stable")
            before = np.cumsum(counts[order], axis=1) - counts[order]
            first = (np.arange(len(c)) < probes) | (before < want)
            if rest:
                last = batch["last"].to_numpy(zero_copy_only=False).astype(float)
                bound = np.cos(np.maximum(0, np.arccos(cos) - wide))
                may = np.isnan(last)[:, None] | (bound >= last[:, None] - 2e-6)
                first = ~first & np.take_along_axis(may, order, axis=1)
            at, nth = np.nonzero(first & (counts[order] > 0))
            cell = order[at, nth]
            if nowhere and not rest:
                at, cell = np.concatenate([at, np.arange(len(batch))]), np.concatenate([cell, np.full(len(batch), NOWHERE)])
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(at)), batch["query"].take(pa.array(at)), pa.array(cell, pa.int32())], names=["query_id", "query", "cell"])

    return queries.mapInArrow(told, "query_id long, query array<double>, cell int")


def scored(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's ``k`` best of the rows that stand with it, in rows (cell, chunk, piece, side, id, vector) that are sorted
    so: a group's queries come before its rows, which stream by."""
    group, ids, queries, q = None, [], [], np.empty((0, dims))
    best: tuple[np.ndarray, np.ndarray] | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if best is not None:
            score, key = best
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids), score.shape[1]), pa.int64()), pa.array(key.ravel(), pa.int64()), pa.array(score.ravel())], names=["query_id", "key", "similarity"])

    for batch in batches:
        if not len(batch):
            continue
        groups = list(zip(*[batch[n].to_pylist() for n in ("cell", "chunk", "piece")], strict=True))
        side = batch["side"].to_numpy()
        cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1] or side[i] != side[i - 1]], len(groups)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if groups[a] != group:
                yield from done()
                group, ids, queries, best = groups[a], [], [], None
            if side[a] == 0:
                ids += part["id"].to_pylist()
                queries.append(unit(matrix(part["vector"], dims)))
                q = np.concatenate(queries)
                continue
            if not ids:
                continue
            for i in range(0, len(part), 256):
                some = part.slice(i, 256)
                score = np.round(np.einsum("qd,nd->qn", q, unit(matrix(some["vector"], dims))), 6) + 0.0
                key = np.broadcast_to(some["id"].to_numpy(), score.shape)
                if best is not None:
                    score, key = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], key], axis=1)
                order = np.lexsort((key, -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, axis=1), np.take_along_axis(key, order, axis=1)
    yield from done()


def met(probed: DataFrame, rows: DataFrame, passing: dict[int, int], dims: int, k: int) -> DataFrame:
    """(query_id, key, similarity): each query's ``k`` best rows, or more, of the cells it probes.

    A cell's queries are dealt in chunks and its rows in pieces, so many that CHUNK of the one meet PIECE of the other in a
    task, however many there are in all; the index is read once.
    """
    spark = probed.sparkSession
    probed = kept(probed, "probed")
    asked = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    deal = [(cell, -(-n // CHUNK), -(-passing.get(cell, 0) // PIECE)) for cell, n in asked.items()]
    dealt = F.broadcast(spark.createDataFrame(deal, "cell int, chunks int, pieces int"))
    one = lambda v, n: F.pmod(F.xxhash64(v), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probed.join(dealt, "cell").select("cell", one("query_id", "chunks").alias("chunk"), every("pieces").alias("piece"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("query").alias("vector"))
    right = rows.where(F.col("cell").isin(list(asked))).join(dealt, "cell").select("cell", every("chunks").alias("chunk"), one("key", "pieces").alias("piece"), F.lit(1).alias("side"), F.col("key").alias("id"), "vector")
    groups = ["cell", "chunk", "piece"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(c * p for _, c, p in deal) // 8)
    laid = left.unionByName(right).repartition(tasks, *groups).sortWithinPartitions(*groups, "side")
    return laid.mapInArrow(lambda bs: scored(bs, dims, k), "query_id long, key long, similarity double")


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, exact: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): rows of largest cosine with each of ``queries`` (query_id, query), ties by key.

    ``where``: a condition on the columns kept, which goes into the scan; cells are then counted by the rows that pass, and
    a query probes on until it has four times ``k`` of them. ``exact``: cells that may still hold a row among the ``k`` best
    are read too, so that nothing is lost; else what the probed cells hold is ranked.
    """
    spark = queries.sparkSession
    rows = index.rows(spark)
    rows = rows if where is None else rows.where(where)
    passing = index.counts if where is None else {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    rows = rows.select("cell", "key", "vector")
    own = kept(queries.where(F.size("query") == index.dims).select("query_id", F.col("query").cast("array<double>").alias("query")), "queries")
    least, want = probes or index.probes, 0 if where is None else 4 * k
    found = kept(ranked(met(to_probe(own, index, least, passing, want), rows, passing, index.dims, k), k), "near")
    if not exact:
        return found
    last = own.join(found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("last")), "query_id", "left").select("query_id", "query", "last")
    more = met(to_probe(last, index, least, passing, want), rows, passing, index.dims, k)
    return ranked(found.drop("rank").unionByName(more), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_read(index: Index, queries: DataFrame, probes: int | None = None) -> float:
    """The share of the index that the queries read on average, by the counts of the cells they probe."""
    own = queries.where(F.size("query") == index.dims).select("query_id", F.col("query").cast("array<double>").alias("query"))
    per = {r["cell"]: r["n"] for r in to_probe(own, index, probes or index.probes, index.counts, 0).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sum(n * index.counts[cell] for cell, n in per.items()) / max(1, own.count() * sum(index.counts.values()))
