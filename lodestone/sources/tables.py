"""Stored tables in partitions by key, merged in place: a write reads and replaces the partitions it has rows for."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.merge import upsert

from .shared import folder, kept

#: Partitions that a merge names to the scan as values; of more the scan is told by a join.
LITERAL = 1000


@dataclass(frozen=True)
class Table:
    """Rows of ``kinds`` (a schema) at ``path``, one for each of ``keys``, in partitions by ``part``: an SQL expression of key
    columns, so that rows of one key are in one partition (a date's month, a range of ids, a hash)."""

    path: str
    kinds: str
    keys: tuple[str, ...]
    part: str

    def read(self, spark: SparkSession) -> DataFrame:
        return self.stored(spark).drop("part")

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.kinds}, part string").parquet(self.path)

    def create(self, spark: SparkSession) -> Table:
        spark.createDataFrame([], f"{self.kinds}, part string").write.mode("errorifexists").partitionBy("part").parquet(self.path)
        return self

    def place(self) -> Column:
        return F.coalesce(F.expr(self.part).cast("string"), F.lit("none"))

    def touched(self, spark: SparkSession, new: DataFrame) -> DataFrame:
        """The stored rows in the partitions that ``new`` (with part) has rows for; no other partition is read."""
        parts = [r[0] for r in new.select("part").distinct().limit(LITERAL + 1).collect()]
        old = self.stored(spark)
        return old.where(F.col("part").isin(parts)) if len(parts) <= LITERAL else old.join(new.select("part").distinct(), "part", "left_semi")

    def merge(self, new: DataFrame, order: str | None = None) -> tuple[int, int]:
        """Rows of ``new`` replace those of the same keys, all columns with their nulls; (inserted, matched) keys.

        Of rows with the same keys the one of the largest ``order`` (a column of theirs, or of ``new`` alone) counts; without
        it the first by all columns. The next state of the touched partitions is written aside, then put in place of them
        by a dynamic overwrite: a merge that is tried again gives the same, and files of other partitions stay as they are.
        """
        spark = new.sparkSession
        columns = [c for c in self.stored(spark).columns if c != "part"]
        batch = kept(one(new, columns, self.keys, order).withColumn("part", self.place()), "batch")
        old = self.touched(spark, batch)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("part", *self.keys)]
        matched = batch.alias("n").join(old.alias("o"), same, "left_semi").count()
        after = kept(upsert(old.select(*columns, "part"), batch.select(*columns, "part"), ["part", *self.keys]), f"after-{uuid.uuid4().hex[:8]}")
        after.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        return batch.count() - matched, matched


def one(new: DataFrame, columns: list[str], keys: tuple[str, ...], order: str | None) -> DataFrame:
    """One row of each key, pre-aggregated: that of the largest ``order``, ties and no order by all columns."""
    row = F.struct(*columns)
    best = F.min(row) if order is None else F.max_by(row, F.struct(F.col(order), row))
    return new.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best.alias("r")).select("r.*")


def stored(spark: SparkSession, name: str, kinds: str, keys: tuple[str, ...], part: str) -> Table:
    """A new table in the shared folder."""
    return Table(f"{folder(spark)}/{name}-{uuid.uuid4().hex}", kinds, keys, part).create(spark)


def merged_stream(stream: DataFrame, table: Table, order: str) -> list[tuple[int, int, int, int]]:
    """Merges what a stream has now into ``table``, a batch at a time: late and corrected rows replace what is there, and a
    batch touches the partitions it has rows for. (batch, rows, inserted, matched) of each batch, rows as Spark reports them.

    A row never gives way to one of a smaller ``order``, in whatever batch that comes: ``order`` is a column of the table.
    """
    counts: dict[int, tuple[int, int]] = {}

    def put(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        own = kept(one(batch, columns, table.keys, order).withColumn("part", table.place()), "newest")
        old = table.touched(batch.sparkSession, own)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("part", *table.keys)]
        newer = own.alias("n").join(old.alias("o"), [*same, F.col(f"o.{order}") > F.col(f"n.{order}")], "left_anti")
        counts[number] = table.merge(newer.select(*columns), order)

    run = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder(stream.sparkSession)}/merged-{uuid.uuid4().hex}").foreachBatch(put).start()
    run.awaitTermination()
    rows = {p["batchId"]: p["numInputRows"] for p in run.recentProgress}
    return [(k, rows.get(k, 0), *counts[k]) for k in sorted(counts)]
