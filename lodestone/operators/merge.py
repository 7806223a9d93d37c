"""Idempotent writes, as DataFrames of a table's next state: merges, insert-only loads, replacements and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same keys (null keys are equal); of several new ones that of the largest ``order``."""
    if order is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.alias("o").join(new.alias("n"), same, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def one_a_key(new: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the rows with the same keys, by all their columns in order."""
    return new.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.struct(*new.columns)).alias("__r")).select("__r.*")


def insert_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those ``new`` rows whose keys it hasn't; what is there wins, and of new rows with the same keys the first."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    fresh = one_a_key(new.select(*old.columns), keys).alias("n").join(old.select(*keys).alias("o"), same, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_for(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of the sources that ``new`` has are replaced by its own, so none is orphaned."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def deactivate_missing(old: DataFrame, present: DataFrame, key: str, source: str) -> DataFrame:
    """``old`` with is_active false for rows of ``source`` whose key is not ``present``; an empty sync changes nothing."""
    there = present.select(key, F.lit(True).alias("__there")).distinct()
    some = present.agg((F.count(F.lit(1)) > 0).alias("__some"))  # one row
    met = old.join(there, key, "left").join(F.broadcast(some))
    gone = F.col("__some") & F.col("__there").isNull() & (F.col("source") == source) & F.col("is_active")
    return met.withColumn("is_active", F.col("is_active") & ~gone).select(*old.columns)


def widen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Watermarks first and last of each key, only ever widened; nulls count as not there."""
    met = old.alias("o").join(new.groupBy(key).agg(F.min("first").alias("f"), F.max("last").alias("l")).alias("n"), key, "full")
    return met.select(key, F.least("o.first", "n.f").alias("first"), F.greatest("o.last", "n.l").alias("last"))


def delete_after(rows: DataFrame, limit: DataFrame, key: str, order: str) -> DataFrame:
    """Rows up to each key's last computable ``order``; rows of keys without one stay."""
    met = rows.join(limit.select(key, F.col(order).alias("__last")), key, "left")
    return met.where(F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).select(*rows.columns)


def coalesce_set(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set from ``new`` where it has a value, else as it was; of several values of a key the largest."""
    values = new.groupBy(key).agg(F.max(column).alias("__new"))
    met = old.alias("o").join(values, key, "left")
    return met.select(*[F.coalesce("__new", F.col(f"o.{c}")).alias(c) if c == column else F.col(c) for c in old.columns])


def without_model(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks less those of a retired model."""
    return chunks.where(~F.col("embedding_model").eqNullSafe(F.lit(model)))


def attach(anomalies: DataFrame, told: DataFrame, key: str = "id") -> DataFrame:
    """``anomalies`` with explanation and documents of ``told`` (key, explanation, documents) where it has the key."""
    met = anomalies.alias("a").join(told.select(key, F.col("explanation").alias("__e"), F.col("documents").alias("__d")), key, "left")
    new = {"explanation": F.coalesce("__e", "a.explanation"), "documents": F.coalesce("__d", "a.documents")}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in anomalies.columns])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns))


def lacking(rows: DataFrame, chunks: DataFrame, model: str, key: str = "article") -> DataFrame:
    """Rows that have no chunk of a model (chunks: source_id, embedding_model): a queue that its own results empty."""
    done = chunks.where(F.col("embedding_model") == model).select(F.col("source_id").alias(key)).distinct()
    return rows.join(done, key, "left_anti")


def newer(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Those ``new`` rows that come after the ``old`` row of their keys, or have none."""
    met = new.join(old.select(*keys, F.col(order).alias("__old")), keys, "left")
    return met.where(F.col("__old").isNull() | (F.col(order) > F.col("__old"))).select(*new.columns)
