"""The folder that driver and executors share, and streams run to their end into it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that what follows doesn't repeat its plan."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what is there now. ``complete``: of its last state."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is tried again writes over what it wrote; a complete one over all before it
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def stateful(stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], rows: str, state: str) -> DataFrame:
    """All rows that ``step`` gives for a stream's batches, in order: it gets a batch and the state before it, and gives
    rows and the state after. Both are written by batch, so one that is tried again writes the same."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/stateful-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(state).parquet(f"{path}/state/{number - 1}") if number else spark.createDataFrame([], state)
        found, after = step(batch, before)
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/state/{number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/offsets").foreachBatch(put).start().awaitTermination()
    out = spark.read.schema(rows).parquet(f"{path}/rows")
    return out.drop("batch")
