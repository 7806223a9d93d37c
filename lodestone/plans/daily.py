"""Ordered stages over shared tables: each stage's table is written and handed to the later ones; a failure is reported."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import kept

Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def run(spark: SparkSession, stages: list[Stage]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by stage, report): a row a stage (stage, outcome, rows, seconds, error). A stage that fails leaves no table
    and doesn't stop those after it; those that ask for its table fail in their turn. Rows are counted as they are written."""
    tables: dict[str, DataFrame] = {}
    told = []
    for name, make in stages:
        began = time.monotonic()
        try:
            seen = Observation(name)
            tables[name] = kept(make(tables).observe(seen, F.count(F.lit(1)).alias("rows")), name)
            told.append((name, "succeeded", seen.get["rows"], time.monotonic() - began, None))
        except Exception as e:  # whatever a stage does, the next one gets its turn
            told.append((name, "failed", 0, time.monotonic() - began, f"{type(e).__name__}: {e}"[:300]))
    return tables, spark.createDataFrame(told, "stage string, outcome string, rows long, seconds double, error string")
