"""Fitting by distributed gradients: tasks sum over a saved sample's partitions, the driver holds vectors of the weights alone."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Partitions of a saved sample: each gives one gradient in a step.
PARTS = 8

#: (loss, gradient) of a batch of the sample at given weights.
Part = Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]]


def sampled(rows: DataFrame, key: Column, make: Callable, schema: str, name: str) -> DataFrame:
    """``rows`` made into a saved sample by ``make`` (for mapInArrow), in an order that reruns repeat."""
    dealt = rows.withColumn("__k", F.xxhash64(key)).repartition(PARTS, "__k").sortWithinPartitions("__k").drop("__k")
    return saved(dealt.mapInArrow(make, schema), name)


def total(sample: DataFrame, part: Part, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient of the whole sample, a row a partition on their way to the driver."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(x)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = 0.0, np.zeros(len(shared.value))
        for batch in batches:
            if len(batch):
                more, g = part(batch, shared.value)
                loss, grad = loss + more, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "grad"])

    rows = sample.mapInArrow(add, "loss double, grad binary").toArrow()
    shared.unpersist()
    grads = [np.frombuffer(g, dtype=np.float64) for g in rows["grad"].to_pylist()]
    return sum(rows["loss"].to_pylist()), np.sum(grads, axis=0) if grads else np.zeros(len(x))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8, enough: float = 1e-5) -> np.ndarray:
    """A minimum of ``f`` (loss, gradient) by L-BFGS with halved steps; it ends when a step gains little. Where the rounds run
    out before, or no step gains, the best point so far is returned and a RuntimeWarning tells so."""
    loss, g = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = -g, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            d = d - a * y
            back.append(a)
        if moves:
            s, y = moves[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(moves, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        if slope >= 0:
            d, slope, moves = -g, -(g @ g), []
        step = 1.0 if moves else 1 / max(1e-12, np.sqrt(g @ g))  # a first step of length 1
        for _ in range(25):
            new, (after, h) = x + step * d, (np.inf, g)
            after, h = f(new)
            if after <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            warnings.warn(f"no step along the gradient gains: loss {loss:.6g}, gradient {np.sqrt(g @ g):.3g}", RuntimeWarning, stacklevel=2)
            return x
        if (new - x) @ (h - g) > 1e-12:
            moves = [*moves, (new - x, h - g)][-memory:]
        gain = loss - after
        x, loss, g = new, after, h
        if gain <= enough * max(1e-3, abs(loss)):
            return x
    warnings.warn(f"{rounds} rounds ran out: loss {loss:.6g}, gradient {np.sqrt(g @ g):.3g}, last gain {gain:.3g}", RuntimeWarning, stacklevel=2)
    return x
