"""Recursive smoothing of long series as a scan: x -> a x + b composes, so blocks of a series are folded side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import kept

#: Days of a block: a task takes these of a symbol, and powers of a factor of 0.8 or more stay within a double's range.
BLOCK = 512


@dataclass(frozen=True)
class Smoothing:
    """y = keep * y before + (1 - keep) * value, as ``turn`` (y before, value) has it. The first y is the mean of the
    ``period`` values from place ``first`` (1, 2 ...) on, and stands where the last of them does; it is null before, and
    from a null value on."""

    value: Column
    first: int
    period: int
    keep: float
    turn: Callable[[Column, Column], Column]

    @property
    def seed(self) -> int:
        return self.first + self.period - 1


def exponential(value: Column, period: int, first: int = 1) -> Smoothing:
    k = 2 / (period + 1)
    return Smoothing(value, first, period, 1 - k, lambda y, x: y + (x - y) * k)


def wilder(value: Column, period: int, first: int = 2) -> Smoothing:
    return Smoothing(value, first, period, (period - 1) / period, lambda y, x: (y * (period - 1) + x) / period)


def placed(rows: DataFrame, previous: tuple[str, ...]) -> DataFrame:
    """``rows`` (symbol, session, ...) with block, before (rows of the symbol in earlier blocks), nth (a row's place from 1),
    and previous_<column> of the row before. Only counts and last rows of blocks meet in a symbol's window."""
    each = rows.withColumn("block", F.floor(F.unix_date("session") / BLOCK))
    own = Window.partitionBy("symbol", "block").orderBy("session")
    blocks = each.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*previous), "session").alias("last"))
    order = Window.partitionBy("symbol").orderBy("block")  # a row a block
    ends = blocks.select("symbol", "block", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(order).alias("last"))
    met = each.withColumn("at", F.row_number().over(own)).withColumns({f"previous_{c}": F.lag(c).over(own) for c in previous}).join(ends, ["symbol", "block"])
    first = {f"previous_{c}": F.when(F.col("at") == 1, F.col("last")[c]).otherwise(F.col(f"previous_{c}")) for c in previous}
    return met.withColumns(first).withColumn("nth", F.col("before") + F.col("at")).drop("at", "last")


def smoothed(rows: DataFrame, how: dict[str, Smoothing]) -> DataFrame:
    """``rows`` of ``placed`` with a column for each smoothing, all in one go.

    Within a block y is keep^k * (y before the block + the sum of (1 - keep) * value * keep^-j): a running sum. A block as a
    whole is x -> a x + b; a symbol's blocks, a row each, are folded in order from its seed, and each gets the y before it.
    The last step to each y is made as written, so that the first of a series are what one step after the other gives.
    """
    own = Window.partitionBy("symbol", "block").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    more: dict[str, Column] = {}
    for name, s in how.items():
        k = F.col("nth") - F.greatest(F.col("before"), F.lit(s.seed))
        after = F.col("nth") > s.seed
        term = F.when(after, (1 - s.keep) * s.value * F.pow(F.lit(s.keep), -k))
        broken = F.count_if(after & s.value.isNull()).over(own) > 0
        more |= {f"k_{name}": F.when(after, k).otherwise(0), f"run_{name}": F.when(~broken, F.coalesce(F.sum(term).over(own), F.lit(0.0))), f"v_{name}": s.value}
    each = kept(rows.withColumns(more), "scan")
    last = F.max_by(F.struct(*[c for name in how for c in (f"k_{name}", f"run_{name}")]), "session").alias("l")
    blocks = each.groupBy("symbol", "block").agg(last).select("symbol", "block", "l.*")
    blocks = blocks.select("symbol", F.struct("block", *[c for name, s in how.items() for c in (F.pow(F.lit(s.keep), f"k_{name}").alias(f"a_{name}"), (F.pow(F.lit(s.keep), f"k_{name}") * F.col(f"run_{name}")).alias(f"b_{name}"))]).alias("s"))
    begins = []
    for name, s in how.items():
        here = F.col("nth").between(s.first, s.seed)
        begins.append(F.when(F.count(F.when(here, F.col(f"v_{name}"))) == s.period, F.sum(F.when(here, F.col(f"v_{name}"))) / s.period).alias(f"y_{name}"))
    seeds = each.where(F.col("nth") <= max(s.seed for s in how.values())).groupBy("symbol").agg(*begins)
    ins = blocks.groupBy("symbol").agg(F.sort_array(F.collect_list("s")).alias("all")).join(seeds, "symbol")  # a row a block, a block of days
    kinds = "block: bigint, " + ", ".join(f"y_{n}: double" for n in how)
    start = f"named_struct('out', cast(array() as array<struct<{kinds}>>), " + ", ".join(f"'y_{n}', y_{n}" for n in how) + ")"
    state = "struct(s.block as block, " + ", ".join(f"acc.y_{n} as y_{n}" for n in how) + ")"
    step = f"named_struct('out', array_append(acc.out, {state}), " + ", ".join(f"'y_{n}', s.a_{n} * acc.y_{n} + s.b_{n}" for n in how) + ")"
    before = ins.select("symbol", F.inline(F.expr(f"aggregate(all, {start}, (acc, s) -> {step}, acc -> acc.out)")))
    met = each.join(before, ["symbol", "block"])
    near = met.withColumns({f"n_{name}": F.pow(F.lit(s.keep), f"k_{name}") * (F.col(f"y_{name}") + F.col(f"run_{name}")) for name, s in how.items()})
    order = Window.partitionBy("symbol", "block").orderBy("session")
    prior = {name: F.when(F.col("nth") == F.col("before") + 1, F.col(f"y_{name}")).otherwise(F.lag(f"n_{name}").over(order)) for name in how}
    out = {name: F.when(F.col("nth") == s.seed, F.col(f"y_{name}")).when(F.col("nth") > s.seed, s.turn(prior[name], F.col(f"v_{name}"))) for name, s in how.items()}
    return near.withColumns(out).drop(*[f"{p}_{name}" for name in how for p in ("k", "run", "v", "y", "n")])
