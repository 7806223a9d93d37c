"""Scans over blocks against plain recursions, and medians by brackets against sorted ones."""

import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import anomaly, indicators, recursion

DAY = datetime.date(1990, 1, 1)


def plain(x, first, period, keep):
    """One value after the other; ``first`` counts from 1."""
    out, y = [None] * len(x), None
    for i, v in enumerate(x, 1):
        if i == first + period - 1:
            seed = x[first - 1 : i]
            y = None if None in seed else sum(seed) / period
        elif i > first + period - 1:
            y = None if y is None or v is None else keep * y + (1 - keep) * v
        out[i - 1] = y
    return out


def bars_of(n, rng, every=1, hole=None):
    out, price = [], 100.0
    for i in range(n):
        price *= 1 + rng.uniform(-0.03, 0.03)
        out.append([DAY + datetime.timedelta(days=i * every), None if i == hole else price, price * 1.01, price * 0.98, price * 1.001])
    return out


def expected(rows):
    x, high, low, close = ([r[k] for r in rows] for k in (1, 2, 3, 4))
    fast, slow = plain(x, 1, 12, 11 / 13), plain(x, 1, 26, 25 / 27)
    macd = [None if None in (a, b) else a - b for a, b in zip(fast, slow, strict=True)]
    signal = plain(macd, 26, 9, 0.8)
    step = [None] + [None if None in (a, b) else b - a for a, b in zip(x, x[1:], strict=False)]
    gain, loss = (plain([None if s is None else max(k * s, 0.0) for s in step], 2, 14, 13 / 14) for k in (1, -1))
    reach = [None] + [max(h - w, abs(h - c), abs(w - c)) for h, w, c in zip(high[1:], low[1:], close, strict=False)]
    rsi = [None if g is None else (100.0 if g > 0 else 50.0) if d == 0 else 100 - 100 / (1 + g / d) for g, d in zip(gain, loss, strict=True)]
    return list(zip(fast, slow, macd, signal, [None if None in (a, b) else a - b for a, b in zip(macd, signal, strict=True)], rsi, plain(reach, 2, 14, 13 / 14), strict=True))


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert [v is None for v in g] == [v is None for v in w]
        assert all(v is None or abs(v - u) <= 1e-9 * max(1, abs(u)) for v, u in zip(g, w, strict=True))


@pytest.mark.parametrize("block", [512, 5])
def test_smoothing_in_blocks_is_that_of_the_series(spark, monkeypatch, block):
    monkeypatch.setattr(recursion, "BLOCK", block)
    rng = random.Random(3)
    series = {"long": bars_of(700, rng), "weekly": bars_of(120, rng, 7), "short": bars_of(13, rng), "one": bars_of(1, rng), "hole": bars_of(90, rng, 1, 40), "early": bars_of(60, rng, 1, 3)}
    series["flat"] = [[DAY + datetime.timedelta(days=i), 5.0, 5.0, 5.0, 5.0] for i in range(40)]
    rows = [(s, *r) for s, v in series.items() for r in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, session date, adjusted_close double, high double, low double, close double")
    got = {}
    for r in indicators.smoothed(df).orderBy("symbol", "session").collect():
        got.setdefault(r["symbol"], []).append(tuple(r)[2:])
    for s, v in series.items():
        same(got[s], expected(v))
    flat = got["flat"]
    assert all(r[5] == 50 for r in flat[14:]) and all(r[5] is None for r in flat[:14]) and all(r[6] == 0 for r in flat[14:])
    assert indicators.smoothed(df.limit(0)).count() == 0


def test_a_million_bars_go_through_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small machine would join what are tasks of a large one
    try:
        million(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def million(spark):
    n = 1_000_000
    x = F.sin(F.col("id") / 50) + F.col("id") % 17 / 10 + 5
    start = F.lit("0001-01-03").cast("date")
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.date_add(start, F.col("id").cast("int")).alias("session"), x.alias("adjusted_close"))
    rows = recursion.smoothed(recursion.placed(df, ("adjusted_close",)), {"y": recursion.exponential(F.col("adjusted_close"), 26)})
    counts = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == n and max(counts) < 0.6 * n
    got = rows.where((F.col("nth") % 99_991 == 0) | (F.col("nth") == n)).orderBy("nth").select("nth", "y").collect()
    i = np.arange(n)
    v, y, k, want = np.sin(i / 50) + i % 17 / 10 + 5, None, 2 / 27, {}
    y = v[:26].mean()
    for j in range(26, n):
        y += (v[j] - y) * k
        if (j + 1) % 99_991 == 0 or j + 1 == n:
            want[j + 1] = y
    assert {r["nth"] for r in got} == set(want) and all(abs(r["y"] - want[r["nth"]]) < 1e-9 for r in got)
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_smoothing_has_its_bounds():
    with pytest.raises(ValueError):
        indicators.full(None, 0)


def test_medians_by_brackets(spark):
    rng = random.Random(8)
    groups = {"odd": [rng.gauss(0, 1) for _ in range(4001)], "even": [rng.gauss(5, 2) for _ in range(20_000)], "ties": [float(rng.randrange(3)) for _ in range(5000)], "two": [1.0, 2.0], "one": [7.0], "nulls": [None, 3.0, None, 5.0, 9.0], None: [4.0, 4.0, 5.0], "same": [2.0] * 3000, "none": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["median"], r["n"]) for r in anomaly.exact_median(df, "v", "g").collect()}
    want = {g: (statistics.median(w), len(w)) for g, vs in groups.items() if (w := [v for v in vs if v is not None])}
    assert got == want
    z = {}
    for r in anomaly.robust_z(df, "v", "g").collect():
        z.setdefault(r["g"], []).append((r["v"], r["mad"], r["z"]))
    assert sum(map(len, z.values())) == len(rows)
    for g, (median, _) in want.items():
        mad = statistics.median(abs(v - median) for v in groups[g] if v is not None)
        for v, m, s in z[g]:
            assert m == mad and (s is None if mad == 0 or v is None else abs(s - (v - median) / (1.4826 * mad)) < 1e-12)
    plan = anomaly.robust_z(df, "v", "g")._jdf.queryExecution().toString()
    assert "percentile(" not in plan.replace("approx_percentile(", "")
