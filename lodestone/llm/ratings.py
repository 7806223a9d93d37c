"""Ordinal regression on graded ratings: hashed text weights shared by all grades, and ordered thresholds between them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .fitting import minimise, sampled, total

BITS = 18
#: Rated documents of each grade, about, that a model is fitted on: the classifier's documented sample.
SAMPLE = 2500
SHAPES = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def shape(word: str) -> str:
    """A word's character classes, runs of one class as one character: letters x and X, digits 9, others themselves."""
    out: list[str] = []
    for c in word.translate(SHAPES):
        c = "x" if c.isalpha() and c not in "xX" else c
        if out[-1:] != [c]:
            out.append(c)
    return "".join(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature, value) of whole texts: words, their shapes, and steps of length and of variety.

    Values are square roots of a feature's share of the document's words, so that each document has length about 1.
    """
    split = [t.split() for t in texts]
    doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
    ids, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    lower = np.array([bucket("w:" + w.lower()) for w in words], dtype=np.int64)
    shapes = np.array([bucket("s:" + shape(w)) for w in words], dtype=np.int64)
    n = np.bincount(doc, minlength=len(texts))
    key, tf = np.unique(np.concatenate([doc << BITS | lower[ids], doc << BITS | shapes[ids]]), return_counts=True) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    d, f = key >> BITS, key & ((1 << BITS) - 1)
    kinds = np.bincount(np.unique(doc * np.int64(len(words) + 1) + ids) // (len(words) + 1), minlength=len(texts)) if len(ids) else np.zeros(len(texts))
    steps = [(bucket(f"n:{int(np.log2(k + 1))}"), bucket(f"v:{int(10 * u / max(k, 1))}")) for k, u in zip(n.tolist(), kinds.tolist(), strict=True)]
    steps = np.array(steps, dtype=np.int64).reshape(-1, 2)
    every = np.arange(len(texts))
    return np.concatenate([d, every, every]), np.concatenate([f, steps[:, 0], steps[:, 1]]), np.concatenate([np.sqrt(tf / np.maximum(n[d], 1)), np.full(2 * len(texts), 0.5)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Ordinal:
    """P(grade > grades[k]) = sigmoid(weights . x - thresholds[k]), thresholds in ascending order."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(np.bincount(doc, weights=self.weights[feature] * value, minlength=n)[:, None] - self.thresholds)


RIDGE = 2e-5


def part(batch: pa.RecordBatch, x: np.ndarray, place: np.ndarray, kinds: int) -> tuple[float, np.ndarray]:
    """Weighted negative log likelihood of a batch (y, weight, f, v), and its gradient.

    ``x``: the weights, the first threshold, and the logarithms of the steps to the others. ``place``: of each hashed
    feature, its place in ``x``.
    """
    y, weight = batch["y"].to_numpy(), batch["weight"].to_numpy()
    n, k, d = len(y), kinds, len(x) - kinds + 1
    doc = np.repeat(np.arange(n), pc.list_value_length(batch["f"]).to_numpy())
    f, value = place[batch["f"].flatten().to_numpy()], batch["v"].flatten().to_numpy().astype(float)
    t = x[d:]
    cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    z = np.bincount(doc, weights=x[f] * value, minlength=n)
    tail = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - cuts), np.zeros((n, 1))], axis=1)
    upper, under = tail[np.arange(n), y], tail[np.arange(n), y + 1]
    p = np.maximum(upper - under, 1e-12)
    du, dv = upper * (1 - upper), under * (1 - under)  # 0 at both ends
    gz = -(du - dv) / p * weight
    gc = np.zeros(k - 1)
    np.add.at(gc, np.maximum(y - 1, 0), np.where(y > 0, du / p, 0) * weight)
    np.add.at(gc, np.minimum(y, k - 2), -np.where(y < k - 1, dv / p, 0) * weight)
    gt = np.cumsum(gc[::-1])[::-1] * np.concatenate([[1.0], np.exp(t[1:])])
    return float(-np.log(p) @ weight), np.concatenate([np.bincount(f, weights=gz[doc] * value, minlength=d), gt])


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, holdout: int = 5) -> Ordinal:
    """A model of ``ratings`` (doc_id, grade) whose crc32(doc_id as text) mod ``holdout`` is not 0, on whole texts.

    About ``sample`` documents of each grade are taken (by a hash of their id, at the rate sample / count), weighted by
    the inverse of the rate, and saved as hashed features. Tasks sum the gradients; the driver gets one vector of the
    weights from each partition in a step. Null grades and texts are left out; a document with several grades counts
    with each. Ratings of fewer than two grades give a model that always tells the one there is (0 if none) and keeps
    every row.
    """
    rows = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", holdout) != 0)).select("doc_id", "grade")
    many = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a grade
    grades = sorted(many)
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(1 << BITS), np.zeros(0))
    lookup = lambda x: F.create_map(*[F.lit(v) for g in grades for v in (g, x[g])])[F.col("grade")]
    rate = lookup({g: min(1.0, sample / many[g]) for g in grades})
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("ratings"), "doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    # a bounded sample, so it may be broadcast
    met = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    met = met.select("doc_id", "text", lookup({g: i for i, g in enumerate(grades)}).alias("y"), (1 / rate).alias("weight"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                own = batch.slice(i, 64)
                doc, f, v = features(own["text"].to_pylist())
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(np.bincount(doc, minlength=len(own)))[:-1]
                lists = [pa.array(np.split(x[order].astype(t), ends), pa.list_(k)) for x, t, k in ((f, np.int32, pa.int32()), (v, np.float32, pa.float32()))]
                yield pa.RecordBatch.from_arrays([own["y"], own["weight"], *lists], names=["y", "weight", "f", "v"])

    taken = sampled(met, F.col("doc_id"), encode, "y int, weight double, f array<int>, v array<float>", "graded-sample")
    seen = {r["y"]: r["w"] for r in taken.groupBy("y").agg(F.sum("weight").alias("w")).collect()}  # one row a grade
    if not seen:
        return Ordinal(grades[:1], np.zeros(1 << BITS), np.zeros(0))
    used = np.sort(taken.select(F.explode("f").alias("f")).distinct().toArrow()["f"].to_numpy())  # 2 ** BITS at most
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(len(used))
    places, k, weight = docs.sparkSession.sparkContext.broadcast(place), len(grades), sum(seen.values())
    share = np.array([sum(w for y, w in seen.items() if y >= j) / weight for j in range(1, k)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    start = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = total(taken, lambda batch, at: part(batch, at, places.value, k), x)
        penalty = np.concatenate([RIDGE * x[: len(used)], np.zeros(k - 1)])
        return value / weight + 0.5 * (penalty @ x), grad / weight + penalty

    x = minimise(loss, start)
    weights = np.zeros(1 << BITS)
    weights[used] = x[: len(used)]
    return Ordinal(grades, weights, np.cumsum(np.concatenate([x[len(used)], np.exp(x[len(used) + 1 :])], axis=None)))


def grade(docs: DataFrame, model: Ordinal, *keep: str, at_least: int | None = None, odds: float = 0.5) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with expected_grade, tails (array<double>: P(grade > each but the last)) and kept.

    kept: the probability of the grade ``at_least`` (the second one unless given) or better is ``odds`` or more. Null and
    empty texts are graded by their length alone. Repeated rows are graded each; a
    column to keep that has a result's name gives way to the result; an empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in ("expected_grade", "tails", "kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cut = model.grades.index(at_least) - 1 if at_least is not None else 0

    @F.pandas_udf("expected_grade double, tails array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        steps = np.diff(m.grades)
        for t in texts:
            t = t.fillna("").to_numpy()
            heavy = np.cumsum([len(x) for x in t]) // 4_000_000 if len(t) else np.zeros(0, int)
            out = [pd.DataFrame({"expected_grade": pd.Series(dtype=float), "tails": pd.Series(dtype=object)})]
            for part in np.unique(heavy):  # a few MB of text at a time
                own = list(t[heavy == part])
                tails = m.tails(*features(own), len(own))
                out.append(pd.DataFrame({"expected_grade": m.grades[0] + tails @ steps, "tails": list(tails)}))
            yield pd.concat(out[1:] or out)

    found = docs.select(*keep, of("text").alias("__g"))
    return found.select(*keep, "__g.expected_grade", "__g.tails", F.coalesce(F.get("__g.tails", F.lit(cut)) >= odds, F.lit(True)).alias("kept"))
