"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from labels of documents."""

from __future__ import annotations

import re
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

BITS = 20
#: Lengths of the word beginnings that are features beside the whole word: they tell rare words of one stem.
STEMS = (2, 3, 4, 5)
#: Labelled documents of each label, about, that a model is fitted on: the classifier's documented sample.
SAMPLE = 4000
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
ENDS = (".", "!", "?", "\n")


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: itself and its beginnings; a word that is no longer than one has bucket 0 for it."""
    code = lambda x: max(1, zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS))
    out = np.zeros((len(words), 1 + len(STEMS)), dtype=np.int32)
    out[:, 0] = np.fromiter((code("=" + w) for w in words), dtype=np.int32, count=len(words))
    for i, k in enumerate(STEMS, 1):
        out[:, i] = np.fromiter((code(w[:k]) if len(w) > k else 0 for w in words), dtype=np.int32, count=len(words))
    return out


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each sentence, sentence of each word, place in the last, distinct words).

    Sentences are numbered in a row over all texts, those without words left out.
    """
    found = [TOKEN.findall(t.lower()) for t in texts]
    ids, tokens = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    doc = np.repeat(np.arange(len(found)), [len(w) for w in found])
    end = np.array([t in ENDS for t in tokens], dtype=bool)[ids] if len(ids) else np.zeros(0, bool)
    place = np.cumsum(end) + doc  # a new number after each end and for each document
    kept, sentence = np.unique(place[~end], return_inverse=True)
    of = np.zeros(len(kept), dtype=np.int64)
    of[sentence] = doc[~end]
    return of, sentence, ids[~end], tokens


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class NoisyOr:
    """A sentence's score is sigmoid(bias + its words' weights); a document's is 1 - product of (1 - score)."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its score, its worst sentence's number (-1: none) among those with words, and that one's score."""
        of, sentence, ids, words = sentences(texts)
        z = self.bias + np.bincount(sentence, weights=self.weights[features(words)].sum(axis=1)[ids], minlength=len(of))
        total = np.bincount(of, weights=softplus(z), minlength=len(texts))
        worst, best = np.full(len(texts), -1), np.full(len(texts), -np.inf)
        np.maximum.at(best, of, z)
        first = np.searchsorted(of, np.arange(len(texts)))
        at = np.nonzero(z == best[of])[0][::-1]
        worst[of[at]] = at - first[of[at]]
        return -np.expm1(-total), worst, np.exp(-softplus(-best))


RIDGE = 3e-5


def encoded(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its words' sentences and the hashed features of each word (one row a word)."""
    out = []
    for t in texts:
        _, sentence, ids, words = sentences([t])
        out.append((sentence.astype(np.int32), features(list(words))[ids] if len(ids) else np.zeros((0, 1 + len(STEMS)), np.int32)))
    return out


def part(batch: pa.RecordBatch, x: np.ndarray, place: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss of noisy-or over a batch (toxic, weight, s, f), and its gradient. ``x``: weights, then the bias.

    ``place``: of each hashed feature, its place in ``x``, or that of the bias for one that has no weight.
    """
    y, weight = batch["toxic"].to_numpy(), batch["weight"].to_numpy()
    words = pc.list_value_length(batch["s"]).to_numpy()
    sentence = batch["s"].flatten().to_numpy().astype(np.int64)
    column = place[batch["f"].flatten().to_numpy()].reshape(-1, 1 + len(STEMS))
    doc = np.repeat(np.arange(len(y)), words)
    n = np.zeros(len(y), dtype=np.int64)
    np.maximum.at(n, doc, sentence + 1)
    sentence = sentence + (np.cumsum(n) - n)[doc]
    of = np.repeat(np.arange(len(y)), n)
    w = np.append(x[:-1], 0.0)
    z = x[-1] + np.bincount(sentence, weights=w[column].sum(axis=1), minlength=len(of))
    s = np.bincount(of, weights=softplus(z), minlength=len(y))
    loss = np.where(y == 1, -np.log(np.maximum(-np.expm1(-s), 1e-12)), s) @ weight
    g = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-12), 1.0) * weight
    gz = g[of] * np.exp(-softplus(-z))
    grad = np.bincount(column.ravel(), weights=np.repeat(gz[sentence], column.shape[1]), minlength=len(x))
    grad[-1] = gz.sum()
    return float(loss), grad


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, holdout: int = 5) -> NoisyOr:
    """A model from ``labels`` (doc_id, toxic 0/1) whose crc32(doc_id as text) mod ``holdout`` is not 0, on whole texts.

    About ``sample`` documents of each label are taken (by a hash of their id, at the rate sample / count), weighted by
    the inverse of the rate, and saved as hashed features. Tasks sum the gradients; the driver gets one vector of the
    weights from each partition in a step. Features of under 5 documents (of fewer in small samples) have no weight.
    Null labels and texts are left out; a document with several labels counts with each. Labels of one kind alone give a
    model that always tells that label, no labels one that tells 0.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", holdout) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    one = NoisyOr(np.zeros(1 << BITS), 40.0 if set(many) == {1} else -40.0)
    if len(many) < 2:
        return one
    rate = {k: min(1.0, sample / many[k]) for k in many}
    of = lambda x: F.when(F.col("toxic") == 1, x[1]).otherwise(x[0])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < of(rate) * 1_000_000)
    # a bounded sample, so it may be broadcast
    met = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("weight", 1 / of(rate))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                own = batch.slice(i, 64)
                pairs = encoded(own["text"].to_pylist())
                lists = [pa.array([s for s, _ in pairs], pa.list_(pa.int32())), pa.array([f.ravel() for _, f in pairs], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([own["toxic"], own["weight"], *lists], names=["toxic", "weight", "s", "f"])

    taken = sampled(met, F.col("doc_id"), encode, "toxic int, weight double, s array<int>, f array<int>", "toxic-sample")
    sums = taken.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.coalesce(F.array_max("s") + 1, F.lit(0))).alias("sentences"))
    seen = {r["toxic"]: r for r in sums.collect()}  # two rows
    if len(seen) < 2:
        return one
    n = sum(r["n"] for r in seen.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for f in batch["f"]:
                times[np.unique(f.values.to_numpy())] += 1
        on = np.nonzero(times)[0]
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(times[on])], names=["f", "n"])

    often = taken.select("f").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).where((F.col("n") >= min(5, max(1, n // 50))) & (F.col("f") > 0))
    used = np.sort(often.select("f").toArrow()["f"].to_numpy())  # hashed features: 2 ** BITS at most
    place = np.full(1 << BITS, len(used), dtype=np.int32)
    place[used] = np.arange(len(used))
    places = docs.sparkSession.sparkContext.broadcast(place)
    weight = sum(r["w"] for r in seen.values())
    share = np.clip(seen[1]["w"] / weight, 1e-3, 0.999)
    start = np.append(np.zeros(len(used)), np.log(share * n / max(1, sum(r["sentences"] for r in seen.values()))))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = total(taken, lambda batch, at: part(batch, at, places.value), x)
        penalty = np.append(RIDGE * x[:-1], 0.0)
        return value / weight + 0.5 * (penalty @ x), grad / weight + penalty

    x = minimise(loss, start)
    weights = np.zeros(1 << BITS)
    weights[used] = x[:-1]
    return NoisyOr(weights, float(x[-1]))


def score(docs: DataFrame, model: NoisyOr, *keep: str, locate: bool = True) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with score, predicted, and the worst sentence with its score and offsets.

    score: 0 to 1 by noisy-or over all sentences of the whole text; predicted: 1 where it is 0.5 or more. worst_start
    and worst_end: code point offsets of the sentence that scores most, the first of equals. Null and empty texts and
    those without words score 0 and have no worst sentence (null). Repeated rows are scored each. A column to
    keep that has a result's name gives way to the result.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted", "worst_score", "worst_start", "worst_end"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, worst_score double, worst_start int, worst_end int")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for t in texts:
            t = t.fillna("").to_numpy()
            heavy = np.cumsum([len(x) for x in t]) // 4_000_000 if len(t) else np.zeros(0, int)
            out = []
            for part in np.unique(heavy):  # a few MB of text at a time
                own = list(t[heavy == part])
                total, worst, most = m.scores(own)
                spans = [span(x, k) if locate else (None, None) for x, k in zip(own, worst.tolist(), strict=True)]
                frame = pd.DataFrame({"score": total, "worst_score": np.where(worst >= 0, most, np.nan)})
                for i, c in enumerate(("worst_start", "worst_end")):
                    frame[c] = pd.array([s[i] for s in spans], dtype="Int32")
                out.append(frame)
            yield pd.concat(out) if out else pd.DataFrame({"score": [], "worst_score": [], "worst_start": pd.array([], dtype="Int32"), "worst_end": pd.array([], dtype="Int32")})

    found = docs.select(*keep, of("text").alias("__t"))
    none = F.col("__t.worst_start").isNull()
    return found.select(*keep, "__t.score", (F.col("__t.score") >= 0.5).cast("int").alias("predicted"), F.when(~none, F.col("__t.worst_score")).alias("worst_score"), "__t.worst_start", "__t.worst_end")


def span(text: str, nth: int) -> tuple[int | None, int | None]:
    """Offsets of the ``nth`` sentence with words."""
    if nth < 0:
        return None, None
    for m in SENTENCE.finditer(text):
        if re.search(r"[^\W_]", m[0]):
            if nth == 0:
                return m.start(), m.end()
            nth -= 1
    return None, None
