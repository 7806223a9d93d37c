"""Language identification: interpolated Kneser-Ney character models, one a language, in sorted arrays of n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 4
#: Documents of each language, about, that a model is fitted on: the classifier's documented sample.
SAMPLE = 1500
#: Characters at most in a word that is scored; longer ones are cut into words.
LONGEST = 40
#: Limits go by length: a column for each power of two of scored characters, up to 2 ** (LENGTHS - 1) and more.
LENGTHS = 15
#: Entropies of a language's own texts up to this quantile are its normal ones, those of unlearned languages from the other.
OWN, FOREIGN = 0.99, 0.05
#: Calibration texts of a language and length that a quantile of their own needs; else those of all languages are pooled.
LEAST = 50


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word) of each word of letters in the texts, lower-cased, and the distinct words."""
    found = [LETTERS.findall(t.lower()) for t in texts]
    doc = np.repeat(np.arange(len(found)), [len(w) for w in found])
    ids, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    return doc, ids, words


def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams that end at each letter and at the end of each word, and the word each belongs to.

    Four code points of 16 bits make a key; characters beyond U+FFFF are one symbol. Contexts start anew at each word.
    """
    cut = [w if len(w) <= LONGEST else " ".join(w[i : i + LONGEST] for i in range(0, len(w), LONGEST)) for w in words]
    text = "".join(" " * (ORDER - 1) + w + " " for w in cut)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    code[code > 0xFFFF] = 0xFFFF
    owner = np.repeat(np.arange(len(cut)), [len(w) + ORDER for w in cut])
    key = np.zeros(len(code), dtype=np.uint64)
    for back in range(ORDER):
        key[back:] |= code[: len(code) - back] << np.uint64(16 * back)
    ends = np.ones(len(code), dtype=bool)
    at = np.concatenate([[0], np.cumsum([len(w) + ORDER for w in cut])[:-1]]).astype(int) if len(cut) else np.zeros(0, int)
    for i in range(ORDER - 1):
        ends[at + i] = False
    return key[ends], owner[ends]


@dataclass
class Models:
    """tables[n]: sorted keys of n-grams and a row of log2 probabilities a language; backs[n]: the same of contexts."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    backs: dict[int, tuple[np.ndarray, np.ndarray]]
    beta: float
    limit: np.ndarray  # a row a language, a column a length

    def look(self, key: np.ndarray, n: int = ORDER) -> np.ndarray:
        """log2 probability of each n-gram's last character after the others, a column a language."""
        keys, rows = self.tables[n]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = rows[at].copy()
        if len(miss := np.nonzero(keys[at] != key)[0]):
            if n == 1:
                out[miss] = self.backs[1][1][0]
            else:
                contexts, weight = self.backs[n]
                c = key[miss] >> np.uint64(16)
                at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
                known = (contexts[at] == c)[:, None]
                out[miss] = self.look(key[miss] & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) + np.where(known, weight[at], 0.0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text under each language, and how many characters were scored."""
        doc, ids, words = words_of(texts)
        n, langs = len(texts), len(self.langs)
        if not len(words):
            return np.zeros((n, langs)), np.zeros(n)
        bits, chars = np.zeros((len(words), langs)), np.zeros(len(words))
        for i in range(0, len(words), 50_000):
            key, owner = grams(words[i : i + 50_000])
            p, size = self.look(key), min(50_000, len(words) - i)
            chars[i : i + size] = np.bincount(owner, minlength=size)
            for k in range(langs):
                bits[i : i + size, k] = np.bincount(owner, weights=p[:, k], minlength=size)
        length = np.bincount(doc, weights=chars[ids], minlength=n)
        total = np.stack([np.bincount(doc, weights=bits[ids, k], minlength=n) for k in range(langs)], axis=1)
        return -total / np.maximum(length, 1)[:, None], length

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its best language's index (-1 if it has no letter), score, bits a character, rejected."""
        if not self.langs:
            n = len(texts)
            return np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
        h, length = self.entropies(texts)
        best = h.argmin(axis=1)
        e = np.exp(-self.beta * (h - h.min(axis=1, keepdims=True)))
        low = h[np.arange(len(h)), best]
        und = length == 0
        return np.where(und, -1, best), np.where(und, 0.0, 1 / e.sum(axis=1)), np.where(und, np.nan, low), und | (low > self.limit[best, size_of(length)])


def size_of(length: np.ndarray) -> np.ndarray:
    """Column of the limits for texts of so many scored characters."""
    return np.clip(np.rint(np.log2(np.maximum(length, 1))), 0, LENGTHS - 1).astype(int)


def cuts(text: str) -> list[str]:
    """The text, and its beginnings of about 1, 2, 4 ... scored characters in whole words."""
    words = LETTERS.findall(text.lower())
    ends = np.cumsum([len(w) + 1 for w in words])
    upto = np.unique(np.searchsorted(ends, 2.0 ** np.arange(LENGTHS)) + 1)
    return [text, *[" ".join(words[:n]) for n in upto if n < len(words)]]


def limits(h: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Largest entropy that passes, by language and length, from entropies of calibration texts ``y`` and their beginnings.

    The OWN quantile of a language's texts of a length, plus half of what unlearned languages are beyond it: each
    language in turn counts as unlearned, its texts score under the best of the others, and the nearest language's
    FOREIGN quantile is taken. With one language alone the quantile's distance from the median stands for that half.
    Lengths without texts take the next shorter one's limit, or else the next longer one's; none is stricter than a longer one.
    """
    langs, size = h.shape[1], size_of(length)
    own = h[np.arange(len(h)), y]
    all_typical = np.median(own)
    typical = np.array([np.median(own[y == i]) if (y == i).any() else all_typical for i in range(langs)])
    best = np.where(np.arange(langs) == y[:, None], np.inf, h).argmin(axis=1)
    away = h[np.arange(len(h)), best]
    out = np.full((langs, LENGTHS), np.nan)
    for b in range(LENGTHS):
        at = size == b
        if not at.any():
            continue
        pooled = np.quantile((own - typical[y])[at], OWN)
        high = np.array([np.quantile(own[at & (y == i)], OWN) if (at & (y == i)).sum() >= LEAST else typical[i] + pooled for i in range(langs)])
        if langs > 1:
            margin = max(0.0, min(np.quantile((away - high[best])[at & (y == i)], FOREIGN) for i in np.unique(y[at]))) / 2
        else:
            margin = high - np.minimum(high, typical)
        out[:, b] = high + margin
    have = np.nonzero(~np.isnan(out[0]))[0]
    out = out[:, have[np.maximum(np.searchsorted(have, np.arange(LENGTHS), side="right") - 1, 0)]]
    return np.maximum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def kneser_ney(counts: pd.DataFrame, langs: list[str]) -> tuple[dict, dict]:
    """Tables of interpolated Kneser-Ney models from counts of ORDER-grams (lang, key, n)."""
    tables, backs = {}, {}
    of = {lang: counts[counts["lang"] == lang] for lang in langs}
    level = {lang: (c["key"].to_numpy().view(np.uint64), c["n"].to_numpy(dtype=float)) for lang, c in of.items()}
    alphabet = 1 + max(1, len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in level.values()]))))
    per = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before an n-gram
        per[n] = {lang: tuple(x.astype(t) for x, t in zip(np.unique(k & np.uint64((1 << 16 * n) - 1), return_counts=True), (np.uint64, float), strict=True)) for lang, (k, _) in per[n + 1].items()}
    lower = None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in per[n].values()]))
        contexts = np.unique(keys >> np.uint64(16))
        inner = np.searchsorted(contexts, keys >> np.uint64(16))
        rows, weights = np.empty((len(keys), len(langs))), np.empty((len(contexts), len(langs)))
        for j, lang in enumerate(langs):
            k, c = per[n][lang]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            full = np.zeros(len(keys))
            full[np.searchsorted(keys, k)] = c
            total = np.bincount(inner, weights=full, minlength=len(contexts))
            kinds = np.bincount(inner, weights=full > 0, minlength=len(contexts))
            weights[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
            if n == 1:
                base = np.full(len(keys), 1 / alphabet)
            else:
                base = 2 ** lower(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)[:, j]
            rows[:, j] = np.log2(np.maximum(full - d, 0) / np.maximum(total, 1e-9)[inner] + weights[inner, j] * base)
        tables[n], backs[n] = (keys, rows), (contexts, np.log2(weights))
        if n == 1:
            backs[1] = (contexts, np.log2(weights / alphabet))
        lower = Models(langs, tables, backs, 1.0, np.zeros(len(langs))).look
    return tables, backs


def fit(docs: DataFrame, sample: int = SAMPLE, holdout: int = 3) -> Models:
    """Models from the ``text`` and non-null ``lang`` of documents whose crc32(doc_id as text) mod ``holdout`` is not 1.

    About ``sample`` whole documents of each language are taken (by a hash of their id, at the rate sample / count), so
    what the driver gathers is bounded; their n-grams are counted by Spark. A fifth of them is left out of the counts
    and calibrates: ``beta`` (a grid of powers of two, by likelihood) makes scores of entropies, and a document is
    rejected beyond its best language's limit for its length (``limits``). Where no language has 50 documents none is
    left out, and only texts without a letter are rejected. Without any labelled document with a letter the models
    have no language, and every text is ``und``.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", holdout) != 1)).select("lang", "text", F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)).alias("u"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(many)
    none = Models([], {}, {}, 1.0, np.zeros((0, LENGTHS)))
    if not langs:
        return none
    rate = spark.createDataFrame([(x, int(1_000_000 * min(1, sample / many[x]))) for x in langs], "lang string, __rate int")
    chosen = rows.join(F.broadcast(rate), "lang").where(F.col("u") < F.col("__rate"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "u"), F.lit(5)) if max(many.values()) >= 50 else F.lit(1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                doc, ids, words = words_of(list(part["text"]))
                if len(words):
                    key, owner = grams(words)
                    keys, back = np.unique(key, return_inverse=True)
                    n = np.bincount(back, weights=np.bincount(ids, minlength=len(words))[owner])
                    yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n.astype(np.int64)})

    counts = chosen.where(fold != 0).select("lang", "text").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if not len(counts):
        return none
    tables, backs = kneser_ney(counts, langs)
    models = Models(langs, tables, backs, 1.0, np.full((len(langs), LENGTHS), np.inf))
    shared = spark.sparkContext.broadcast(models)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [cuts(t) for t in b["text"]]
            h, length = shared.value.entropies([c for p in parts for c in p])
            whole = np.concatenate([np.arange(len(p)) == 0 for p in parts])
            yield pd.DataFrame({"lang": np.repeat(b["lang"].to_numpy(), [len(p) for p in parts]), "h": list(h), "length": length, "whole": whole})

    seen = chosen.where(fold == 0).select("lang", "text").mapInPandas(measure, "lang string, h array<double>, length double, whole boolean").where("length > 0").toArrow().to_pandas()
    if len(seen):
        every, y = np.stack(seen["h"].to_list()), seen["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        models.limit = limits(every, y, seen["length"].to_numpy())
        whole = seen["whole"].to_numpy()
        h, y = every[whole], y[whole]
        best = -np.inf
        for beta in 2.0 ** np.arange(-2, 7):
            z = -beta * h
            fitness = (z[np.arange(len(z)), y] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1)).sum()
            if fitness > best:
                best, models.beta = fitness, float(beta)
    return models


def identify(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with lang_pred, score, cross_entropy and rejected.

    The language of lowest cross-entropy for a character of the whole text. ``und`` with score 0 and rejected where the
    text is null or has no letter. A tie goes to the first language in code point order. Text of 1 letter or of
    millions is scored alike; words over 40 letters are scored in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for t in texts:
            t = t.fillna("").to_numpy()
            out = []
            size = np.cumsum([len(x) for x in t]) // 4_000_000 if len(t) else np.zeros(0, int)
            for part in np.unique(size):  # a few MB of text at a time
                best, score, h, rejected = m.decide(list(t[size == part]))
                out.append(pd.DataFrame({"lang_pred": names[best], "score": score, "cross_entropy": h, "rejected": rejected}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": [], "score": [], "cross_entropy": [], "rejected": []})

    return docs.select(*keep, of("text").alias("__lid")).select(*keep, "__lid.lang_pred", "__lid.score", "__lid.cross_entropy", "__lid.rejected")
