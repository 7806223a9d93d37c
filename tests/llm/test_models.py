"""Models against naive ones: gradients by differences, Kneser-Ney probabilities by their formula."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa

from lodestone.llm import fitting, langid, ratings, toxicity


def differences(f, x, h=1e-5):
    return np.array([(f(x + h * e)[0] - f(x - h * e)[0]) / (2 * h) for e in np.eye(len(x))])


def test_noisy_or_against_the_formula():
    texts = ["Bad words here. Good day! moron again", "fine and calm. all good", "moron. moron words", "", "calm day"]
    y, weight = np.array([1, 0, 1, 0, 0]), np.array([1.0, 2.0, 1.0, 1.0, 3.0])
    pairs = toxicity.encoded(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(weight), pa.array([s for s, _ in pairs], pa.list_(pa.int32())), pa.array([f.ravel() for _, f in pairs], pa.list_(pa.int32()))], names=["toxic", "weight", "s", "f"])
    used = np.unique(np.concatenate([f.ravel() for _, f in pairs]))
    used = used[used > 0]
    place = np.full(1 << toxicity.BITS, len(used), dtype=np.int32)
    place[used] = np.arange(len(used))
    rng = np.random.default_rng(1)
    x = rng.normal(size=len(used) + 1)
    loss, grad = toxicity.part(batch, x, place)
    # the formula: 1 - product of (1 - sigmoid) over sentences
    weights = np.zeros(1 << toxicity.BITS)
    weights[used] = x[:-1]
    want = 0.0
    for t, label, w in zip(texts, y, weight):
        keep = 1.0
        for sentence in [p for p in __import__("re").split(r"[.!?\n]", t.lower()) if p.split()]:
            z = x[-1] + sum(weights[i] for word in sentence.split() for i in toxicity.features([word])[0] if i)
            keep *= 1 - 1 / (1 + math.exp(-z))
        want -= w * math.log(1 - keep if label else keep)
    assert abs(loss - want) < 1e-9
    assert np.allclose(grad, differences(lambda v: toxicity.part(batch, v, place), x), atol=1e-4)
    model = toxicity.NoisyOr(weights, float(x[-1]))
    assert np.allclose(-np.log(np.where(y == 1, model.scores(texts)[0], 1 - model.scores(texts)[0])) @ weight, want)


def test_ordinal_likelihood_against_the_formula():
    texts = ["one two three", "two two", "three $$$ one", "four", "", "one four"]
    y, weight = np.array([0, 1, 2, 1, 2, 0]), np.array([1.0, 2.0, 1.0, 0.5, 1.0, 3.0])
    doc, f, v = ratings.features(texts)
    rows = [(f[doc == i].astype(np.int32), v[doc == i].astype(np.float32)) for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(weight), pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.list_(pa.float32()))], names=["y", "weight", "f", "v"])
    used = np.unique(f)
    place = np.zeros(1 << ratings.BITS, dtype=np.int32)
    place[used] = np.arange(len(used))
    x = np.random.default_rng(2).normal(size=len(used) + 2)
    loss, grad = ratings.part(batch, x, place, 3)
    cuts = [x[-2], x[-2] + math.exp(x[-1])]
    want = 0.0
    for i in range(len(texts)):
        z = sum(x[place[a]] * float(b) for a, b in zip(*rows[i]))
        tails = [1.0, *[1 / (1 + math.exp(c - z)) for c in cuts], 0.0]
        want -= weight[i] * math.log(tails[y[i]] - tails[y[i] + 1])
    assert abs(loss - want) < 1e-6
    assert np.allclose(grad, differences(lambda v: ratings.part(batch, v, place, 3), x), atol=1e-4)


def test_descent_ends_at_the_minimum():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    b = np.array([1.0, -2.0, 3.0])
    x = fitting.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(3), rounds=200, enough=1e-14)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4)


def test_kneser_ney_against_the_formula():
    rng = random.Random(4)
    texts = {"a": ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(60)], "b": ["".join(rng.choice("cdef") for _ in range(rng.randint(1, 6))) for _ in range(50)]}
    frames = []
    for lang, words in texts.items():
        key, _ = langid.grams(np.array(words, dtype=object))
        keys, n = np.unique(key, return_counts=True)
        frames.append(pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n}))
    langs = ["a", "b"]
    tables, backs = langid.kneser_ney(pd.concat(frames), langs)
    model = langid.Models(langs, tables, backs, 1.0, np.zeros((2, langid.LENGTHS)))
    alphabet = 1 + len({c for words in texts.values() for w in words for c in w + " "})

    def naive(lang):
        full = Counter(("   " + w + " ")[i : i + 4] for w in texts[lang] for i in range(len(w) + 1))
        levels = {4: full}
        for n in (3, 2, 1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])  # how many characters stand before it
        discounts = {}
        for n, c in levels.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            discounts[n] = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        context = {n: defaultdict(lambda: [0, 0]) for n in levels}
        for n, c in levels.items():
            for g, v in c.items():
                context[n][g[:-1]][0] += v
                context[n][g[:-1]][1] += 1

        def p(g):
            n = len(g)
            if n == 0:
                return 1 / alphabet
            total, kinds = context[n][g[:-1]] if g[:-1] in context[n] else (0, 0)
            lower = p(g[1:]) if n > 1 else 1 / alphabet
            return lower if not total else max(levels[n][g] - discounts[n], 0) / total + discounts[n] * kinds / total * lower

        return p

    symbols = sorted({c for words in texts.values() for w in words for c in w + " "}) + ["￿"]
    for j, lang in enumerate(langs):
        p = naive(lang)
        for h in ("   ", "  a", "abc", "cde", "zzz", " dc", "fed"):
            key = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(h + s)) for s in symbols], dtype=np.uint64)
            got = 2 ** model.look(key)[:, j]
            assert np.allclose(got, [p(h + s) if s != "￿" else p(h + s) for s in symbols], rtol=1e-9)
            # over all symbols and an unseen one, probabilities add to 1
            assert abs(got.sum() - 1) < 1e-9


def test_saved_tables_can_be_released(spark):
    import glob

    from lodestone.llm import common

    kept = common.saved(spark.range(5), "some")
    assert kept.count() == 5
    where = common.run_dir(spark).removeprefix("file:")
    assert glob.glob(f"{where}/some-*")
    common.release(spark)
    assert not glob.glob(f"{where}/*")
    assert common.saved(spark.range(3), "some").count() == 3


def test_pieces_are_found_by_slot_and_verdicts_may_share_one(monkeypatch):
    import numpy as np

    from lodestone.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 1)  # two slots for all pairs
    model = pieces.Pieces([("<unk>", 0.0, 2), *[(c, -1.0, 1) for c in "abcdé中"], ("ab", -2.0, 1), ("abc", -3.0, 1), ("cd", -4.0, 1)], True)
    keys = np.array([left << 20 | right for left in range(1, 10) for right in range(1, 10)] * 2, dtype=np.int64)
    for _ in range(2):
        assert model.told(keys).tolist() == [model.merges(k) for k in keys.tolist()]
    sizes = np.array([3, 2, 1])
    own = np.array([[model.hash(w) + n for w in ws] for n, ws in zip(sizes.tolist(), [["abc", "bcd"], ["cd", "bd"], ["中", "x"]], strict=True)], dtype=np.uint64)
    assert [(int(r), int(w), model.texts[i]) for r, w, i in zip(*model.found(own, sizes), strict=True)] == [(0, 0, "abc"), (1, 0, "cd"), (2, 0, "中")]
