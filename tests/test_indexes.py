"""Stored indexes, mentions and shocks against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions import text
from lodestone.operators import graph, keyword_index, search, vector_index

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    out = {i: " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(40)], k=rng.choice([3, 10, 60, 200]))) for i in range(400)}
    return out | {500: None, 501: "", 502: "W1, w1! W2-w3", 503: "word " * 5000}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, text string").repartition(3)


def brute(docs, words, k, allowed=None):
    tf = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs.items()}
    idf = {w: math.log(1 + len(docs) / df) for w in set(words) if (df := sum(w in c for c in tf.values()))}
    scores = {i: round(sum((1 + math.log(c[w])) * idf[w] for w in idf if w in c), 6) for i, c in tf.items() if (allowed is None or i in allowed) and any(w in c for w in idf)}
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]


def found(index, spark, asked, k, allowed=None):
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, words array<string>")
    rows = keyword_index.search(index, questions, k, None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "key long")).collect()
    return [[(r["key"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(len(asked))]


def close(got, want):
    assert [[i for i, _ in g] for g in got] == [[i for i, _ in w] for w in want]
    assert all(abs(a[1] - b[1]) < 3e-6 for a, b in zip(itertools.chain(*got), itertools.chain(*want), strict=True))


def test_keyword_index_gives_what_a_scan_gives_and_leaves_blocks_out(spark, docs, tmp_path):
    index = keyword_index.Index(f"{tmp_path}/i", buckets=8, block=16)
    keyword_index.write(index, frame(spark, docs), "id", "text")
    asked = [["w30", "w1"], ["w0"], ["nothing"], ["w39", "W38", "w39"], ["word"], []]
    close(found(index, spark, asked, 5), [brute(docs, [w.lower() for w in a], 5) for a in asked])
    some = [i for i in docs if i % 3 == 0]
    close(found(index, spark, asked, 5, some), [brute(docs, [w.lower() for w in a], 5, set(some)) for a in asked])
    one = keyword_index.Asked(index, spark.createDataFrame([(0, ["w1", "w35"])], "query_id long, words array<string>"))
    plan = one.postings._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan
    marked = one.first(3)
    best = keyword_index.ranked(one.scores(marked.where("seed"), None), 3)
    assert marked.where("seed").count() + one.open(marked, best, 3).count() < marked.count() / 2


def test_keyword_index_segments(spark, docs, tmp_path):
    index = keyword_index.Index(f"{tmp_path}/i", buckets=8, block=16)
    keyword_index.write(index, frame(spark, docs), "id", "text")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    now = dict(docs)
    for n in range(2):
        new = {i: f"{WORDS[(i + n) % 40]} fresh " * 3 for i in range(n, 600, 7)}
        gone = [i for i in now if i % 11 == n and i not in new]
        keyword_index.update(index, frame(spark, new), "id", "text", spark.createDataFrame([(i,) for i in gone], "id long"))
        now = {i: t for i, t in now.items() if i not in gone} | new
        asked = [["w30", "w1"], ["fresh", "w3"], ["w0", "word"]]
        close(found(index, spark, asked, 7), [brute(now, a, 7) for a in asked])
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # files of earlier segments stay as they are
    to = keyword_index.Index(f"{tmp_path}/j", buckets=4, block=64)
    keyword_index.compact(index, spark, to)
    close(found(to, spark, asked, 7), [brute(now, a, 7) for a in asked])
    none = keyword_index.Index(f"{tmp_path}/k")
    keyword_index.write(none, frame(spark, docs).limit(0), "id", "text")
    assert found(none, spark, asked, 3) == [[], [], []]


def test_keyword_index_moves_texts_once(spark, docs, tmp_path, monkeypatch):
    """Terms are made where a block's texts are, and not stored before; rows of one key are one document of all their terms."""
    saved = []
    monkeypatch.setattr(keyword_index, "kept", lambda df, name, real=keyword_index.kept: (saved.append(df.schema.simpleString()), real(df, name))[1])
    index = keyword_index.Index(f"{tmp_path}/i", buckets=8, block=16)
    twice = frame(spark, docs).union(frame(spark, {3: "again w1 " * 70, 7: "Again w1"}))
    keyword_index.write(index, twice, "id", "text")
    assert not any("array" in s or "string" in s for s in saved)
    joined = docs | {3: f"{docs[3]} " + "again w1 " * 70, 7: f"{docs[7]} Again w1"}
    asked = [["again", "w1"], ["w30", "w1"]]
    close(found(index, spark, asked, 5), [brute(joined, a, 5) for a in asked])
    rows = index.postings(spark).groupBy("term").agg(keyword_index.F.sum("n"), keyword_index.F.sum("total")).collect()
    every = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in joined.items()}
    assert {r[0]: tuple(r)[1:] for r in rows} == {w: (sum(w in c for c in every.values()), sum(c[w] for c in every.values())) for c in every.values() for w in c}


def test_keyword_index_takes_texts_to_python_once(spark, docs, tmp_path, monkeypatch):
    """Blocks are dealt by sizes that Spark takes itself, postings are stored packed, and a task writes one bucket."""
    plans = []
    monkeypatch.setattr(keyword_index, "kept", lambda df, name, real=keyword_index.kept: (plans.append(df._jdf.queryExecution().toString()), real(df, name))[1])
    index = keyword_index.Index(f"{tmp_path}/i", buckets=2, block=16)
    keyword_index.write(index, frame(spark, docs), "id", "text")
    assert plans and not any("EvalPython" in p or "InArrow" in p for p in plans)
    assert not any("array" in kind for _, kind in index.postings(spark).dtypes)
    files = [p for p in (tmp_path / "i" / "postings").rglob("*.parquet") if p.parent.name == "bucket=0"]
    assert len(files) == keyword_index.SPLIT
    rows = index.postings(spark).select("n", "most", "total", keyword_index.unpacked("keys", "tfs").alias("e")).collect()
    assert all((r["n"], r["most"], r["total"]) == (len(r["e"]), max(x["tf"] for x in r["e"]), sum(x["tf"] for x in r["e"])) for r in rows)


def test_terms_end_with_their_text():
    """Neighbouring texts don't run together, and terms are what the regular expression finds."""
    texts = ["abc", "def", "", "", "é0x é", " ", "ab--", "日本1語z9", "", "a", "", "\u017fk\x00q"]
    for part in (pa.chunked_array([texts]), pa.chunked_array([texts[:4], texts[4:]], pa.string()), pa.chunked_array([pa.array(["zz", *texts]).slice(1)]), pa.chunked_array([["", ""]])):
        words, row = keyword_index.split(part)
        assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(part.to_pylist()) for w in re.findall(keyword_index.TERM, t)]


def test_many_questions_are_swept(spark, docs, tmp_path, monkeypatch):
    """Beyond LITERAL terms no row is made for a question and a block, and results stay those of brute force."""
    monkeypatch.setattr(keyword_index, "LITERAL", 3)
    monkeypatch.setattr(keyword_index, "PIECE", 5)
    monkeypatch.setattr(keyword_index, "CHUNK", 4)
    monkeypatch.setattr(keyword_index, "CELLS", 40)
    monkeypatch.setattr(keyword_index.Asked, "bounds", None)
    index = keyword_index.Index(f"{tmp_path}/i", buckets=8, block=16)
    keyword_index.write(index, frame(spark, docs), "id", "text")
    asked = [["w30", "w1"], ["w0"], ["nothing"], ["w39", "W38", "w39"], ["word"], [], ["w1", "w30"], ["w5", "w6", "w7", "w8"], ["w2"], ["w3", "w9"]]
    close(found(index, spark, asked, 5), [brute(docs, [w.lower() for w in a], 5) for a in asked])
    some = [i for i in docs if i % 3 == 0]
    close(found(index, spark, asked, 5, some), [brute(docs, [w.lower() for w in a], 5, set(some)) for a in asked])
    new = {i: f"{WORDS[i % 40]} fresh " * 3 for i in range(0, 600, 7)}
    keyword_index.update(index, frame(spark, new), "id", "text", spark.createDataFrame([(1,), (2,)], "id long"))
    now = {i: t for i, t in docs.items() if i not in (1, 2)} | new
    close(found(index, spark, asked, 5), [brute(now, [w.lower() for w in a], 5) for a in asked])
    close(found(index, spark, asked, 5, some), [brute(now, [w.lower() for w in a], 5, set(some)) for a in asked])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16))
    x = middle[rng.integers(0, 12, 900)] + 0.35 * rng.normal(size=(900, 16))
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 5) for i in range(900)]
    return [*rows, (1000, [0.0] * 16, 1), (1001, None, 1), (1002, [1.0, 2.0], 1), (1003, [float("nan")] * 16, 1), (1004, rows[0][1], 2), (1005, rows[0][1], 2)]


def nearest(vectors, k, where=lambda label: True):
    ok = [(i, np.array(v)) for i, v, label in vectors if v is not None and len(v) == 16 and np.isfinite(v).all() and where(label)]
    x, ids = np.array([v for _, v in ok]), [i for i, _ in ok]
    out = {}
    for i, v, _ in vectors:
        if i % 50 == 0 and i < 1000:
            cos = np.round((x @ np.array(v)) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(v), 1e-300), 6)
            out[i] = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-cos[j], ids[j]))[:k]]
    return out


def test_vector_index(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", 4)  # queries of a cell and its rows over several tasks
    monkeypatch.setattr(vector_index, "PIECE", 20)
    df = spark.createDataFrame(vectors, "id long, v array<float>, label int").repartition(3)
    index = vector_index.write(df, "id", "v", f"{tmp_path}/v", keep=("label",))
    assert sum(index.counts.values()) == 903 and index.counts[vector_index.NOWHERE] == 1
    asked = df.where("id % 50 = 0 and id < 1000").select(vector_index.F.col("id").alias("query_id"), vector_index.F.col("v").alias("query"))

    def rows(**how):
        out = {}
        for r in vector_index.search(index, asked, 10, **how).orderBy("rank").collect():
            out.setdefault(r["query_id"], []).append(r["key"])
        return out

    want = nearest(vectors, 10)
    assert rows(exact=True) == want and rows(exact=True, probes=1) == want
    near = rows()
    assert np.mean([len(set(near[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert vector_index.share_read(index, asked) < 0.5
    two = vector_index.F.col("label").isin(1, 3)
    assert rows(exact=True, where=two) == nearest(vectors, 10, lambda label: label in (1, 3))
    plan = index.rows(spark).where(two)._jdf.queryExecution().toString()
    assert "In(label" in plan
    empty = vector_index.write(df.limit(0), "id", "v", f"{tmp_path}/e", keep=("label",))
    assert vector_index.search(empty, asked, 3, exact=True).count() == 0


def test_mentions_of_many_surfaces(spark, monkeypatch):
    rng = random.Random(9)
    letters = "abcé_1 .\\E"
    names = sorted({("".join(rng.choices(letters, k=rng.randint(1, 4))), f"e{rng.randrange(60)}") for _ in range(3000)})
    names += [(f"name {i}", f"n{i}") for i in range(10_000)] + [("O.K. (Inc)", "ok"), ("name 1", "other")]
    texts = {i: "".join(rng.choices(letters, k=40)) for i in range(60)} | {100: "Name 17 and NAME 1778, name 9x", 101: None, 102: "we are o.k. (inc)orporated, o.k. (inc)!"}
    want = {}
    for key, t in texts.items():
        low = (t or "").lower()
        for s, e in names:
            if s.lower() in low:
                for at in (i for i in range(len(low)) if low.startswith(s.lower(), i)):
                    if re.compile(rf"\b{re.escape(s.lower())}\b").match(low, at):
                        want[key, e] = min(at, want.get((key, e), at))
    df, surfaces = frame(spark, texts), spark.createDataFrame(names, "surface string, entity string")
    got = lambda: {(r["id"], r["entity"]): r["first"] for r in text.mentions(df, "id", "text", surfaces).collect()}
    assert got() == want and (100, "n17") in want and (100, "other") not in want
    monkeypatch.setattr(text, "AUTOMATON", 60_000)
    assert got() == want
    assert text.mentions(df, "id", "text", surfaces.limit(0)).count() == 0
    plan = text.mentions(df, "id", "text", surfaces)._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no text is taken apart


def test_shocks_go_on_as_states(spark):
    """A lattice of many equal paths: rows of a hop grow with states, and results are those of all paths."""
    wide = 12
    rows = [(f"a{h}_{i}", f"a{h + 1}_{j}", "supplies", 1.0, 0.9) for h in range(3) for i in range(wide) for j in range(wide)]
    rows += [("o", f"a0_{i}", "supplies", 1.0, 0.8) for i in range(wide)] + [("a3_0", "c", "competes_with", 1.0, 0.9), ("c", "d", "supplies", 1.0, 0.9)]
    df = spark.createDataFrame(rows, "source string, target string, kind string, weight double, confidence double")
    got = {r["node"]: r for r in graph.propagate(df, "o", 1.0, 5).collect()}
    for h in range(4):
        for i in range(wide):
            assert got[f"a{h}_{i}"]["score"] == round(wide**h * 0.85 ** (h + 1), 4) and got[f"a{h}_{i}"]["confidence"] == 0.8
    assert got["c"]["score"] == round(-0.35 * wide**3 * 0.85**4, 4) and "d" not in got
    assert len(got["a3_0"]["paths"].split("; ")) == 3 and got["a3_0"]["paths"].startswith("o → ")
    hop = spark.createDataFrame([("n", 1, 0.5, 0.9, 2, ["p", "q"], True), ("n", 1, 0.5, 0.9, 5, ["a", "b", "z"], True), ("n", 1, 0.25, 0.9, 1, ["a"], True)], "node string, way int, score double, confidence double, n long, paths array<string>, on boolean")
    assert {(r["score"], r["n"], tuple(r["paths"])) for r in graph.states(hop).collect()} == {(0.5, 7, ("a", "b", "p")), (0.25, 1, ("a",))}


def test_scan_of_keywords_agrees(spark, docs):
    got = [(r["id"], r["score"]) for r in search.keyword_topk(frame(spark, docs), "id", "text", ["w30", "w1"], 6).collect()]
    close([got], [brute(docs, ["w30", "w1"], 6)])


def test_nearest_compares_in_tiles(spark, vectors, monkeypatch):
    """However many queries there are, a task compares TILE of them with TILE rows."""
    monkeypatch.setattr(search, "TILE", 7)
    seen = []
    monkeypatch.setattr(search, "better", lambda best, q, x, key, k, real=search.better: (seen.append((len(q), len(x))), real(best, q, x, key, k))[1])
    rows = [(i, v) for i, v, _ in vectors if v is not None]
    queries = [(i, v) for i, v in rows if i % 50 == 0 and i < 1000]
    batch = search.pa.RecordBatch.from_arrays([search.pa.array([i for i, _ in rows if i != 1003]), search.pa.array([v for i, v in rows if i != 1003])], names=["id", "v"])
    got = {}
    for out in search.nearest(iter([batch]), [i for i, _ in queries], [v for _, v in queries], 10):
        for r in sorted(out.to_pylist(), key=lambda r: (-r["similarity"], r["key"] if "key" in r else r["id"])):
            got.setdefault(r["query_id"], []).append(r["id"])
    assert got == nearest(vectors, 10) and max(map(max, seen)) == 7


def test_cells_are_probed_in_parts(spark, vectors, tmp_path, monkeypatch):
    """Matrices of rows and cells have a bounded size, whatever a batch holds."""
    monkeypatch.setattr(vector_index, "CELLS", 90)
    batch = search.pa.RecordBatch.from_arrays([search.pa.array(range(100))], names=["id"])
    parts = list(vector_index.slices(iter([batch, batch.slice(0, 0)]), 30))
    assert max(map(len, parts)) == 3 and sum(map(len, parts)) == 100
    df = spark.createDataFrame(vectors, "id long, v array<float>, label int").repartition(3)
    index = vector_index.write(df, "id", "v", f"{tmp_path}/v", keep=("label",))
    asked = df.where("id % 50 = 0 and id < 1000").select(vector_index.F.col("id").alias("query_id"), vector_index.F.col("v").alias("query"))
    got = {}
    for r in vector_index.search(index, asked, 10, exact=True).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got == nearest(vectors, 10)


def asks_and_block(rng, questions, docs, terms):
    """Questions (as Best takes them), and a block of documents: its table, and tf by term and key."""
    ask = [sorted(rng.sample(range(terms + 3), rng.randint(1, 6))) for _ in range(questions)]
    idf = {t: 1 + (t * 7 % 11) / 10 for t in range(terms + 3)}
    part = pa.table({"id": list(range(questions)), "list": pa.array(ask, pa.list_(pa.int64())), "idfs": pa.array([[idf[t] for t in a] for a in ask], pa.list_(pa.float64()))})
    held = {t: {k: rng.randint(1, 9) for k in rng.sample(docs, rng.randint(1, len(docs)))} for t in range(0, terms, 2)}
    packed = lambda t, kind, of: np.array(of(held[t]), kind).tobytes()
    block = pa.table({"id": list(held), "keys": [packed(t, np.int64, sorted) for t in held], "tfs": [packed(t, np.int32, lambda h: [h[k] for k in sorted(h)]) for t in held]})
    return ask, idf, part, held, block


@pytest.mark.parametrize(("sub", "cells"), [(32, 1 << 19), (4, 64), (1, 8)])
def test_blocks_are_scored_as_by_hand(monkeypatch, sub, cells):
    monkeypatch.setattr(keyword_index, "SUB", sub)
    monkeypatch.setattr(keyword_index, "CELLS", cells)
    rng = random.Random(sub)
    ask, idf, part, held, block = asks_and_block(rng, 50, list(range(100, 190)), 20)
    best = keyword_index.Best(part, 5)
    best.block(block, np.array([101, 150, 999]))
    more = {t: {k + 1000: 10 - n for k, n in h.items()} for t, h in held.items()}
    best.block(pa.table({"id": list(more), "keys": [np.array(sorted(h), np.int64).tobytes() for h in more.values()], "tfs": [np.array([h[k] for k in sorted(h)], np.int32).tobytes() for h in more.values()]}), None)
    got = sorted((q, -s, k) for rows in best.rows() for q, k, s in zip(*(c.to_pylist() for c in rows.columns), strict=True))
    want = []
    for q, terms in enumerate(ask):
        score = {}
        for t in terms:
            for k, n in (held.get(t, {}) | more.get(t, {})).items():
                if k not in (101, 150):
                    score[k] = score.get(k, 0) + (1 + math.log(n)) * idf[t]
        want += sorted((q, -round(s, 6), k) for k, s in score.items())[:5]
    assert [(q, k) for q, _, k in got] == [(q, k) for q, _, k in want]
    assert np.allclose([s for _, s, _ in got], [s for _, s, _ in want], atol=2e-6)


def test_what_a_block_adds_costs_its_own_questions_alone(monkeypatch):
    """One question's better document doesn't put the rows of all others in order again."""
    many = 2000
    part = pa.table({"id": list(range(many)), "list": pa.array([[i] for i in range(many)], pa.list_(pa.int64())), "idfs": pa.array([[1.0]] * many, pa.list_(pa.float64()))})
    best = keyword_index.Best(part, 10)
    entry = lambda ids, key, tf: pa.table({"id": ids, "keys": [np.array([key + i for i in range(10)], np.int64).tobytes()] * len(ids), "tfs": [np.full(10, tf, np.int32).tobytes()] * len(ids)})
    best.block(entry(list(range(many)), 0, 5), None)
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **b: sorted_rows.append(len(keys[0])) or lexsort(keys, *a, **b))
    best.block(entry([7], 500, 9), None)
    assert sum(sorted_rows) <= 20
    found = {(q, k) for rows in best.rows() for q, k in zip(rows["query_id"].to_pylist(), rows["key"].to_pylist(), strict=True)}
    assert {k for q, k in found if q == 7} == set(range(500, 510)) and len(found) == 10 * many
