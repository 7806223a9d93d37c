"""Every base query that has SQL gives the same rows in DuckDB; recursive indicators against published values."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.functions import text
from lodestone.operators import anomaly, forest, graph, indicators, merge, reads
from lodestone.plans import catalogue as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(9)
        elif df[c].dtype.kind == "M":
            df[c] = pd.to_datetime(df[c], utc=True).dt.strftime("%F %T").str.replace(" 00:00:00", "")
    return sorted(tuple("None" if x is None or x != x else str(x).replace(" 00:00:00", "") for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_forest_finds_the_far_point():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)), [[9.0, 9.0, 9.0]]])
    names = [str(i) for i in range(301)]
    grown = forest.grown("s", names, x, 100)
    s = forest.scores(x, *grown, 100, 256)
    assert s.argmax() == 300 and (s == forest.scores(x, *forest.grown("s", names, x, 100), 100, 256)).all()


def test_forest_scores_are_mean_paths_and_do_not_depend_on_pieces(spark, monkeypatch):
    import datetime

    rng = np.random.default_rng(1)
    day = datetime.date(2000, 1, 1)
    rows = [(s, day + datetime.timedelta(days=i), *map(float, rng.normal(size=5))) for s, n in (("a", 400), ("b", 90), ("c", 10)) for i in range(n)]
    rows += [("flat", day + datetime.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(70)]
    names = [f"f{k}" for k in range(5)]
    df = spark.createDataFrame(rows, "symbol string, session date, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    score = lambda: {(r["symbol"], r["session"]): r["score"] for r in forest.scored(df, names, 20, 60).collect()}
    whole = score()
    assert len(whole) == 560 and {s for s, _ in whole} == {"a", "b", "flat"}
    monkeypatch.setattr(forest, "PIECE", 37)
    assert score() == whole
    own = [r for r in rows if r[0] == "b"]
    axis, cut, count = forest.grown("b", [str(r[1]) for r in own], np.array([r[2:] for r in own]), 20)
    wide = len(axis) // 20
    for r in own[:10]:
        paths = []
        for t in range(20):
            node, steps = 1, 0
            while axis[t * wide + node] >= 0:
                node, steps = 2 * node + (r[2 + axis[t * wide + node]] >= cut[t * wide + node]), steps + 1
            paths.append(steps + float(forest.depth(count[t * wide + node])))
        assert abs(whole["b", r[1]] - 2 ** (-np.mean(paths) / float(forest.depth(90)))) < 1e-8


def test_flat_series_has_no_z(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 5)], "symbol string, x double")
    assert anomaly.robust_z(d, "x", "symbol").where("z is not null").count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k int, v string")
    assert sorted(merge.upsert(old, new, ["k"]).collect(), key=str) == sorted(new.collect(), key=str)
    assert sorted(r["v"] for r in merge.insert_only(old.where("k = 1"), new.where("k is not null"), ["k"]).collect()) == ["a", "c"]
    rows = spark.createDataFrame([("x", "s", True)], "k string, source string, is_active boolean")
    assert merge.deactivate_missing(rows, rows.limit(0), "k", "s").first()["is_active"]


EDGE = "source string, target string, kind string, weight double, confidence double"


def test_shock_goes_one_way_and_not_back(spark):
    rows = [("a", "b", "supplies", 1.0, 0.9), ("b", "c", "supplies", 1.0, 0.6), ("d", "b", "supplies", 1.0, 0.9), ("b", "e", "competes_with", 1.0, 0.9), ("e", "f", "supplies", 1.0, 0.9), ("b", "g", "uses", 0.05, 0.9), ("c", "h", "supplies", 1.0, 0.4), ("x", "a", "uses", 1.0, 0.9), ("a", "a2", "partners_with", 1.0, 0.9), ("a2", "y", "supplies", 1.0, 0.9)]
    got = {r["node"]: (r["score"], r["confidence"], r["direction"]) for r in graph.propagate(spark.createDataFrame(rows, EDGE), "a", 1.0).collect()}
    # d supplies b: the way back up the chain is closed; e competes and hands nothing on; g is too little, h too unsure, x uses a
    assert got == {"b": (0.85, 0.9, "benefits"), "c": (0.7225, 0.6, "benefits"), "e": (-0.2975, 0.9, "at_risk"), "a2": (0.45, 0.9, "benefits"), "y": (0.3825, 0.9, "benefits")}
    assert graph.propagate(spark.createDataFrame(rows, EDGE), "a", 1.0, hops=0).count() == 0
    bad = {r["node"]: r["direction"] for r in graph.propagate(spark.createDataFrame(rows, EDGE), "a", -1.0).collect()}
    assert bad["b"] == "at_risk" and bad["e"] == "benefits"


def test_paths_add_up_and_strongest_come_first(spark):
    rows = [("a", "b", "supplies", 1.0, 0.9), ("a", "c", "supplies", 0.5, 0.8), ("b", "z", "supplies", 0.5, 0.7), ("c", "z", "supplies", 1.0, 0.9)]
    got = {r["node"]: r for r in graph.propagate(spark.createDataFrame(rows, EDGE), "a").collect()}
    assert got["z"]["score"] == round(0.85 * 0.85 * 0.5 * 2, 4) and got["z"]["confidence"] == 0.8
    assert got["z"]["paths"] == "a → supplies b → supplies z; a → supplies c → supplies z"


def test_hops_do_not_grow_the_plan(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "supplies", 1.0, 0.9) for i in range(8)], EDGE)
    size = lambda hops: graph.reachable(e, "n0", hops)._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert size(6) - size(4) == size(4) - size(2)
    assert {r["node"]: r["depth"] for r in graph.reachable(e, "n0", 3).collect()} == {"n0": 0, "n1": 1, "n2": 2, "n3": 3}


def test_chunks_end_where_they_may():
    rng = np.random.default_rng(3)
    for _ in range(40):
        words = ["w" * rng.integers(1, 12) + ("" if rng.random() < 0.8 else ".") for _ in range(rng.integers(1, 400))]
        t = "".join(w + ("\n\n" if rng.random() < 0.05 else " ") for w in words).strip()
        out = text.chunk(t, 300, 40)
        want, start = [], 0  # a plain version
        while len(t) > 300 and start < len(t):
            end = min(start + 300, len(t))
            if end < len(t):
                floor = start + (end - start) * 2 // 3
                paragraph = [i + 2 for i in range(floor, end - 1) if t[i : i + 2] == "\n\n"]
                sentence = [i + 1 for i in range(max(1, floor), end) if t[i].isspace() and t[i - 1] in ".!?" and (i + 1 >= end or not t[i + 1].isspace())]
                space = [i + 1 for i in range(floor + 1, end) if t[i] == " "]
                end = (paragraph or sentence or space or [end])[-1]
            if t[start:end].strip():
                want.append(t[start:end].strip())
            if end >= len(t):
                break
            start = max(end - 40, start + 1)
        if len(want) > 1 and len(want[-1]) < 120:
            want[-2:] = [(want[-2] + " " + want[-1]).strip()]
        assert out == (want or [t])
    assert text.chunk("short", 300, 40) == ["short"] and text.chunk("", 300, 40) == []


def test_embedding_weighs_buckets_not_grams():
    import hashlib
    import math

    def plain(t, dims):
        t = " ".join(t.lower().split())
        v = [0.0] * dims
        grams = [t[i : i + 4] for i in range(len(t) - 3)]
        digest = [hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams]
        for k in range(dims):
            own = [h for h in digest if int.from_bytes(h[:4], "big") % dims == k]
            if own:
                v[k] = (1 if own[-1][4] % 2 else -1) * (1 + math.log(len(own)))
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    for t in ("The quick brown fox jumps over it", "aaaa aaaa", "abc", "", "Ünïcode text  with\tspaces"):
        assert np.allclose(text.embed(t, 8), plain(t, 8)) and np.allclose(text.embed(t, 64), plain(t, 64))


def test_lexicon_terms_turn_and_phrases_count(spark):
    rows = [(1, "Shares rose, growth is strong"), (2, "demand is not weak"), (3, "The plant is sold out"), (4, None), (5, "no growth but losses")]
    got = {r["k"]: r for r in text.sentiment(spark.createDataFrame(rows, "k int, t string"), "t").collect()}
    assert got[1]["label"] == "bullish" and got[1]["confidence"] == round(0.4 + 0.55 * 2.4 / 6, 4)
    assert got[2]["label"] == "neutral" and got[2]["confidence"] == 0.35  # a side is 0 at least
    assert got[3]["bull"] == 1.1 and got[4]["label"] == "neutral" and got[5]["label"] == "neutral"  # both terms are turned


def test_values_of_repeated_keys_multiply_nothing(spark):
    old = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert merge.coalesce_set(old, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k", "v").count() == 2
    fresh = spark.createDataFrame([(7, "b"), (7, "a"), (None, "n"), (None, "m")], "k int, v string")
    assert sorted(r["v"] for r in merge.insert_only(old.limit(0), fresh, ["k"]).collect()) == ["a", "m"]


def test_changes_go_on_from_batch_to_batch(spark):
    from datetime import datetime

    from lodestone.streaming import quotes

    at = lambda h, m: datetime(2020, 1, 1, h, m)
    first = [(1, "a", at(1, 0), 1.0), (2, "a", at(1, 5), 1.0), (3, "a", at(2, 0), 1.0), (4, "a", at(2, 1), 2.0), (5, "b", at(1, 0), 7.0)]
    second = [(6, "a", at(3, 0), 2.0), (7, "a", at(5, 0), 3.0), (8, "c", at(3, 0), 1.0)]
    schema = "event_id long, symbol string, ts timestamp, price double"
    sent, state = quotes.changes(spark.createDataFrame(first, schema), spark.createDataFrame([], quotes.LAST))
    assert sorted(r["event_id"] for r in sent.collect()) == [1, 4, 5]
    sent, state = quotes.changes(spark.createDataFrame(second, schema), state)
    assert sorted(r["event_id"] for r in sent.collect()) == [7, 8]
    assert {r["symbol"]: r["last"] for r in state.collect()} == {"a": 3.0, "b": 7.0, "c": 1.0}


def test_windows_have_guards():
    from datetime import date

    assert reads.window(None, None, date(2020, 6, 30)) == (date(2020, 1, 2), date(2020, 6, 30))
    for start, end in ((date(2020, 2, 1), date(2020, 1, 1)), (date(2015, 1, 1), date(2020, 1, 1))):
        with pytest.raises(ValueError):
            reads.window(start, end, date(2020, 6, 30))
    with pytest.raises(ValueError):
        text.chunks(None, "k", "t", 100, 100)


def test_inverted_window_is_refused(spark):
    with pytest.raises(ValueError):
        reads.between(spark.range(1), "id", "2", "1")
