"""Repeated lines against SQL and brute force, and copies that come near their targets whatever the sizes."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import mixing, substrings

COMMON = "Subscribe to our weekly newsletter for all of the news that counts."


def lined(rng):
    out = []
    for i in range(80):
        own = [f"own line {i} {k} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))) for k in range(rng.randint(0, 4))]
        some = rng.choices(["Yes.", "  Yes. ", "YES.", "of.", "", "   ", COMMON, "a   b\tc", "A b C"], k=rng.randint(0, 5))
        both = own + some
        rng.shuffle(both)
        out.append((i, "\n".join(both)))
    return out + [(200, None), (201, ""), (202, "\n\n \n"), (None, "Yes.\nnobody's line"), (None, "nobody's line")]


def test_lines_of_any_length_go_but_for_the_first(spark):
    rows = lined(random.Random(4))
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), lines=True).collect() if r["doc_id"] is not None}
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", rows)
    kept = con.execute(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as nth from d),
      k as (select *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as norm from l)
      select doc_id, list(norm order by nth) from (select * from k where norm <> '' qualify row_number() over (partition by norm order by doc_id nulls last, nth) = 1) where doc_id is not null group by 1""").fetchall()
    want = dict(kept)
    for i, text in rows:
        if i is None:
            continue
        r = got[i]
        left = [" ".join(line.lower().split()) for line in (r["text"] or "").split("\n")]
        assert [line for line in left if line] == want.get(i, []), i
        if text is None:
            assert r["text"] is None and r["removed"] == []
        else:  # offsets are of the text as it was
            spans = r["removed"]
            assert r["text"] == "".join(text[x:y] for x, y in zip([0, *[s.end for s in spans]], [*[s.start for s in spans], len(text)], strict=True))


def test_a_line_of_many_documents_stays_once_and_no_line_repeats(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) + f"\n{COMMON}") for i in range(50)]
    got = [r["text"] for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), lines=True).orderBy("doc_id").collect()]
    assert COMMON in got[0] and not any(COMMON in t for t in got[1:])
    assert all(t.startswith(rows[i][1].split("\n")[0]) for i, t in enumerate(got))
    twice = spark.createDataFrame([(1, "word"), (1, "word"), (2, "Word"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in substrings.drop_repeats(twice, lines=True).collect()) == ["", "", "None", "None", "word"]


def test_buckets_in_slices_give_the_same(spark, monkeypatch):
    rows = lined(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    whole = sorted(map(lambda r: (*key(r), str(r["removed"])), substrings.drop_repeats(df, lines=True).collect()))
    monkeypatch.setattr(substrings, "SLICE", 3)
    assert sorted(map(lambda r: (*key(r), str(r["removed"])), substrings.drop_repeats(df, lines=True).collect())) == whole


def copies(spark, classes, targets):
    goals = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).join(targets, "source")
    return {r["source"]: r for r in mixing.whole_copies(classes, mixing.balance(classes, goals)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("most"), F.max(F.col("copies") / F.col("n")).alias("rate"), F.min("copies").alias("least")).join(goals, "source").collect()}


def test_copies_of_many_sizes_come_near_every_target(spark):
    names = [f"s{k}" for k in range(40)]
    classes = spark.range(1, 20_001).select(F.explode(F.array(*map(F.lit, names))).alias("source"), F.col("id").alias("size"), F.lit(1).cast("long").alias("n"))
    half = spark.createDataFrame([(s, 100_005_000.0 * (0.1 + 0.06 * k)) for k, s in enumerate(names)], "source string, target double")
    got = copies(spark, classes, half)
    assert set(got) == set(names)
    for r in got.values():
        assert abs(r["taken"] - r["target"]) <= min(20_000, 1e-3 * r["target"]) and r["rate"] <= 3 and r["least"] >= 0


def test_copies_of_odd_classes_stay_within_the_largest_size(spark):
    rng = random.Random(5)
    rows, goals = [], []
    for k in range(60):
        sizes = rng.sample(range(1, 5000), rng.choice([1, 2, 3, 10, 200]))
        rows += [(f"s{k}", s, rng.choice([1, 1, 2, 50])) for s in sizes]
        goals.append((f"s{k}", float(rng.uniform(0.05, 2.9) * sum(s * n for _, s, n in rows[-len(sizes):]))))
    classes = spark.createDataFrame(rows, "source string, size long, n long")
    for r in copies(spark, classes, spark.createDataFrame(goals, "source string, target double")).values():
        assert abs(r["taken"] - r["target"]) <= r["most"] and r["rate"] <= 3 and r["least"] >= 0


def test_words_tell_line_breaks():
    starts, _, _, breaks = substrings.words("one two\nthree \n\n four")
    assert [bool(b) for b in breaks] == [False, True, True, False] and len(starts) == len(re.findall(r"\S+", "one two three four"))
