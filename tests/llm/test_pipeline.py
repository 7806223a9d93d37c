"""The pipeline end to end on a small table."""

import os
import random
import time

import corpus_pipeline
from lodestone.llm import common, shingles


def test_stages_apply_in_order(spark, tmp_path):
    en = "the river runs by the old house and the people of the town walk along it every day in the summer sun"
    fr = "la rivière coule près de la vieille maison et les gens de la ville marchent le long tous les jours en été"
    rows = [(i, f"{(en, fr)[i % 2]} number{i} " + " ".join(f"w{(i * 7 + k) % 50}x" for k in range(15)), ("en", "fr")[i % 2], f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, "12345 67890", "en", "s0", 1), (102, None, "en", "s0", None), (None, "the river runs away", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "passages", "mixture", "encoded"]
    assert not {100, 101, 102} & set(got["doc_id"].dropna().astype(int))
    assert len(got) and got["same"].all() and (got["n_tokens"] == got["ids"].map(len)).all()


def test_near_copies_go_from_similarity_four_fifths(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 248]))]
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 25))):
                copy[i] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + [None, "", " \n", "a b", "A  b", "a b c", texts and " ".join(texts[0]).upper()]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0]
    for _ in range(20):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted([*set(root), 0])
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = "many words of a passage that stands here and there in the table and is long enough to be found again by its hashes as it has over thirty words in all and ends here. "
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "  \n", None, None, 3), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, long, "en", None, 1), (4, "x" * 50_000, "en", "s", 1), (5, "one two " * 5000, None, "t", 1), (6, f"own words. {long}\nmore own words", "en", "t", 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


def test_each_stage_on_odd_rows_and_an_empty_table(spark):
    odd = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, "")
        assert got.count() <= 3 * odd.count(), name
        assert stage(spark, odd.limit(0), "").count() == 0
        if name != "encoded":
            assert got.columns == corpus_pipeline.COLUMNS


def test_mixture_takes_repeated_rows_together(spark):
    rows = [(i % 5, "word " * (3 + i % 4), "en", f"s{i % 3}", 1) for i in range(60)] + [(None, "word word", "en", None, 1)] * 3
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = corpus_pipeline.mixture(spark, docs, "").toPandas()
    size = lambda t: len(t.split())
    total = sum(size(r[1]) for r in rows)
    assert abs(got["text"].map(size).sum() - total) <= 0.1 * total
    again = corpus_pipeline.mixture(spark, docs, "").toPandas()
    assert sorted(map(str, got.to_numpy().tolist())) == sorted(map(str, again.to_numpy().tolist()))


def test_a_family_under_the_similarity_stays_and_one_over_it_goes(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]

    def edited(n):
        words = list(base)
        for i in rng.sample(range(200), n):
            words[i] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    far = [(i, edited(14), "en", "s", 1) for i in range(60)]  # each pair shares about half of its shingles
    docs = spark.createDataFrame(far, COLUMNS).repartition(3)
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 60
    near = [(100 + i, edited(2), "en", "s", 1) for i in range(60)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(far + near, COLUMNS).repartition(3), "").collect()
    assert 100 in {r["doc_id"] for r in kept} and sum(r["doc_id"] >= 100 for r in kept) == 1 and len(kept) == 61


def test_shingles_of_open_sets_travel_once(spark, monkeypatch):
    """40 families of three under the similarity but within the radius: their pieces meet themselves, not those of all others."""
    rng = random.Random(4)
    texts = []
    for f in range(40):
        for _ in range(3):
            words = [f"f{f}w{i}" for i in range(200)]
            for i in rng.sample(range(3, 198, 6), 4):
                words[i] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    rows, tile_pairs = {}, shingles.tile_pairs

    def counting(tiles, offsets, payload, name):
        out = tile_pairs(tiles, offsets, payload, name)
        rows[name] = (tiles.count(), out.count())
        return out

    monkeypatch.setattr(shingles, "tile_pairs", counting)
    monkeypatch.setattr(shingles, "HEAVY", 1 << 11)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 120
    tiles, sent = rows["set-tiles"]
    assert tiles > 5 and sent <= 2 * tiles


def test_families_of_any_size_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(shingles, "HEAVY", 1000)
    test_a_family_under_the_similarity_stays_and_one_over_it_goes(spark)
    test_near_copies_go_from_similarity_four_fifths(spark)


def test_stages_leave_neither_shuffled_data_nor_their_own_tables(spark):
    docs = odd_docs(spark)
    base = common.run_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    corpus_pipeline.near_copies(spark, docs, "").count()
    assert [x.rpartition("-")[0] for x in set(os.listdir(base)) - before] == ["kept"]
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(disk.getAllFiles().mkString(" ").split()) - old
    old = set()
    old = shuffled()
    common.saved(docs.groupBy("doc_id").count(), "counts")
    for _ in range(100):
        if not any("/shuffle_" in f for f in shuffled()):
            break
        time.sleep(0.1)
    assert not any("/shuffle_" in f for f in shuffled())
