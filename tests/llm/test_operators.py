"""Each operator against brute force or an exact round trip, and on nulls, empty and repeated rows, and empty tables."""

import random
import time
import zlib

import numpy as np
import pytest
import xxhash

from lodestone.llm import extract, langid, mixing, pieces, ratings, rules, simhash, substrings, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string, copies int, score string"
LONG = "the quick brown fox jumps over the lazy dog and then it sleeps under an old tree "


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = {"en": "the of and to in that it was for on with as house river".split(), "fr": "le la de et les des un une dans pour sur avec maison rivière".split()}
    out = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.randint(25, 60))]
        if i % 5 == 0:
            words[3] = "moron"
        out.append((i, " ".join(words) + ".", lang, f"s{i % 4}", 0))
    out += [(200, None, "en", None, None), (201, "", None, "s1", 0), (202, "a b", "en", "s1", 3), (None, "no id here", "en", None, 1), (203, LONG * 400, "en", "s0", 9), (203, LONG * 400, "en", "s0", 9), (204, out[0][1], "en", "s0", 0), (205, "  \n\t", "fr", "s2", 4)]
    return [(*r, "x", 1, "y") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]


def test_mixing_meets_targets(docs, empty, rows):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len(words(r[1])) for r in rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all()
    assert by["target"].sum() <= by["size"].sum() + 1e-6 and (by["target"] <= 3 * by["size"] + 1e-9).all()
    big = by[by["size"] > 500]
    assert (abs(big["taken"] - big["target"]) <= 60).all()
    again = mixing.mix(docs).toPandas()
    assert sorted(map(tuple, got.fillna(-1).astype(str).to_numpy())) == sorted(map(tuple, again.fillna(-1).astype(str).to_numpy()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).count() == got["copies"].sum()
    named = docs.withColumnsRenamed({"copies": "rows", "score": "sum"})
    assert mixing.mixed(named).columns == named.columns
    with pytest.raises(RuntimeError):
        mixing.balance(mixing.sizes(docs).groupBy("source", "size").count().withColumnRenamed("count", "n"), mixing.targets(mixing.sizes(docs)), rounds=1)


def test_targets_and_tilts_against_brute_force(docs, rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(len(words(r[1])))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share again what is above three times a source
        left = sum(map(sum, by.values())) - sum(target[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target |= {s: left * weight[s] / open_ for s in order if s not in full}
        over = {s for s in order if s not in full and target[s] > 3 * sum(by[s])}
        if not over:
            break
        target |= {s: 3 * sum(by[s]) for s in over}
        full |= over
    sized = mixing.sizes(docs)
    goals = mixing.targets(sized)
    got = {r["source"]: r for r in goals.collect()}
    assert {s: (got[s]["source_size"], round(got[s]["target"], 6)) for s in by} == {s: (sum(by[s]), round(target[s], 6)) for s in by}
    tilts = mixing.balance(sized.groupBy("source", "size").count().withColumnRenamed("count", "n"), goals).collect()
    for r in tilts:
        x = np.array([n for n in by[r["source"]] if n], dtype=float)
        if r["source"] in full or not len(x):
            continue
        lo, hi = -50.0, 50.0  # words taken grow with the tilt: bisection
        for _ in range(200):
            mid = (lo + hi) / 2
            taken = (np.minimum(3, np.exp(np.minimum(50, mid * x / x.mean()))) * x).sum()
            lo, hi = (mid, hi) if taken < target[r["source"]] else (lo, mid)
        assert abs((np.minimum(3, np.exp(np.minimum(50, r["tilt"] * x / x.mean()))) * x).sum() - target[r["source"]]) < 1 and abs(r["tilt"] - lo) < 0.05


def naive_spans(rows, min_words):
    """Spans that each (doc_id, text) loses, with every paragraph as a tuple of words."""
    import re

    out, seen = {}, set()
    for nth, (key, text) in enumerate(rows):
        low = substrings.lower(text)
        found = list(re.finditer(r"\S+", low))
        ends = [bool(substrings.words(m[0])[2][-1]) or "\n" in low[m.end() : (found[i + 1].start() if i + 1 < len(found) else len(low))] for i, m in enumerate(found)]
        if found:
            ends[-1] = True
        begins = [i for i in range(len(found)) if i == 0 or ends[i - 1]]
        stops = [i for i in range(len(found)) if ends[i]]
        pairs = {(i, min(e for e in stops if e >= i + min_words - 1)) for i in begins if any(e >= i + min_words - 1 for e in stops)}
        pairs |= {(max(i for i in begins if i <= e - min_words + 1), e) for e in stops if any(i <= e - min_words + 1 for i in begins)}
        for i, e in sorted(pairs):
            words_of = tuple(m[0] for m in found[i : e + 1])
            if words_of in seen:
                out.setdefault(nth, []).append((found[i].start(), found[e + 1].start() if e + 1 < len(found) else len(text)))
            seen.add(words_of)
    merged = {}
    for nth, spans in out.items():
        for x, y in sorted(spans):
            if merged.get(nth) and x <= merged[nth][-1][1]:
                merged[nth][-1] = (merged[nth][-1][0], max(y, merged[nth][-1][1]))
            else:
                merged.setdefault(nth, []).append((x, y))
    return merged


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12))) + rng.choice([". ", "! ", "\n", " ", "  \n "])
    passages = ["".join(sentence() for _ in range(4)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(passages) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 6)))
        rows.append((i, text.upper() if i % 9 == 0 else text))
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 10).collect()}
    want = naive_spans(rows, 10)
    assert sum(map(len, want.values())) > 20
    for i, text in rows:
        spans = want.get(i, [])
        assert [(r.start, r.end) for r in got[i]["removed"]] == spans
        assert got[i]["text"] == "".join(text[x:y] for x, y in zip([0, *[e for _, e in spans]], [*[b for b, _ in spans], len(text)]))


def test_passages_keep_their_first_occurrence(spark, docs, empty):
    passage = "This passage of many words stands in two documents, and should stay in the first of them only; " * 2 + "in the others it goes."
    d = spark.createDataFrame([(1, f"Alpha one. {passage} Beta two.", 1), (2, f"Gamma three.\n{passage}\nDelta four.", 2), (3, passage, 3), (3, passage, 4), (4, None, 5), (5, "", 6), (6, "Few words repeat.", 7), (7, "Few words repeat.", 8)], "doc_id long, text string, start int")
    rows = substrings.drop_repeats(d).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] != 3}
    assert got[1]["text"] == f"Alpha one. {passage} Beta two." and got[1]["removed"] == []
    assert got[2]["text"] == "Gamma three.\nDelta four."
    assert [(s.start, s.end) for s in got[2]["removed"]] == [(13, 13 + len(passage) + 1)]
    assert [r["text"] for r in rows if r["doc_id"] == 3] == ["", ""]
    assert got[4]["text"] is None and got[5]["text"] == "" and got[7]["text"] == got[6]["text"] == "Few words repeat."
    # equal rows: one keeps its text
    twice = substrings.drop_repeats(spark.createDataFrame([(1, passage, 0), (1, passage, 0), (1, "short", 0), (1, "short", 0)], "doc_id long, text string, runs int")).collect()
    assert sorted(r["text"] for r in twice) == ["", passage, "short", "short"] and "runs" in twice[0].asDict()
    assert substrings.drop_repeats(docs).count() == docs.count()
    assert substrings.drop_repeats(empty).count() == 0


def test_words_do_not_depend_on_blocks(monkeypatch):
    text = "One two. \n three 日本語 four? " * 50
    whole = substrings.words(text)
    monkeypatch.setattr(substrings, "BLOCK", 37)
    assert all((x == y).all() for x, y in zip(whole, substrings.words(text)))


def test_pieces_match_the_library_and_decode(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r[1] or "" for r in rows] + ["  two  spaces ", "naïve 日本語 \U0001f600 x\ty\r\n", "a" * 300, "".join(random.Random(5).choice("thecation") for _ in range(3000)), "\n\n", "1234567890 == [] {}"]
    model = pieces.Pieces.load()
    ids, at = model.encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert list(own) == sp.encode(t)
        assert model.decode(own) == t
    got = pieces.tokenise(docs).toPandas()
    assert len(got) == len(rows) and got["same"].dropna().all()


def test_unigram_search_finds_the_best_sum():
    rng = random.Random(3)
    table = [("<unk>", 0.0, 2)] + [(p, -rng.random() * 5 - 1, 1) for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "aab", "▁", "▁a", "▁ab")]
    model = pieces.Pieces(table, bpe=False)
    score = {p: s for p, s, k in table if k == 1}

    def best(w):
        return max((score[w[:k]] + (best(w[k:]) if w[k:] else 0.0) for k in range(1, len(w) + 1) if w[:k] in score), default=-1e9)

    for _ in range(50):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids, _ = model.encode([t])
        assert abs(sum(table[i][1] for i in ids) - best("▁" + t)) < 1e-9


def test_simhash_groups_against_all_pairs(docs, empty, rows):
    got = simhash.simhash_groups(docs).toPandas()

    def print_of(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = words(w)
        g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [print_of(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in range(8):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root[i]] = min(low.get(root[i], 10**9), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(low.get(k))) for r, p, k in zip(rows, prints, root))
    have = sorted((str(None if a != a else int(a)), b, str(None if c != c else int(c))) for a, b, c in got[["doc_id", "fingerprint", "component_id"]].itertuples(index=False))
    assert have == want
    assert simhash.simhash_groups(empty).count() == 0


def test_language_of_unseen_documents(docs, empty):
    got = langid.identify(docs, langid.fit(docs), "doc_id", "lang").toPandas()
    seen = got[got["doc_id"] < 120]
    assert (seen["lang_pred"] == seen["lang"]).mean() > 0.95
    assert (got[got["doc_id"].isin([200, 201, 205])]["lang_pred"] == "und").all()
    none = langid.fit(empty)
    assert langid.identify(empty, none, "doc_id").count() == 0
    assert set(langid.identify(docs, none, "doc_id").toPandas()["lang_pred"]) == {"und"}


def test_unlearned_languages_of_the_same_script_are_rejected(spark):
    rng = random.Random(5)
    vocabulary = {
        "en": "the of and to in that it was for on with as house river water people through between never always thought mother which would should there where night light",
        "fr": "le la de et les des une dans pour sur avec maison rivière eau gens toujours jamais entre pensée mère lequel voudrait nuit lumière beaucoup aujourd chose temps",
        "de": "der die das und zu in dass es war für auf mit als haus fluss wasser leute durch zwischen niemals immer gedanke mutter welche würde sollte dort nacht licht",
        "fi": "ja on että hän oli joki talo vesi ihmiset läpi välillä koskaan aina ajatus äiti joka pitäisi siellä missä yö valo kaikki kuitenkin sitten nyt",
    }
    text = lambda k, n: " ".join(rng.choice(vocabulary[k].split()) for _ in range(n))
    learned = [(i, text(k, rng.choice([8, 40, 200])), k) for i, k in enumerate(["en", "fr", "de"] * 200)]
    other = [(10_000 + i, text("fi", 60), None) for i in range(100)]
    docs = spark.createDataFrame([*learned, *other], "doc_id long, text string, lang string").repartition(3)
    got = langid.identify(docs, langid.fit(docs), "doc_id", "lang").toPandas()
    assert got[got["lang"].isna()]["rejected"].mean() >= 0.95
    assert got[got["lang"].notna()]["rejected"].mean() <= 0.02


def test_toxic_sentences_are_learned_and_found(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), "doc_id", "text").toPandas()
    seen = got[got["doc_id"] < 120]
    held = seen[[zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in seen["doc_id"]]]
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.9
    for r in seen[seen["predicted"] == 1].itertuples():
        assert "moron" in r.text[int(r.worst_start) : int(r.worst_end)]
    assert (got[got["doc_id"].isin([200, 201, 205])]["score"] == 0).all()
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0)), "doc_id").count() == 0


def test_ordered_grades(spark, docs, empty):
    junk = [(1000 + i, "### $$$ !!! %%% ### @@@ x1 " * (3 + i % 4)) for i in range(40)]
    mid = [(2000 + i, ("the of and ### to in " * (4 + i % 5))) for i in range(40)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(junk + mid, "doc_id long, text string"))
    graded = spark.createDataFrame([(i, 2) for i in range(120)] + [(i, 0) for i, _ in junk] + [(i, 1) for i, _ in mid] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = ratings.fit(both, graded)
    assert (np.diff(model.thresholds) > 0).all()
    got = ratings.grade(both, model, "doc_id").toPandas().set_index("doc_id")["expected_grade"]
    assert got[[i for i, _ in junk]].max() < got[[i for i, _ in mid]].mean() < got[list(range(120))].mean()
    one = ratings.fit(both, graded.where("grade = 2"))
    assert ratings.grade(both, one, "doc_id").where("kept").count() == both.count()
    assert ratings.grade(empty, model, "doc_id").count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 16)), base[:5], 3 * base[:3], base[:10] + 0.16 * rng.normal(size=(10, 16))])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, [], 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [1e308] * 16, 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(4)).toPandas().set_index("vec_id")
    u = np.concatenate([x, [[1.0] * 16]])
    ids = [*range(len(x)), 507]
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert list(got.loc[ids, "n_links"]) == list(link.sum(axis=1) - 1)
    low = np.arange(len(u))
    for _ in range(len(u)):
        low = np.array([low[link[i]].min() for i in range(len(u))])
    assert list(got.loc[ids, "component_id"]) == [ids[i] for i in low]
    assert list(got.loc[[500, 501, 502, 503, 504], "n_links"]) == [0] * 5 and got.loc[[500, 501, 502, 503, 504], "kept"].all()
    assert list(got.loc[[505, 506], "component_id"]) == [505, 505]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rules_count_as_told(docs, empty, rows):
    got = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in rules.judge(docs).collect()}
    for r in rows:
        w, g = words(r[1]), got[-1 if r[0] is None else r[0]]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in wins if wins.count(x) > 1} if len(wins) < 1000 else set(wins)
        covered = {i + k for i, x in enumerate(wins) if x in many for k in range(8)}
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        assert (g["n_symbols"], g["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (g["base_failed"] and g["kept"])
    assert sum(got[i]["kept"] for i in range(120)) >= 115
    assert rules.judge(empty).count() == 0


def test_each_measure_rejects_an_outlier_that_passes_the_base_rules(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n // 12))
    rows = [(i, text(240), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000, text(240) + " # $ % #" * 3, "en", "s0"), (1001, "\n".join([text(12)] * 5 + [text(12) for _ in range(5)]).replace(" ", "  "), "en", "s1")]
    line = text(12)
    rows += [(1002, "\n".join([text(24), line, text(24), line, text(24), line, text(24), line, text(96)]), "en", "s0")]
    window = text(36).replace("\n", " ")
    rows += [(1003, f"{window} x {window} " + text(180).replace("\n", " "), "en", "s1"), (1004, " ".join(w * 3 for w in text(240).split()), "en", "s2"), (1005, text(240), "fi", None), (1006, text(24), "en", "s2")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    for i in (1000, 1002, 1003, 1004):
        assert not got[i]["base_failed"] and not got[i]["kept"], i
    assert got[1005]["kept"] and got[1006]["kept"]


PAGE = "<html><body class='has-sidebar'><nav><a href='/'>Home</a></nav><div><p>Breaking every day</p><div><h2>Title {0}</h2><p>Body&nbsp;{0}  text &amp; more<br>of it</p></div><p>Read our terms</p></div><div class='comments'><p>nice</p></div><script>x='</p>'</script><footer>(c)</footer></body></html>"


def test_pages_lose_what_neighbours_share(spark):
    rows = [(1, "http://a.example/x/1", PAGE.format("one")), (2, "http://a.example/x/2", PAGE.format("two")), (3, None, PAGE.format("three")), (4, "http://b.example/", None), (5, "http://b.example/y", ""), (6, "http://c.example/", "a < b <p>c")]
    got = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[1]["text"] == "Title one\n\nBody one text & more of it" and got[2]["text"] == "Title two\n\nBody two text & more of it"
    assert got[3]["text"] == "Breaking every day\n\nTitle three\n\nBody three text & more of it\n\nRead our terms"
    assert got[4]["text"] == got[5]["text"] == "" and got[6]["text"] == "a < b\n\nc"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_inside_articles_go_and_quotes_and_copies_stay(spark):
    body = lambda *own: "<article><p>By our staff</p>" + "".join(f"<p>{x} {LONG}</p>" for x in own) + "<p>Subscribe to our newsletter</p></article>"
    quote = "a quote"
    rows = [(i, f"http://a.example/n/{i}", body(f"own {i}", quote, f"more {i}", f"still {i}")) for i in range(6)]
    # copies at neighbouring paths are one page for the pairing; edited copies keep what they share
    rows += [(10 + i, f"http://b.example/n/{i}", f"<div><p>Top line</p></div><p>same text {LONG}</p>") for i in range(4)] + [(19, "http://b.example/n/9", f"<div><p>Top line</p></div><p>other {LONG}</p>")]
    rows += [(20 + i, f"http://c.example/n/{i}", body("one", "two", "three", f"edit {i}", "four")) for i in range(3)]
    rows += [(30 + i, "http://d.example/same", f"<p>Shared head</p><p>text {i // 2}</p>") for i in range(4)]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"].split("\n\n") for r in extract.extract(pages).collect()}
    line = lambda x: f"{x} {LONG}".strip()
    for i in range(1, 5):
        assert got[i] == [line(f"own {i}"), line(quote), line(f"more {i}"), line(f"still {i}")]
    for i in range(10, 14):
        assert got[i] == [line("same text")]
    assert got[19] == [line("other")]
    for i in range(20, 23):
        assert got[i] == ["By our staff", line("one"), line("two"), line("three"), line(f"edit {i - 20}"), line("four"), "Subscribe to our newsletter"]
    for i in range(30, 34):
        assert got[i] == [f"text {(i - 30) // 2}"]
    assert extract.extract(pages).count() == len(rows)


def test_a_host_over_several_partitions(spark):
    rows = [(i, f"http://a.example/{i:03d}", f"<p>Menu line</p><p>text {i}</p>") for i in range(60)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text {i}" for i in range(60)}


def test_names_that_only_contain_a_marked_word_stay():
    page = "<article><div class='ad-hoc'>one</div><p class='notice-period'>two</p><section id='legal-history'>three</section><div class='ad'>gone</div><p hidden>gone</p></article>"
    assert extract.article(page)[0] == ["one", "two", "three"]


@pytest.mark.parametrize("unit", ["<a ", "<a \"x' ", "<div><div></span>", "<!-- ", '<a href="', "<", "<p a='\"", "<script>", "<p>x", "<li x", "&#"])
def test_long_malformed_pages_take_linear_time(unit):
    began = time.process_time()
    for end in ("", ">"):
        extract.lines(unit * (1_000_000 // len(unit)) + end)
    assert time.process_time() - began < 15


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)

    def longest(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = extract.shared(a, b)
        rest = iter(b)
        assert len(got) == longest(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in got))
