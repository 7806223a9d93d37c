"""Chat formatting, prefix tries and Merkle manifests against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from lodestone.llm import chat, merkle, queries, trie

CONVS = "conv_id long, turn long, role string, text string, key string, text_start int, ends string"
BITS = ["<", "s>", "</", "[INST]", " [/INST]", "\\", "<\\s>", "</s>", "<<SYS>>", "<\\\\/s>", "[", "ROLE]", "a b", " ", "\n", "<</SYS>>", "[/TURN]", "\U0001f600"]
ROLES = ["user", "assistant", "system", "tool", "", "[ROLE]x</s>", "a\nb", None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(45), 61, 83, 84, -3, -20, -25]:
        for t in range(rng.randint(1, 6)):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a b", "c", "d  e f"])))
    for c in (200, 201, 202, 220):  # copies
        out += [(c, t, ("user", "assistant")[t % 2], f"copy {t}") for t in range(9)]
    out += [(300, t, rng.choice(ROLES), "".join(rng.choice(BITS) for _ in range(4))) for t in range(300)]
    out += [(301, 2, None, None), (301, None, "user", "first"), (301, 2, "user", "tie b"), (301, 2, "user", "tie a"), (301, 5, "user", "again"), (301, 5, "user", "again"), (302, 0, "assistant", "long " * 40_000)]
    out += [(None, 1, "user", "nobody"), (None, 0, "assistant", "nowhere")]
    return [(*r, "k", 1, "e") for r in out]


@pytest.fixture(scope="module")
def convs(spark, rows):
    return spark.createDataFrame(rows, CONVS).repartition(5).cache()


def ordered(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in by.items()}


def test_chats_read_back(convs, rows):
    want = ordered(rows)
    found = chat.pieces(convs, block=16)
    got = {r["conv_id"]: r for r in chat.digests(found).collect()}
    whole = {r["conv_id"]: r for r in chat.formatted(found).collect()}
    assert set(got) == set(whole) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out = chat.bracketed(turns)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert tuple(got[c]) == (c, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out))
        assert whole[c]["text"] == out and whole[c]["rewritten"] == 0
        assert "".join(chat.unescape(out[s["start"] : s["end"]]) for s in whole[c]["loss"]) == loss
    assert chat.pieces(convs.limit(0)).count() == 0 and chat.digests(chat.pieces(convs.limit(0))).count() == 0


def test_escapes_are_reversible_and_leave_no_mark():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 7)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def spans(template, turns, block=64):
    conv = chat.Conversation(chat.Template(template, lambda p: ("", p), lambda t: t), 1, block)
    rows = []
    for t in turns:
        if len(conv.turns) >= 2 * block:
            rows += conv.handed_on()
        conv.add(*t)
    return rows + conv.rows(len(conv.turns)), conv


def marked(turns):
    return "".join(f"<{r}>{t.strip()}\n" for r, t in turns)


def forgetful(turns):  # thoughts of all turns but the last go
    return "".join(f"<{r}>{t if k == len(turns) - 1 else re.sub('T.*T', '', t)}\n" for k, (r, t) in enumerate(turns))


def counted(turns):
    return f"{len(turns)} turns\n" + marked(turns)


def numbered(turns):
    return "".join(f"{k} {r}: {t}\n" for k, (r, t) in enumerate(turns))


def closed(turns):  # an end that moves
    return marked(turns) + "<end>"


TALK = [(("user", "assistant")[k % 2], f"T{k}Tword{k}") for k in range(23)]


@pytest.mark.parametrize("template", [marked, forgetful, counted, numbered, closed, chat.bracketed])
def test_any_template(template):
    """Pieces joined are the output, told texts stand where they are told, and turns that were rewritten are named."""
    for block in (64, 3):
        rows, conv = spans(template, TALK, block)
        out = template(TALK)
        assert "".join(r[3] for r in rows) == out and [r[1] for r in rows] == list(range(len(TALK)))
        assert all(out[r[4] : r[4] + len(r[3])] == r[3] for r in rows)
        told = [k for k, r in enumerate(rows) if r[5] is not None]
        assert all(out[rows[k][5] : rows[k][6]] == TALK[k][1] for k in told)
        rewritten = [k for k, r in enumerate(rows) if r[7]]
        if template in (forgetful, counted):
            assert rewritten == list(range(22)) and told == [22]
        elif template is closed:
            assert rewritten == list(range(22))  # each end was moved
        else:
            assert not rewritten and told == list(range(23))
        if block == 3:  # only those that render alone as they did may go
            assert (len(conv.turns) <= 6) == (template in (marked, chat.bracketed))


def brute_trie(rows):
    by = {c: v for c, v in ordered(rows).items() if c is not None}
    nodes = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        base = by.get(c - int(abs(c) % 20) * (1 if c >= 0 else -1), [])
        turns = base[:h] + by[c][h:]
        for d in range(len(turns) + 1):
            n = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            n["members"].append(c)
            if d == len(turns):
                n["ends"].append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]["members"]) - 1) * (len([w for w in re.split("[\x20\x09-\x0d]+", path[-1][1]) if w]) if path else 0)
        leaves[path] = sum(leaves[k] for k in kids.get(path, [])) or 1
        saved[path] = own + sum(saved[k] for k in kids.get(path, []))
    return sorted(
        (min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for p, n in nodes.items()
    )


def test_prefix_trie_against_brute_force(convs, rows, monkeypatch):
    some = [r for r in rows if r[0] != 301]  # its ties go by a digest
    want = brute_trie(some)
    of = convs.where("conv_id is null or conv_id <> 301")
    got = sorted(tuple(r)[:8] for r in trie.prefix_trie(of).collect())
    assert got == want
    monkeypatch.setattr(trie, "RANGE", 1)  # ids of a node over many ranges
    ends = {bytes(r["key"]): r["ends_sha256"] for r in trie.ended(of.sparkSession.createDataFrame([(b"k", [5, 1]), (b"k", [-4, 9, 2]), (b"l", [3]), (b"m", [])], "key binary, ends array<long>")).collect()}
    assert ends == {b"k": hashlib.sha256(b"-4,1,2,5,9").hexdigest(), b"l": hashlib.sha256(b"3").hexdigest()}
    assert trie.prefix_trie(convs.limit(0)).count() == 0
    assert trie.prefix_trie(convs).where("depth = 0").first()["n_convs"] == len({r[0] for r in rows} - {None})


def test_a_family_of_many_nodes_is_handed_on_in_parts(spark, rows, monkeypatch):
    import pyarrow as pa

    some = sorted((c - int(abs(c) % 20) * (1 if c >= 0 else -1), c != c - int(abs(c) % 20) * (1 if c >= 0 else -1), c) for c in ordered(rows) if c is not None)
    by = ordered(rows)
    laid = [(f, c, hashlib.sha256(repr(t).encode()).digest(), 1) for f, _, c in some for t in by[c]]
    batch = lambda part: pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in zip(("family", "conv_id", "item", "words"), zip(*part, strict=True), strict=True)})

    def merged(parts):
        out = {}
        for b in trie.families(iter(parts)):
            for r in b.to_pylist():
                o = out.setdefault(r["key"], [r["ups"], r["depth"], r["words"], r["conv_id"], 0, []])
                assert o[:3] == [r["ups"], r["depth"], r["words"]]
                o[3], o[4], o[5] = min(o[3], r["conv_id"]), o[4] + r["n_convs"], sorted(o[5] + r["ends"])
        return out

    whole = merged([batch(laid)])
    monkeypatch.setattr(trie, "HELD", 3)
    assert merged([batch(laid[i : i + 7]) for i in range(0, len(laid), 7)]) == whole


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, key string"


def brute_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf_of = lambda i, t, l, s, n: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, l, n, t)))
    trees = {}
    for i, t, lang, s, n, *_ in rows:
        low = t if t is None or i is None or zlib.crc32(str(i).encode()) % 3 else re.sub("[A-Z]", lambda m: m[0].lower(), t)
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf_of(i, t, lang, s, n), leaf_of(i, low, lang, s, n)))

    def grow(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = a // 8 * 8
                paths[k].append((nodes[run:a], nodes[a + 1 : run + 8]))
                at[k] = a // 8
            nodes = [h("".join(nodes[r : r + 8])) for r in range(0, len(nodes), 8)]
        return nodes[0] if nodes else None, paths

    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    sub = {}
    for lang in order:
        trees[lang].sort()
        sub[lang] = grow([t[2] for t in trees[lang]])
    root, tops = grow([sub[lang][0] for lang in order])
    out = []
    for g, lang in enumerate(order):
        for (known, i, leaf, handed), path in zip(trees[lang], sub[lang][1], strict=True):
            for left, right in path + tops[g]:
                handed = h("".join(left) + handed + "".join(right))
            out.append((i if known else None, leaf, sub[lang][0], root, h("".join("".join(a + b) for a, b in path + tops[g])), handed, handed == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    out = [(i, rng.choice(["Some Text", "plain", "É È", "", None]) if i % 3 else f"Text {i}", "en", f"s{i % 3}", i) for i in range(600)]
    out += [(i, f"Text {i}", "fr", None, None) for i in range(1000, 1009)] + [(i, "X", None, "s", 1) for i in range(2000, 2008)] + [(3, "One", "de", "s", 1)]
    out += [(None, "No Id", "en", "s", 1), (None, None, None, None, None), (5, "Twice", "en", "s", 1), (5, "Twice", "en", "s", 1), (5, "twice", "en", "s", 1), (7, "Long Words " * 30_000, "", "é", 2)]
    return [(*r, "x", 1, "k") for r in out]


@pytest.mark.parametrize("small", [8192, 3])
def test_manifest_against_brute_force(spark, docs, monkeypatch, small):
    monkeypatch.setattr(merkle, "SMALL", small)  # levels broadcast, and levels shuffled
    proofs = lambda rows: sorted((tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, DOCS).repartition(3), claimed=queries.tampered()).collect()), key=str)
    assert proofs(docs) == brute_manifest(docs)
    if small == 3:
        return
    for n in (0, 1, 2, 8, 9):
        assert proofs(docs[:n]) == brute_manifest(docs[:n])
    assert proofs(docs[-7:-6]) == brute_manifest(docs[-7:-6])
    honest = merkle.proofs(spark.createDataFrame(docs, DOCS))
    assert honest.where("verified").count() == len(docs)


def test_numbered_has_every_place_once(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([1, 1, 1, 2, None, rng.randrange(100)]), "i") for _ in range(900)]
    got = merkle.numbered(spark.createDataFrame(rows, "g string, v int, n string").repartition(4), ["g"], ["v"], "t").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["index"], r["v"], r["size"]))
    for g, v in by.items():
        v.sort(key=lambda r: r[0])
        own = sorted((r[1] for r in rows if r[0] == g), key=lambda x: (x is not None, x or 0))
        assert [(r[0], r[1]) for r in v] == list(enumerate(own)) and {r[2] for r in v} == {len(own)}


def test_crc_in_sql():
    for text in ("0", "7", "-7", "123456789", "90210"):
        assert duckdb.sql(f"select {queries.crc_sql('t')} from (select '{text}' as t)").fetchall()[0][0] == zlib.crc32(text.encode())
