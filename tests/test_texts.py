"""Proposals, evidence, tags, facts and recorded payloads on small inputs, edge cases included."""

import json

from pyspark.sql import functions as F

from lodestone.functions import display, tagging
from lodestone.operators import evidence, graph, portfolio, proposals, reads, search
from lodestone.sources import feeds


def test_each_check_of_a_proposal_turns_away_its_own(spark):
    said = "Acme Corp supplies   Zeta’s plants with steel, the company said. Acme Corp and Zeta met in Oslo on Monday."
    docs = spark.createDataFrame([(1, said), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("acme corp", "acme"), ("acme", "acme"), ("zeta", "zeta")], "name string, slug string")
    good, met = "acme corp supplies Zeta's plants with steel", "Acme Corp and Zeta met in Oslo on Monday."
    rows = [(1, "Acme Corp", " ZETA ", "supplies", good), (1, "Nobody", "Zeta", "supplies", good), (1, "Acme", "Acme Corp", "supplies", good), (1, "Acme", "Zeta", "loves", good), (1, "Acme", "Zeta", "uses", good),
            (1, "Acme", "Zeta", "supplies", "Acme supplies"), (2, "Acme", "Zeta", "supplies", good), (1, "Acme", "Zeta", "supplies", "plants with steel, the company said"), (1, "Acme", "Zeta", "supplies", met), (1, None, None, None, None)]
    checked = proposals.validate(spark.createDataFrame(rows, "doc_id long, source string, target string, relation string, quote string"), docs, names)
    n = {r["reason"]: r["n"] for r in proposals.causes(checked).collect()}
    assert n == {"accepted": 1, "unknown_entity": 2, "self_relationship": 1, "unknown_relation": 1, "relation_not_extractable": 1, "quote_not_in_source": 2, "quote_missing_an_entity": 1, "quote_lacks_relational_cue": 1}
    assert [r["confidence"] for r in checked.where("confidence is not null").collect()] == [0.55]


def test_evidence(spark):
    cols = "question string, source long, title string, published_at timestamp, text string, score double, matched_by string, similarity double"
    at = __import__("datetime").datetime(2024, 5, 1)
    e = spark.createDataFrame([("q", 1, "A", at, "x" * 2000, 0.03, "keyword+vector", 0.7), ("q", 2, None, None, None, 0.02, "vector", 0.2), ("q", 3, "C", at, "c", 0.001, "keyword", None), ("r", 4, "D", at, "d", 0.5, "keyword", None)], cols)
    kept = evidence.supported(e, 0.5)
    assert sorted(r["source"] for r in kept.collect()) == [1, 2]  # r has no similarity: refused
    assert evidence.confidence(kept).first()["confidence"] == round(0.4 * 2 / 6 + 0.35 + 0.25 / 2, 3)
    assert evidence.context(kept).first()["context"] == "[1] A (2024-05-01)\n" + "x" * 900 + "\n\n[2] Untitled (undated)\n"
    turns = spark.createDataFrame([("c", 1, "user", "What of Acme?"), ("c", 2, "bot", "Up."), ("c", 3, "user", "And its volume?"), ("d", 1, "user", "Is it up?"), ("d", 2, "user", None)], "conv_id string, turn long, role string, text string")
    assert {(r["conv_id"], r["turn"]): r["resolved"] for r in evidence.resolved(turns).collect()} == {("c", 1): "What of Acme?", ("c", 3): "What of Acme? And its volume?", ("d", 1): "Is it up?", ("d", 2): None}
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "v array<double>")
    assert evidence.relevance_floor(v, "v", [[1.0, 0.0]], [[1.0, 1.0]]).first()["floor"] == 0.854
    assert evidence.relevance_floor(v, "v", [[1.0, 1.0]], [[1.0, 0.0]]).first()["floor"] is None


def test_tags_and_facts(spark):
    df = spark.createDataFrame([("u1", "Acme Inc. beats Zeta, zetas lag; chip acme", ["X"]), ("u2", "nothing", []), ("u3", None, ["Y"])], "url string, text string, asserted array<string>")
    out = tagging.normalise(tagging.tag(df, "text", {"zeta": ["zeta"], "acme": ["acme", "acme inc."]}, {"chips": ["chip"]}, {"zeta": ["Z"], "acme": ["A", "X"]}))
    got = {r["url"]: r for r in out.collect()}
    assert sorted(got) == ["u1", "u3"] and got["u1"]["companies"] == ["acme", "zeta"] and got["u1"]["tickers"] == ["X", "A", "Z"] and got["u1"]["tags"] == ["chips"]
    assert got["u1"]["keywords"][:2] == ["acme", "zeta"] and got["u3"]["tickers"] == ["Y"] and got["u3"]["companies"] == []
    m = spark.createDataFrame([(4.656e12,), (-2.5e9,), (1e6,), (999.5,), (None,)], "x double")
    assert [r[0] for r in m.select(display.money(F.col("x"))).collect()] == ["4.66 trillion USD", "-2.50 billion USD", "1.00 million USD", "999.50 USD", None]
    one = spark.createDataFrame([(1234567, None, 2.5)], "a long, b string, c double")
    assert one.select(display.fact_lines(one, [(c, display.shown(one, c)) for c in "abc"])).first()[0] == "[1] a: 1,234,567\n[2] c: 2.50"
    step = spark.createDataFrame([("a", "b", False, "invests_in"), ("a", "b", True, "odd")], "here string, there string, forward boolean, kind string")
    assert [r["phrase"] for r in graph.phrases(step).collect()] == ["a → is backed by → b", "a → odd → b"]
    lists = spark.createDataFrame([("u", "b", 1), ("u", "a", 1), ("v", "c", 3)], "user string, name string, created_at int")
    assert sorted(r["name"] for r in portfolio.with_default(lists).where("is_default").collect()) == ["a", "c"]


def test_payloads(spark, tmp_path):
    (tmp_path / "candles.json").write_text(json.dumps({"meta": {"symbol": "ACM"}, "status": "ok", "values": [{"datetime": "2024-05-02 09:30:00", "open": "1.5", "high": "2", "low": "1", "close": "2", "volume": "7"}, {"datetime": "2024-05-01", "open": "1", "high": "2", "low": "1", "close": "1.5"}, {"datetime": "2024-04-30", "open": "x", "high": "2", "low": "1", "close": "1"}]}))
    (tmp_path / "error.json").write_text(json.dumps({"code": 404, "status": "error", "message": "no such symbol"}))
    bars = feeds.json_candles(spark, str(tmp_path / "*.json")).orderBy("at").collect()
    assert [(float(b["open"]), b["volume"]) for b in bars] == [(1.0, 0), (1.5, 7)]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(json.dumps({"c": 2.0, "d": 1, "dp": 100.0, "h": 2, "l": 1, "o": 1, "pc": 1.0, "t": 0}))
    (tmp_path / "q" / "b.json").write_text(json.dumps({"c": 0, "d": None, "dp": None, "h": 0, "l": 0, "o": 0, "pc": 0, "t": 0}))
    assert [r["price"] for r in feeds.json_quotes(spark, str(tmp_path / "q")).collect()] == [2.0]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"ticker": "ACM", "marketCapitalization": 1.5, "shareOutstanding": 2, "ipo": "1999-01-22"}))
    (tmp_path / "p" / "b.json").write_text("{}")
    assert [(r["market_value"], r["shares"], str(r["ipo"])) for r in feeds.json_profiles(spark, str(tmp_path / "p")).collect()] == [(1.5e6, 2e6, "1999-01-22")]
    bar = spark.createDataFrame([("a", "2024-01-31", 1.0), ("a", "2024-02-01", 2.0), ("a", "2024-02-02", 3.0)], "symbol string, session string, p double").select("symbol", F.to_date("session").alias("session"), *[F.col("p").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"))
    assert [(r["open"], r["close"]) for r in reads.candles(bar, "MAX", "2024-02-02").orderBy("start").collect()] == [(1.0, 1.0), (2.0, 3.0)]
    assert reads.candles(bar, "1D", "2024-02-02").count() == 1
    df = spark.createDataFrame([(320193, ["10-K", "8-K"], ["2024-01-02", "never"], ["0000320193-24-000001", "x"])], "cik long, form array<string>, date array<string>, accession array<string>")
    assert [(r["cik"], r["form"], r["url"][-18:]) for r in feeds.filings(df).collect()] == [("0000320193", "10-K", "000032019324000001")]
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"title": "T", "url": "u", "publishedAt": "2024-05-01T10:00:00Z"}, {"title": "[Removed]", "url": "v", "publishedAt": "2024-05-01T10:00:00Z"}, {"title": "W", "url": "w", "publishedAt": "soon"}]}))
    assert [str(r["published_at"]) for r in feeds.json_articles(spark, str(tmp_path / "n.json")).collect()] == ["2024-05-01 10:00:00"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>a</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item><item><title>B</title><link>b</link><pubDate>?</pubDate></item></channel></rss>")
    assert [(r["url"], str(r["published_at"])) for r in feeds.rss_items(spark, str(tmp_path / "f.xml")).collect()] == [("a", "2024-05-01 10:00:00")]
    assert feeds.rss_items(spark, str(tmp_path / "f.xml"), "2024-06-01").count() == 0


def test_extraction_takes_four_of_a_document_and_keeps_reviews(spark):
    from lodestone.operators import proposals

    ends = ["acme", "bolt", "corp", "dune", "echo"]
    names = spark.createDataFrame([(n, n) for n in ends], "name string, slug string")
    text = "acme supplies parts to bolt, to corp, to dune and to echo each year"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "acme alone supplies no one here at all"), (4, text)], "doc_id long, text string")
    made = [(d, a, b, "supplies", text) for d in (1, 2, 4) for a in ends for b in ends if a < b] + [(3, "acme", "bolt", "supplies", "acme alone supplies no one here")]
    asked = spark.createDataFrame(made, "doc_id long, source string, target string, relation string, quote string")
    mentions = spark.createDataFrame([(d, e) for d in (1, 2, 4) for e in ends] + [(3, "acme")], "doc_id long, entity string")
    stored = spark.createDataFrame([("acme", "bolt", "supplies", 9, 0.5, "refused")], "source_slug string, target_slug string, relation string, doc_id long, confidence double, status string")
    got = {(r["source_slug"], r["target_slug"]): (r["doc_id"], r["status"]) for r in proposals.extract(docs, asked, names, mentions, stored, 3).collect()}
    assert got == {("acme", "bolt"): (9, "refused"), ("acme", "corp"): (2, "pending"), ("acme", "dune"): (2, "pending"), ("acme", "echo"): (2, "pending")}


def test_longer_aliases_are_found_whole(spark):
    from lodestone.functions import tagging

    d = spark.createDataFrame([("the acme steel works",)], "t string")
    out = tagging.tag(d, "t", {"a": ["acme", "acme steel"]}, {}, {}).first()
    assert list(out["keywords"]) == ["acme steel"]


def test_narratives_are_told_once_a_kind(spark):
    """Events of one kind share the news: lines are made by kind, and explanations are those of each event's own news."""
    kinds = [("S1", "Ther Co", "up"), ("S2", None, "down")]
    rows = [(i, *kinds[i % 2], f"1996-01-0{i % 3 + 2}", ["return", "volume"][i % 2], i / 100) for i in range(30)]
    e = spark.createDataFrame(rows, "event_id long, symbol string, name string, direction string, day string, feature string, value double").withColumn("session", F.to_date("day"))
    e = e.withColumn("close_at", F.col("session").cast("timestamp_ntz") + F.expr("interval 21 hours")).drop("day")
    told = [(i, f"1996-01-0{i % 4 + 1} 12:00:00", f"ther {i}" if i % 2 else None, None, ["s1"] if i % 3 else ["S2"], ["t"] * (i % 2), ["bullish", "bearish"][i % 2]) for i in range(40)]
    news = spark.createDataFrame(told, "article long, at string, title string, summary string, tickers array<string>, tags array<string>, label string").withColumn("published_at", F.col("at").cast("timestamp_ntz"))
    by, each = search.by_kind(e, news), search.correlate(e, news)
    assert "event_id" not in by.columns and by.count() < each.count() / 3
    got = lambda found: sorted(map(tuple, search.narrative(e, found).collect()))
    assert len(got(by)) == 30 and got(by) == got(each)


def test_narratives_know_all_news_of_the_window(spark):
    """Of 60 articles before a close the three oldest alone name the company: 57 newer ones don't hide them."""
    e = spark.createDataFrame([(1, "S1", "Ther Co", "up", "1996-01-05", "return", 0.1)], "event_id long, symbol string, name string, direction string, day string, feature string, value double").withColumn("session", F.to_date("day"))
    e = e.withColumn("close_at", F.col("session").cast("timestamp_ntz") + F.expr("interval 21 hours")).drop("day")
    told = [(i, f"1996-01-0{3 + i // 24} {i % 24:02d}:00:00", "ther speaks" if i < 3 else "silence", None, ["s1"] if i < 3 else [], ["t"], "bullish") for i in range(60)]
    told += [(90, "1996-01-02 20:00:00", "ther speaks", None, ["s1"], ["t"], "bullish"), (91, "1996-01-06 22:00:00", "ther speaks", None, ["s1"], ["t"], "bullish")]
    news = spark.createDataFrame(told, "article long, at string, title string, summary string, tickers array<string>, tags array<string>, label string").withColumn("published_at", F.col("at").cast("timestamp_ntz"))
    all_of, newest = search.by_kind(e, news), search.by_kind(e, news, 40)
    assert sorted(r["article"] for r in all_of.collect()) == [0, 1, 2]
    assert min(r["article"] for r in newest.collect()) >= 20
    assert search.narrative(e, all_of).first()["documents"] == [2, 1, 0]
