"""Text, retrieval and correlation queries, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import keyword_index, merge, reads, search, vector_index
from lodestone.sources.shared import folder

from .domain import anomalies, articles, bars, table
from .queries import BARS, query
from .read_queries import ANOMALIES, ARTICLES

BULL, BEAR, TURN = {"the": 1.013, "that": 0.8317, "of the": 0.4733}, {"in": 0.9171, "and": 1.0739}, ["of", "to"]


def side_sql(terms: dict[str, float]) -> str:
    turned = f"i > 1 and list_has_any(w[greatest(1, i - {text.NEAR}):i - 1], {TURN})"
    single = " ".join(f"when x = '{k}' then {v}" for k, v in terms.items() if " " not in k)
    phrases = "".join(f" + (length(low) - length(replace(low, '{k}', ''))) / {len(k)} * {v}" for k, v in terms.items() if " " in k)
    return f"greatest(0, coalesce(list_sum([(case {single} else 0 end) * case when {turned} then -1 else 1 end for x, i in w]), 0){phrases})"


def lexicon_sql(rows: str, key: str) -> str:
    """Of rows (key, t): bull, bear, polarity, label, confidence."""
    return f"""lex_w as (select {key}, lower(coalesce(t, '')) as low, regexp_extract_all(lower(coalesce(t, '')), '[a-z'']+') as w from {rows}),
 lex_s as (select {key}, {side_sql(BULL)} as bull, {side_sql(BEAR)} as bear from lex_w),
 lex_p as (select *, coalesce((bull - bear) / nullif(bull + bear, 0), 0.0) as p from lex_s),
 lexed as (select {key}, bull::double as bull, bear::double as bear, round(p, 4) as polarity, case when abs(p) < 0.15 then 'neutral' when p > 0 then 'bullish' else 'bearish' end as label,
 round(case when bull + bear = 0 then 0.35 else least(0.95, 0.4 + 0.55 * abs(p) * least((bull + bear) / 6, 1.0)) end, 4) as confidence from lex_p)"""


@query(f"with docs as (select doc_id, text as t from documents), {lexicon_sql('docs', 'doc_id')} select doc_id, round(bull, 4) as bull, round(bear, 4) as bear, polarity, label, confidence from lexed")
def lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    out = text.sentiment(table(spark, d, "documents").select("doc_id", "text"), "text", BULL, BEAR, TURN).drop("text")
    return out.withColumns({"bull": F.round("bull", 4), "bear": F.round("bear", 4)})


@query(f"""with {ARTICLES}, waiting as (select url_hash, case when trim(coalesce(summary, '')) <> '' then title || '. ' || summary else title end as t from articles where sentiment is null and published_at >= timestamp '1996-01-02' order by published_at, article limit 150),
 {lexicon_sql('waiting', 'url_hash')} select url_hash, coalesce(label, sentiment) as sentiment from articles left join lexed using (url_hash)""")
def score_pending(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    waiting = reads.unscored(a, "1996-01-02", 150).select("url_hash", text.scoring_text(F.col("title"), F.col("summary")).alias("t"))
    scored = text.sentiment(waiting, "t", BULL, BEAR, TURN).select("url_hash", F.col("label").alias("sentiment"))
    return merge.coalesce_set(a.select("url_hash", "sentiment"), scored, "url_hash", "sentiment")


NAMES = [("junk", "trash", None, None), ("jester", "clown", ["moron"], "IT"), ("within", "in the", ["of and"], "erth.ed")]


@query(r"""with names as (select * from (values ('junk', 'trash'), ('jester', 'clown'), ('jester', 'moron'), ('within', 'in the'), ('within', 'of and')) v(entity, s)),
 m as (select doc_id, entity, length(regexp_extract(lower(coalesce(text, '')), '(?s)^(.*?(?:^|[^\p{L}\p{N}_]))' || s || '(?:$|[^\p{L}\p{N}_])', 1)) as pos, lower(coalesce(text, '')) as low, s from documents, names)
 select doc_id, entity, cast(min(pos) as int) as first from m where regexp_matches(low, '(^|[^\p{L}\p{N}_])' || s || '($|[^\p{L}\p{N}_])') group by all""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    names = text.surfaces(spark.createDataFrame(NAMES, "slug string, name string, aliases array<string>, symbol string"))
    return text.mentions(table(spark, d, "documents"), "doc_id", "text", names)


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping passages: each start depends on the last end, so there is no SQL; tests hold them against a plain version."""
    return text.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The hash is none that SQL has; tests hold the vectors against a plain version."""
    return text.embeddings(table(spark, d, "documents"), "text").select("doc_id", "embedding")


@query("select doc_id, length(t) as chars, floor(length(t) / 4)::int as tokens from (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') as t from documents)")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("chars"), text.token_count(F.col("t")).alias("tokens"))


@query(f"with {ARTICLES} select article, sha256(title || case when trim(coalesce(summary, '')) <> '' then chr(10) || chr(10) || summary else '' end || chr(10) || chr(10) || url_hash) as digest, len(tickers) as tickers from articles where trim(title) <> ''")
def index_text(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).where("trim(title) <> ''")
    return a.select("article", F.sha2(text.indexable(F.col("title"), F.col("summary"), F.col("url_hash")), 256).alias("digest"), F.size("tickers").cast("long").alias("tickers"))


@query("select c_custkey, 1 as place, c_nationkey as value from customer where c_custkey % 4 <> 0 union all select c_custkey, 2, c_nationkey + 1 from customer where c_custkey % 4 <> 0")
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("c_custkey"), F.col("c_nationkey")
    said = F.format_string('Here you are: [{"v": %d}, {"v": %d}] as asked', v, v + 1)
    c = table(spark, d, "customer").select(k, F.when(k % 4 != 0, said).when(k % 8 == 0, "nothing found").otherwise("] odd [").alias("reply"))
    found = c.select("c_custkey", F.posexplode(text.json_objects(F.col("reply"), "struct<v: int>")).alias("p", "o"))
    return found.select("c_custkey", (F.col("p") + 1).alias("place"), F.col("o.v").alias("value"))


QUERY_SET = "q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0)"
NEAREST = f"{QUERY_SET}, near as (select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from (select query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.v), 6) as similarity from embeddings e, q))"


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"with {NEAREST} select query_id, vec_id, similarity, rank from near where rank <= 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_topk(table(spark, d, "embeddings"), question_vectors(spark, d), "vec_id", "embedding", 20)


def embedding_index(spark: SparkSession, d: str) -> vector_index.Index:
    at = (spark.sparkContext.applicationId, d, "vectors")
    if at not in INDEXES:
        INDEXES[at] = vector_index.write(table(spark, d, "embeddings"), "vec_id", "embedding", f"{folder(spark)}/vectors-{uuid.uuid4().hex}", keep=("label",))
    return INDEXES[at]


@query(f"with {NEAREST} select query_id, vec_id, similarity, rank from near where rank <= 20")
def vector_exact(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows from the index: cells are read on until no other can hold one."""
    return vector_index.search(embedding_index(spark, d), question_vectors(spark, d), 20, exact=True).withColumnRenamed("key", "vec_id")


@query(f"""with q as (select vec_id as query_id, embedding as query from embeddings where vec_id % 50 = 0),
 s as (select query_id, vec_id, coalesce(round(list_cosine_similarity(query::double[], embedding::double[]), 6), 0) as similarity from q join embeddings on label in (1, 3) and len(embedding) = len(query))
 select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s qualify rank <= 10""")
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two labels alone: the condition goes into the scan of the cells."""
    found = vector_index.search(embedding_index(spark, d), question_vectors(spark, d), 10, where=F.col("label").isin(1, 3), exact=True)
    return found.withColumnRenamed("key", "vec_id")


@query()
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """(queries, recall, probes, share_read): what probing finds of each query's 20 nearest, and how much of the index it reads."""
    index, asked = embedding_index(spark, d), question_vectors(spark, d)
    near = vector_index.search(index, asked, 20).select("query_id", F.col("key").alias("vec_id"))
    exact = search.vector_topk(table(spark, d, "embeddings"), asked, "vec_id", "embedding", 20).select("query_id", "vec_id", F.lit(1).alias("hit"))
    met = exact.join(near.withColumn("found", F.lit(1)), ["query_id", "vec_id"], "left")
    share = vector_index.share_read(index, asked)
    return met.agg(F.countDistinct("query_id").alias("queries"), (F.sum("found") / F.count("hit")).alias("recall")).select("queries", "recall", F.lit(index.probes).alias("probes"), F.lit(share).alias("share_read"))


WORDS = ["stupid", "trash", "clown"]
HITS = "hits as (select doc_id, word, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents) where word in ('stupid', 'trash', 'clown') group by all)"
SCORED = f"{HITS}, scored as (select doc_id, round(sum((1 + ln(tf)) * ln(1 + (select count(*) from documents) / df)), 6) as score from hits join (select word, count(*) as df from hits group by word) using (word) group by doc_id)"


#: Indexes of this driver, by application and table folder: written by the first query that asks, read by the others.
INDEXES: dict[tuple[str, str, str], keyword_index.Index | vector_index.Index] = {}


def document_index(spark: SparkSession, d: str) -> keyword_index.Index:
    at = (spark.sparkContext.applicationId, d, "keywords")
    if at not in INDEXES:
        index = keyword_index.Index(f"{folder(spark)}/keywords-{uuid.uuid4().hex}")
        keyword_index.write(index, table(spark, d, "documents"), "doc_id", "text")
        INDEXES[at] = index
    return INDEXES[at]


def asking(spark: SparkSession, *questions: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, words array<string>")


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)
 select term, count(distinct doc_id) as df, count(*) as occurrences from t group by term""")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    """The index's vocabulary, from its postings."""
    rows = document_index(spark, d).postings(spark)
    return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("occurrences"))


@query(f"with {SCORED} select doc_id, score from scored order by score desc, doc_id limit 20")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    found = keyword_index.search(document_index(spark, d), asking(spark, WORDS), 20)
    return found.select(F.col("key").alias("doc_id"), "score")


@query(f"with {SCORED} select doc_id, score from scored order by score desc, doc_id limit 20")
def keyword_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: one scan of the texts."""
    return search.keyword_topk(table(spark, d, "documents"), "doc_id", "text", WORDS, 20)


@query(f"with {SCORED}, {ARTICLES} select doc_id, score from scored join articles on article = doc_id where published_at >= timestamp '1996-01-06' and list_has_any(tickers, ['Brand#2', 'Brand#4', 'Brand#6', 'Brand#8']) order by score desc, doc_id limit 10")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    some = articles(spark, d).select(F.col("article").alias("key"), F.transform("tickers", lambda t: F.upper(t)).alias("tickers"), "published_at")
    allowed = search.passing(some, ["brand#2", "brand#4", "brand#6", "brand#8"], "1996-01-06").select("key")
    found = keyword_index.search(document_index(spark, d), asking(spark, WORDS), 10, allowed)
    return found.select(F.col("key").alias("doc_id"), "score")


ALL_HITS = "hits as (select doc_id, word, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from {0}) group by all)"


@query(f"""with {ALL_HITS.format("documents")}, q as (select doc_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8])) as word from documents where doc_id % 50 = 0),
 w as (select query_id, word, ln(1 + (select count(*) from documents) / df) as idf from q join (select word, count(*) as df from hits group by word) using (word)),
 s as (select query_id, doc_id, round(sum((1 + ln(tf)) * idf), 6) as score from w join hits using (word) group by all)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 10""")
def keyword_questions(spark: SparkSession, d: str) -> DataFrame:
    """Many questions in one pass: the first words of every fiftieth document."""
    asked = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.slice(keyword_index.terms(F.col("text")), 1, 8).alias("words"))
    return keyword_index.search(document_index(spark, d), asked, 10).withColumnRenamed("key", "doc_id")


@query(f"""with now as (select doc_id, case when doc_id % 5 = 0 then coalesce(text, '') || ' stupid trash' else text end as text from documents where doc_id % 5 = 0 or doc_id % 7 <> 3),
 {ALL_HITS.format("now")}, s as (select doc_id, round(sum((1 + ln(tf)) * ln(1 + (select count(*) from now) / df)), 6) as score from hits join (select word, count(*) as df from hits group by word) using (word) where word in ('stupid', 'trash', 'clown') group by doc_id)
 select doc_id, score from s order by score desc, doc_id limit 20""")
def keyword_updates(spark: SparkSession, d: str) -> DataFrame:
    """An index of all documents, then a second segment that replaces some and deletes others."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = keyword_index.Index(f"{folder(spark)}/keywords-{uuid.uuid4().hex}")
    keyword_index.write(index, docs, "doc_id", "text")
    new = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" stupid trash")))
    keyword_index.update(index, new, "doc_id", "text", docs.where("doc_id % 7 = 3").select("doc_id"))
    return keyword_index.search(index, asking(spark, WORDS), 20).select(F.col("key").alias("doc_id"), "score")


@query(f"""with {NEAREST}, {HITS}, one as (select word, doc_id, round((1 + ln(tf)) * ln(1 + (select count(*) from documents) / df), 6) as score from hits join (select word, count(*) as df from hits group by word) using (word)),
 ranked as (select word, doc_id, row_number() over (partition by word order by score desc, doc_id) as rank from one qualify rank <= 100),
 kw as (select query_id, doc_id, rank from q join ranked on word = {WORDS}[(query_id // 50) % 3 + 1]),
 b as (select query_id, doc_id, rank, 'keyword' as side, null as similarity from kw union all select query_id, vec_id, rank, 'vector', similarity from near where rank <= 200)
 select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score, string_agg(side, '+' order by side) as matched_by, coalesce(max(rank) filter (where side = 'keyword'), 0)::int as keyword_rank, coalesce(max(rank) filter (where side = 'vector'), 0)::int as vector_rank, max(similarity) as similarity,
 row_number() over (partition by query_id order by round(sum(1 / (60 + rank)), 6) desc, doc_id) as place from b group by query_id, doc_id qualify place <= 20""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    questions = question_vectors(spark, d)
    vector = search.vector_topk(table(spark, d, "embeddings"), questions, "vec_id", "embedding", 200).withColumnRenamed("vec_id", "doc_id")
    asked = questions.select("query_id", F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(F.col("query_id") / 50) % 3 + 1).cast("int")).alias("word"))
    ranked = keyword_index.search(document_index(spark, d), asking(spark, *[[w] for w in WORDS]), 100)
    ranked = ranked.select(F.element_at(F.array(*map(F.lit, WORDS)), (F.col("query_id") + 1).cast("int")).alias("word"), F.col("key").alias("doc_id"), "rank")
    keyword = asked.join(F.broadcast(ranked), "word").select("query_id", "doc_id", "rank")  # 300 rows at most
    fused = search.fuse(keyword, vector, "doc_id", 20)
    return fused.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("keyword_rank", "vector_rank")})


@query("""with e as (select doc_id as citation, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01')) as sentence, cast(unnest(range(len(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01')))) as int) as nth from documents),
 s as (select citation, nth, trim(sentence, ' ') as sentence from e)
 select citation, nth, round(len(list_distinct(list_intersect(['stupid', 'clown', 'moved', 'trash'], regexp_extract_all(lower(sentence), '[a-z0-9'']+')))) / 4, 6) as score from s where length(sentence) >= 30 and score > 0 order by score desc, citation, nth limit 5""")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("citation"), "text")
    return search.answer_sentences(passages, "Which stupid clown moved the trash?").select("citation", "nth", "score")


EVENTS = f"""{ANOMALIES}, ev as (select id as event_id, symbol, case when id % 2 = 0 then 'Ther Holdings' else 'The Ntion Corp.' end as name, case when id % 2 = 0 then 'ther' else 'ntion' end as token, session, session + interval 21 hour as close_at, feature, direction, value from anomalies)"""
#: The newest articles of a window that ``news_correlation`` scores; ``news_narrative`` scores all.
NEWEST = " qualify row_number() over (partition by close_at order by published_at desc, article) <= 40"


def correlated_sql(newest: str) -> str:
    """Events, and their best news among what ``newest`` leaves of each window."""
    return f"""{EVENTS}, {ARTICLES}, closes as (select distinct close_at from ev),
 cut as (select close_at, a.* from closes join articles a on published_at between close_at - interval 72 hour and close_at + interval 24 hour{newest}),
 m as (select event_id, article, title, tags, epoch(e.close_at - published_at) / 3600 as h, list_contains(tickers, symbol) as filed, contains(lower(title || ' ' || coalesce(summary, '')), lower(symbol)) or contains(lower(title || ' ' || coalesce(summary, '')), token) as named,
  coalesce((direction = 'up' and sentiment = 'bullish') or (direction = 'down' and sentiment = 'bearish'), false) as agrees from ev e join cut using (close_at)),
 cand as (select event_id, article, title, filed, coalesce(named, false) as named, agrees, round(h, 1) as hours_before,
  round(0.20 * filed::int + 0.30 * coalesce(named, false)::int + 0.25 * case when h >= 0 then greatest(0, 1 - h / 72) else 0.5 * greatest(0, 1 + h / 72) end + 0.20 * agrees::int + 0.05 * (len(tags) > 0)::int, 4) as score from m where filed or named or len(tags) > 0),
 best as (select *, cast(row_number() over (partition by event_id order by score desc, article) as int) as place from cand qualify place <= 3)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("id") % 2 == 0
    return anomalies(spark, d).select(
        F.col("id").alias("event_id"), "symbol", F.when(even, "Ther Holdings").otherwise("The Ntion Corp.").alias("name"), "session",
        (F.col("session").cast("timestamp_ntz") + F.expr("interval 21 hours")).alias("close_at"), "feature", "direction", "value",
    )


def news(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).withColumnRenamed("sentiment", "label")


@query(f"with {correlated_sql(NEWEST)} select event_id, article, score, filed as source_attributed, named as named_in_text, agrees as sentiment_agrees, hours_before, place from best")
def news_correlation(spark: SparkSession, d: str) -> DataFrame:
    return search.correlate(events(spark, d), news(spark, d)).drop("title")


@query(f"""with {correlated_sql('')}, lines as (select event_id, bool_or(hours_before >= 0) as before, cast(count(*) as int) as documents, string_agg('  - ' || coalesce(title, '') || ' (' || case when named then 'names this company; ' when filed then 'filed under this ticker by the source; ' else '' end
  || case when agrees then 'sentiment agrees with the move; ' else '' end || format('{{:.0f}}', abs(hours_before)) || case when hours_before >= 0 then 'h before the close' else 'h after the close' end || ')', chr(10) order by place) as l from best group by event_id)
 select event_id, documents, sha256(symbol || ' ' || case when feature = 'volume' then 'traded on unusual volume' when feature = 'volatility' then 'showed unusual volatility' else case when direction = 'up' then 'rose' else 'fell' end || ' of ' || format('{{:.1f}}', value * 100) || '%' end
  || ' on ' || strftime(session, '%Y-%m-%d') || '.' || chr(10) || case when before then 'Possible contributing factors, ranked by relevance:' else 'No news published before the close was found in the corpus. The following covered the move afterwards and may describe, but cannot explain, it:' end
  || chr(10) || l || case when before then chr(10) || 'These are correlations in time and topic, not established causes.' else '' end) as digest from ev join lines using (event_id)""")
def news_narrative(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    told = search.narrative(e, search.by_kind(e, news(spark, d)))
    return told.select("event_id", F.size("documents").alias("documents"), F.sha2("explanation", 256).alias("digest"))


RANGES = {k: v for k, v in reads.CHARTS.items()}


def range_sql(name: str) -> str:
    days, every = RANGES[name]
    start = "session" if " " in every else f"date_trunc('{every}', session)::date"
    return f"select '{name}' as chart, symbol, {start} as start, max(high) as high, min(low) as low, cast(sum(volume) as bigint) as volume from bars where session > date '1998-06-29' - {days} and session <= date '1998-06-29' group by all"


@query(f"with {BARS} " + " union all ".join(map(range_sql, RANGES)))
def chart_ranges(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    each = [reads.candles(b, name, "1998-06-29").select(F.lit(name).alias("chart"), "symbol", F.to_date("start").alias("start"), "high", "low", "volume") for name in RANGES]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out
