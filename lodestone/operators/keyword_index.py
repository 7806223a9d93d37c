"""A stored inverted index: postings by hash of the term and block of documents, searched by pruning blocks."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from lodestone.sources.shared import kept

#: A term is a run of these in the lower-cased text.
TERM = "[a-z0-9]+"
#: The same by byte.
IN_TERM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Terms that are handed to the scan as values; of more questions the terms are joined.
LITERAL = 500
#: Scores are rounded to six places, so a block is left out only if its bound is under the last score by more.
SLACK = 2e-6
#: Files that a bucket of one segment is split into, by block, so that no task writes all of a common term: at the least
#: (fewer where there are fewer blocks than files), and one more for so many blocks.
SPLIT, SPLIT_BLOCKS = 4, 256
#: Bytes of text that a block has on average at the most (a longer document may be a block of its own), and blocks to a task.
BYTES, TASK = 1 << 23, 4
#: Of more than LITERAL terms: questions that meet so many blocks in a task, and cells (questions by documents) at a time.
CHUNK, PIECE, CELLS = 1 << 16, 32, 1 << 19
#: Documents of a block that have a bound of their own.
SUB = 32


@dataclass(frozen=True)
class Index:
    """An index at ``path``: ``buckets`` of terms, blocks of about ``block`` documents. Each segment writes new files.

    * ``postings`` (segment, bucket; term, block, n, most, total, keys, tfs): a term's documents in a block (keys as packed
      longs, tfs as packed ints: ``unpacked``), how many they are, the largest tf and their sum; sorted by term, so that row
      groups of a file hold a few terms.
    * ``docs`` (segment; key, block, size): what a segment holds, with the bytes of each text.
    * ``gone`` (by; segment, key, block): what segment ``by`` has replaced or deleted of those before it.
    """

    path: str
    buckets: int = 64
    block: int = 1024

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{POSTING}, segment int, bucket int").parquet(f"{self.path}/postings")

    def docs(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key long, block long, size long, segment int").parquet(f"{self.path}/docs")

    def gone(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("segment int, key long, block long, by int").parquet(f"{self.path}/gone").drop("by")

    def live(self, spark: SparkSession) -> DataFrame:
        return self.docs(spark).join(self.gone(spark), ["segment", "key"], "left_anti")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


@F.arrow_udf(ArrayType(StructType().add("key", LongType()).add("tf", IntegerType())))
def unpacked(keys: pa.Array, tfs: pa.Array) -> pa.Array:
    (key, n), tf = numbers(keys, np.int64), numbers(tfs, np.int32)[0]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.StructArray.from_arrays([pa.array(key), pa.array(tf)], names=["key", "tf"]))


@F.arrow_udf(BinaryType())
def packed(values: pa.Array) -> pa.Array:
    return binary(values.flatten().to_numpy(), pc.list_value_length(values).to_numpy())


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of packed ones, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return own.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """``values`` packed, ``n`` to a row."""
    ends = (np.cumsum([0, *n]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def classed(sized: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(octave, blocks): how many blocks each class of ``sized`` (key, size) has, and their sum; a row a class, some
    hundred at most. Blocks hold documents of like length (quarter octaves of bytes), since frequencies grow with it: the
    largest of a block is then near those of all its documents, and a bound that is made of it near their scores."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BYTES))
    rows = kept(sized.groupBy(octave().alias("octave")).agg(blocks.alias("blocks")), "classes")
    return rows, rows.agg(F.sum("blocks")).first()[0] or 0


def octave() -> Column:
    return F.ceil(4 * F.log2(F.col("size") + 1)).cast("long")


def placed(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """``sized`` (key, size) with its block: within a class a hash deals documents out."""
    met = sized.withColumn("octave", octave()).join(F.broadcast(classes), "octave")
    return met.withColumn("block", F.shiftleft("octave", 40) + F.pmod(F.xxhash64("key"), "blocks")).drop("octave", "blocks")


def write(index: Index, docs: DataFrame, key: str, text: str) -> None:
    """A new index of ``docs``, as segment 0. Keys are integers; rows of one key are one document,
    rows without a key are left out, null texts have no term."""
    nothing(docs.sparkSession).write.mode("overwrite").parquet(f"{index.path}/gone/by=0")
    add(index, docs, key, text, 0)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit(0).alias("segment"), F.col("id").alias("key"), F.col("id").alias("block"))


def update(index: Index, docs: DataFrame, key: str, text: str, deleted: DataFrame | None = None) -> None:
    """Adds ``docs`` as a segment of its own; they replace what the index has of their keys, and keys of ``deleted`` go.
    What is there stays as it is: its files are not read but for the keys that are replaced."""
    spark = docs.sparkSession
    number = index.docs(spark).agg(F.max("segment")).first()[0] + 1
    keys = docs.select(F.col(key).cast("long").alias("key"))
    keys = keys if deleted is None else keys.unionByName(deleted.select(F.col(key).cast("long").alias("key")))
    old = index.live(spark).join(keys.distinct(), "key", "left_semi").select("segment", "key", "block")
    old.write.mode("overwrite").parquet(f"{index.path}/gone/by={number}")
    add(index, docs, key, text, number)


def add(index: Index, docs: DataFrame, key: str, text: str, number: int) -> None:
    """Sizes are taken first, by Spark alone, so that each text travels once, to its block, and the block's postings once more."""
    each = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    own = each.withColumn("size", F.octet_length("text").cast("long"))
    sizes = kept(own.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "sizes")
    classes, blocks = classed(sizes, index.block)
    placed(sizes.drop("rows"), classes).select("key", "block", "size").write.mode("overwrite").parquet(f"{index.path}/docs/segment={number}")
    several = sizes.where("rows > 1").select("key", F.col("size").alias("all"))
    if not several.isEmpty():  # rows of one key go to the block of all its text
        own = own.join(several, "key", "left").withColumn("size", F.coalesce("all", "size")).drop("all")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // TASK)
    laid = placed(own, classes).select("block", "key", F.lower("text").alias("low")).repartition(tasks, "block").sortWithinPartitions("block", "key")
    lay(index, laid.mapInArrow(inverted, POSTING), number, blocks)


POSTING = "term string, block long, n int, most int, total long, keys binary, tfs binary"


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of rows (block, key, low) that are sorted so, a block at a time."""
    for (block,), part in runs(batches, ["block"]):
        key, row = np.unique(part["key"].to_numpy(), return_inverse=True)  # rows of one key are one document
        words, place = split(part["low"])
        if not len(words):
            continue
        coded, bits = words.dictionary_encode(), len(key).bit_length()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # what stands by term is sorted sooner later on
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        pair = np.sort((code << bits)[coded.indices.to_numpy()] | row[place])  # by term, then key
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        tf, pair = np.diff(first, append=len(pair)).astype(np.int32), pair[first]
        n, doc = np.bincount(pair >> bits), pair & ((1 << bits) - 1)
        at = np.cumsum(n) - n
        own = [coded.dictionary.take(pa.array(order)).cast(pa.string()), pa.array(np.full(len(n), block)), pa.array(n, pa.int32()), pa.array(np.maximum.reduceat(tf, at)), pa.array(np.add.reduceat(tf, at, dtype=np.int64)), binary(key[doc], n), binary(tf, n)]
        whole = pa.RecordBatch.from_arrays(own, names=["term", "block", "n", "most", "total", "keys", "tfs"])
        yield from (whole.slice(i, 10_000) for i in range(0, len(whole), 10_000))


def split(low: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts, repeats included, and the row of each: runs of bytes of IN_TERM that end with the text."""
    texts = pa.concat_arrays(low.cast(pa.large_string()).chunks)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    within = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)  # before a byte
    cut[ends] = True
    cut[1:-1] |= within[1:] != within[:-1]
    at, end = np.flatnonzero(within & cut[:-1]), np.flatnonzero(within & cut[1:]) + 1
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - at)])), pa.py_buffer(data[within])])
    return words, np.searchsorted(ends, at, side="right") - 1


def lay(index: Index, rows: DataFrame, number: int, blocks: int) -> None:
    """Writes the postings ``rows`` (POSTING) of so many ``blocks``: a task has one bucket, whose blocks come sorted by term."""
    split = max(1, min(SPLIT, blocks // index.buckets), blocks // SPLIT_BLOCKS)
    laid = rows.withColumn("bucket", index.bucket(F.col("term")))
    place = F.col("bucket") * split + F.pmod(F.xxhash64("block"), F.lit(split)).cast("int")
    laid = laid.repartitionById(index.buckets * split, place).sortWithinPartitions("bucket", "term", "block")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/segment={number}")


def compact(index: Index, spark: SparkSession, to: Index) -> None:
    """The index's live documents as one segment at another path, made from postings: no text is read again."""
    live = kept(index.live(spark), "live")
    classes, blocks = classed(live, to.block)
    found = kept(placed(live.select("key", "size"), classes), "placed")
    each = index.postings(spark).select("segment", "term", unpacked("keys", "tfs").alias("e")).select("segment", "term", F.inline("e"))
    counts = each.join(live.select("segment", "key"), ["segment", "key"], "left_semi").join(found.select("key", "block"), "key")
    nothing(spark).write.mode("overwrite").parquet(f"{to.path}/gone/by=0")
    rows = counts.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "tf"))).alias("e"), F.max("tf").alias("most"), F.sum("tf").alias("total"))
    lay(to, rows.select("term", "block", F.size("e").alias("n"), "most", "total", packed("e.key").alias("keys"), packed("e.tf").alias("tfs")), 0, blocks)
    found.select("key", "block", "size").write.mode("overwrite").parquet(f"{to.path}/docs/segment=0")


class Asked:
    """Questions (query_id, words) against an index, in two passes over the postings of their terms alone.

    A document's score is the sum of (1 + ln tf) * ln(1 + N / df) over a question's words, N and df of live documents.
    The first pass reads no entries: a block's bound for a question is the same sum with the block's largest
    frequencies. Blocks of the largest bounds are scored until they hold ``k`` documents; of the others only those
    are that may still reach the k-th score. The scan takes the buckets of the terms, of which there are a fixed number,
    as partitions, and up to LITERAL terms as values for its row groups.

    Of more terms, questions times blocks are too many for rows: ``sweep`` brings questions to the postings instead.
    """

    def __init__(self, index: Index, questions: DataFrame):
        spark = self.spark = questions.sparkSession
        words = questions.select("query_id", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))
        self.words = kept(words.withColumn("bucket", index.bucket(F.col("term"))), "asked")
        distinct = self.words.select("term", "bucket").distinct()
        some = index.postings(spark).where(F.col("bucket").isin([r[0] for r in distinct.select("bucket").distinct().collect()]))
        few = [r[0] for r in distinct.select("term").limit(LITERAL + 1).collect()]
        self.index, self.many = index, len(few) > LITERAL
        self.postings = some.join(distinct.select("term"), "term", "left_semi") if self.many else some.where(F.col("term").isin(few))
        self.gone = index.gone(spark)
        self.changed = not self.gone.isEmpty()
        counts = self.postings.groupBy("term").agg(F.sum("n").alias("df"))
        total = index.docs(spark).count()
        if self.changed:  # entries are read of the blocks that have lost documents
            total -= self.gone.count()
            lost = self.entries(self.gone.select("segment", "block").distinct(), ["segment", "block"]).join(self.gone.select("segment", "key"), ["segment", "key"], "left_semi")
            less = lost.groupBy("term").agg(F.count(F.lit(1)).alias("less"))
            counts = counts.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
        idf = F.log(1 + F.lit(total) / F.col("df"))
        self.counts = kept(counts.where("df > 0").select("term", idf.alias("idf"), F.monotonically_increasing_id().alias("tid")), "counts")
        self.weights = kept(self.words.drop("bucket").join(self.counts, "term").select("query_id", "term", "tid", "idf"), "weights")

    @functools.cached_property
    def bounds(self) -> DataFrame:
        bound = F.sum((1 + F.log("most")) * F.col("idf"))
        met = self.postings.select("segment", "block", "term", "n", "most").join(self.weights, "term")
        return kept(met.groupBy("query_id", "segment", "block").agg(bound.alias("bound"), F.max("n").alias("n")), "bounds")

    def entries(self, blocks: DataFrame, on: list[str]) -> DataFrame:
        columns = [*blocks.columns, *[c for c in ("segment", "term") if c not in blocks.columns]]
        return self.postings.join(blocks, on).select(*columns, unpacked("keys", "tfs").alias("e")).select(*columns, F.inline("e"))

    def scores(self, blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """(query_id, key, score) of the live documents in ``blocks`` (query_id, segment, block), those of ``allowed`` (key)."""
        found = self.entries(blocks.select("query_id", "segment", "block").join(self.weights, "query_id"), ["segment", "block", "term"])
        if self.changed:
            found = found.join(self.gone.select("segment", "key"), ["segment", "key"], "left_anti")
        if allowed is not None:
            found = found.join(allowed.select("key"), "key", "left_semi")
        return found.groupBy("query_id", "key").agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")), 6).alias("score"))

    def first(self, k: int) -> DataFrame:
        """``bounds`` with ``seed``: blocks of the largest bounds, until they hold ``k`` documents."""
        before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block").rowsBetween(Window.unboundedPreceding, -1)
        return kept(self.bounds.withColumn("seed", F.coalesce(F.sum("n").over(before), F.lit(0)) < k), "seeds")

    def top(self, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score, rank): the ``k`` best of each question, ties by key; exact, whatever is pruned."""
        if self.many:
            return self.sweep(k, allowed)
        marked = self.first(k)
        best = kept(ranked(self.scores(marked.where("seed"), allowed), k), "best")
        rest = self.open(marked, best, k)
        return ranked(best.drop("rank").unionByName(self.scores(rest, allowed)), k)

    def open(self, marked: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """The blocks that ``best`` doesn't rule out: those beside the first whose bound reaches the k-th score, if there is one."""
        last = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
        return marked.where("not seed").join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("bound") >= F.col("last") - SLACK))


    def sweep(self, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The same as ``top`` in one pass. Postings are dealt in pieces of PIECE blocks, and each piece gets the questions, CHUNK at
        the most; a task holds these and one block, and gives the ``k`` best of its piece. Questions of the same terms are one."""
        asks = self.weights.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tid", "idf"))).alias("ask"))
        asks = kept(asks.withColumn("asked", F.min("query_id").over(Window.partitionBy("ask"))), "asks")
        docs = self.index.docs(self.spark)
        pieces = max(1, docs.select("segment", "block").distinct().count() // PIECE)
        chunks = max(1, -(-asks.where("query_id = asked").count() // CHUNK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
        none = lambda t: F.lit(None).cast(t)
        one = asks.where("query_id = asked").select("query_id", "ask.tid", "ask.idf", dealt(chunks, "query_id").alias("chunk"))
        rows = one.select("chunk", every(pieces).alias("piece"), F.lit(0).alias("side"), F.lit(0).alias("segment"), F.lit(0).cast("long").alias("block"), F.col("query_id").alias("id"), F.col("tid").alias("list"), F.col("idf").alias("idfs"), none("binary").alias("keys"), none("binary").alias("tfs"))
        held = self.postings.join(self.counts.select("term", "tid"), "term")
        rows = rows.unionByName(held.select(every(chunks).alias("chunk"), dealt(pieces, "segment", "block").alias("piece"), F.lit(2).alias("side"), "segment", "block", F.col("tid").alias("id"), none("array<long>").alias("list"), none("array<double>").alias("idfs"), "keys", "tfs"))
        barred = self.gone.select("segment", "block", "key") if self.changed else None
        if allowed is not None:
            other = docs.join(allowed.select("key"), "key", "left_anti").select("segment", "block", "key")
            barred = other if barred is None else barred.unionByName(other)
        if barred is not None:
            lists = barred.groupBy("segment", "block").agg(F.collect_list("key").alias("list"))
            rows = rows.unionByName(lists.select(every(chunks).alias("chunk"), dealt(pieces, "segment", "block").alias("piece"), F.lit(1).alias("side"), "segment", "block", F.lit(0).cast("long").alias("id"), "list", none("array<double>").alias("idfs"), none("binary").alias("keys"), none("binary").alias("tfs")))
        place = F.col("chunk") * pieces + F.col("piece")  # one to a task: by a hash some tasks would have several, and others none
        group = rows.repartitionById(chunks * pieces, place).sortWithinPartitions("chunk", "piece", F.col("side") > 0, F.desc("block"), "segment", "side", "id")
        found = ranked(group.mapInArrow(lambda bs: swept(bs, k), "query_id long, key long, score double"), k)
        return found.withColumnRenamed("query_id", "asked").join(asks.select("query_id", "asked"), "asked").select("query_id", "key", "score", "rank")


def swept(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each question in rows (chunk, piece, side, segment, block, id, list, idfs, keys, tfs) that are sorted so: a piece's
    questions (list: their terms, and weights), then block by block the documents that don't count (list) and the postings by term."""
    piece, best = None, None
    for at, part in runs(batches, ["chunk", "piece", "segment", "block", "side"]):
        if at[:2] != piece:
            if best is not None:
                yield from best.rows()
            piece, best, out = at[:2], None, None
        if at[4] == 0:
            best = Best(part, k)
        elif at[4] == 1:
            out = at[2:4], flat(part, "list")[0]
        elif best is not None:
            best.block(part, out[1] if out is not None and out[0] == at[2:4] else None)
    if best is not None:
        yield from best.rows()


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one value of ``columns``, which stand together."""
    at, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch[c].to_numpy() for c in columns])
        cuts = [0, *(np.nonzero((values[:, 1:] != values[:, :-1]).any(axis=0))[0] + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(values[:, a].tolist())
            if own != at and parts:
                yield at, pa.Table.from_batches(parts)
                parts = []
            at = own
            parts.append(batch.slice(a, b - a))
    if parts:
        yield at, pa.Table.from_batches(parts)


def flat(part: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in a row, and how many each list has."""
    chunks = part[column].chunks
    return np.concatenate([c.flatten().to_numpy() for c in chunks]), np.concatenate([pc.list_value_length(c).to_numpy() for c in chunks])


class Best:
    """The best documents so far of questions (id, list: terms, idfs): a row of ``k`` scores and keys each, 0 where there are fewer."""

    def __init__(self, part: pa.Table, k: int):
        self.ids = part["id"].to_numpy()
        self.term, n = flat(part, "list")
        self.idf, self.owner = flat(part, "idfs")[0], np.repeat(np.arange(len(n)), n)
        self.k, self.score, self.key = k, np.zeros((len(n), k)), np.zeros((len(n), k), np.int64)

    def block(self, part: pa.Table, barred: np.ndarray | None) -> None:
        """Scores a block (id: term, keys, tfs) for those questions that it may hold a document for.

        It is cut into SUB documents each, whose largest frequencies bound their scores in turn. A term is a row of all the
        block's documents, by number of the frequency: a question's scores are a sum of rows, where its bounds ask for them.
        """
        terms, last = part["id"].to_numpy(), self.score[:, -1]
        (key, n), (tf, _) = (numbers(pa.concat_arrays(part[c].chunks), kind) for c, kind in (("keys", np.int64), ("tfs", np.int32)))
        start, most = np.cumsum(n) - n, 1 + np.log(np.maximum.reduceat(tf, np.cumsum(n) - n))
        at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        there = terms[at] == self.term
        bound = np.bincount(self.owner[there], self.idf[there] * most[at[there]], len(self.ids))
        pair = np.nonzero(there & (bound >= last - SLACK)[self.owner])[0]
        if not len(pair):
            return
        docs, doc = np.unique(key, return_inverse=True)
        subs = -(-len(docs) // SUB)
        used, own = np.unique(at[pair], return_inverse=True)
        size = n[used]
        entry, term = spans(start[used], size), np.repeat(np.arange(len(used)), size)
        kinds, code = np.unique(tf[entry], return_inverse=True)
        value = np.concatenate([[0.0], 1 + np.log(kinds)])
        rows = np.zeros((len(used) + 1, subs * SUB), np.min_scalar_type(len(kinds)))  # the last: no term
        rows[term, doc[entry]] = code + 1
        rows = rows.reshape(-1, subs, SUB)
        tops = value[rows.max(axis=2)]  # frequencies are numbered in order
        counts = None
        if barred is not None:
            counts = np.zeros(subs * SUB, bool)
            counts[: len(docs)] = ~np.isin(docs, barred)
            counts = counts.reshape(subs, SUB)
        live, row = np.unique(self.owner[pair], return_inverse=True)
        nth = np.arange(len(row)) - np.searchsorted(row, row)  # a question's first term, its second one, ...
        step = max(1, CELLS // max(SUB, subs, nth.max() + 1))
        cuts = np.searchsorted(row, np.arange(0, len(live) + step, step))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            who = live[i * step : (i + 1) * step]
            many = nth[a:b].max(initial=-1) + 1
            slot, idf = np.full((many, len(who)), len(used)), np.zeros((many, len(who)))
            slot[nth[a:b], row[a:b] - i * step], idf[nth[a:b], row[a:b] - i * step] = own[a:b], self.idf[pair[a:b]]
            bound = np.zeros((subs, len(who)))
            for j in range(many):
                bound += tops.T[:, slot[j]] * idf[j]
            for sub in range(subs):
                least = np.maximum(self.score[who, -1] - SLACK, SLACK)  # no score of a document with a term is so small
                q = np.nonzero(bound[sub] >= least)[0]
                if not len(q):
                    continue
                score, some = np.zeros((len(q), SUB)), rows[:, sub]
                for j in range(many):
                    score += value[some[slot[j, q]]] * idf[j, q, None]
                if counts is not None:
                    score *= counts[sub]
                x, d = np.nonzero(score >= least[q, None])
                if len(x):
                    self.merge(who[q[x]], np.round(score[x, d], 6), docs[sub * SUB + d])

    def merge(self, question: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        """Only rows of the questions that have something new are put in order again."""
        who, row = np.unique(question, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(who)), self.k), row])
        score, key = np.concatenate([self.score[who].ravel(), score]), np.concatenate([self.key[who].ravel(), key])
        order = np.lexsort((key, -score, row))
        row = row[order]
        on = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.score[who], self.key[who] = score[on].reshape(-1, self.k), key[on].reshape(-1, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        question, place = np.nonzero(self.score > 0)
        for i in range(0, len(question), 100_000):
            q, p = question[i : i + 100_000], place[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.key[q, p]), pa.array(self.score[q, p])], names=["query_id", "key", "score"])


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of ``size``, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, questions: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): for each of ``questions`` (query_id, words) its ``k`` documents of largest keyword
    score, of ``allowed`` (key) if given. Words that no document has count nothing; questions without a hit have no row."""
    return Asked(index, questions).top(k, allowed)
