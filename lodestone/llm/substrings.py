"""Repeated lines and passages: lines and paragraphs of hashed units are grouped globally by digest, later ones are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, saved

#: Words that a paragraph of units has at least, so that a passage of over 50 words has one wherever it stands.
MIN_WORDS = 25
#: One word of so many, by its hash, ends a unit: units are in step again soon after an edit or a passage's beginning.
ANCHOR = 8
#: Characters that are hashed at once.
BLOCK = 1_000_000
GAP = re.compile(r"\s+")
MARKS = np.array([ord(c) for c in ".!?\u2026\u3002\uff01\uff1f\u0964\u061f"], dtype=np.uint32)
SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
#: Scripts without spaces between words: each of their characters is a word.
ALONE = ((0x0E00, 0x0EFF), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Factors of a word's characters by their place in it.
FACTORS = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: each bit of the result depends on all of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def lower(text: str) -> str:
    """Lower case of the same length: characters whose lower case has several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: where it starts, its hash, whether it ends a unit, and whether a line break follows it."""
    parts, at = [], 0
    while at < len(text):
        cut = GAP.search(text, min(len(text), at + BLOCK))  # a block ends before a word, or where the text does
        end = cut.end() if cut else len(text)
        code = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        space = SPACE[np.minimum(code, 0x3000)] & (code <= 0x3000)
        alone = np.zeros(len(code), dtype=bool)
        for a, b in ALONE:
            alone |= (code >= a) & (code <= b)
        fresh = np.concatenate([[True], space[:-1] | alone[:-1]]) | alone
        start = np.nonzero(~space & fresh)[0]
        if len(start):
            letters = np.nonzero(~space)[0]
            first = np.searchsorted(letters, start)
            size = np.diff(first, append=len(letters))
            place = letters - np.repeat(start, size)
            low = code[letters].astype(np.uint64) + np.uint64(1)
            h = mix(np.add.reduceat(low * FACTORS[place % 4096], first) + size.astype(np.uint64))
            last = letters[first + size - 1]
            breaks = np.concatenate([[0], np.cumsum(code == 10)])
            line = breaks[np.append(start[1:], len(code))] > breaks[last + 1]
            parts.append((start + at, h, line | np.isin(code[last], MARKS) | (h % np.uint64(ANCHOR) == 0), line))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def paragraphs(texts: list[str], min_words: int, lines: bool = False) -> tuple[np.ndarray, ...]:
    """(document, start, end, d1, d2) of each paragraph, the fewest units with ``min_words`` words from a unit on, or up to one;
    with ``lines`` of each line that has a word too, whatever its length.

    Offsets are code points, with the white space after the last word. The digest, two hashes of 64 bits, is that of
    the words in lower case, whatever white space is between them.
    """
    start, h, ends, breaks = words("\n".join(map(lower, texts)))
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(base, start, side="right") - 1
    stop = np.nonzero(ends)[0]  # a document's last word is one: a line break follows it, or nothing
    if len(start) and (not len(stop) or stop[-1] != len(start) - 1):
        stop = np.append(stop, len(start) - 1)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    on = np.searchsorted(stop, begin + min_words - 1)
    s, e = begin[on < len(stop)], stop[on[on < len(stop)]]
    # those up to units that no shortest paragraph ends with
    rest = np.setdiff1d(stop[stop >= min_words - 1], e)
    s = np.concatenate([s, begin[np.searchsorted(begin, rest - min_words + 1, side="right") - 1]]) if len(rest) else s
    e = np.concatenate([e, rest])
    s, e = s[same := doc[s] == doc[e]], e[same]
    if lines and len(start):
        breaks[-1] = True
        closing = np.nonzero(breaks)[0]  # a line break stands between documents too
        both = np.unique(np.concatenate([s, [0], closing[:-1] + 1]) * len(start) + np.concatenate([e, closing]))
        s, e = both // len(start), both % len(start)
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), BASE))]).astype(np.uint64)
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), INVERSE))]).astype(np.uint64)
    digests = []
    for x in (h, mix(h + BASE)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * power[:-1], dtype=np.uint64)])
        digests.append(mix((sums[e + 1] - sums[s]) * back[s] + (e - s).astype(np.uint64)).view(np.int64))
    after = np.append(start, base[-1] - 1)[e + 1]
    end = np.minimum(after - base[doc[s]], base[doc[s] + 1] - 1 - base[doc[s]])
    return doc[s], start[s] - base[doc[s]], end, *digests


#: What is known of a paragraph, and its bytes in a row.
KINDS = {"d1": "<i8", "d2": "<i4", "start": "<i4", "end": "<i4"}


def later(d1: np.ndarray, d2: np.ndarray, void: np.ndarray, key: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each paragraph has the digest of one that comes before it by (void, key, rid, start)."""
    out = np.zeros(len(d1), dtype=bool)
    order = np.argsort(d1, kind="stable")
    twin = np.zeros(len(d1) + 1, dtype=bool)
    twin[1:-1] = d1[order][1:] == d1[order][:-1]
    own = order[twin[1:] | twin[:-1]]  # few have a twin: only those are put in full order
    own = own[np.lexsort((start[own], rid[own], key[own], void[own], d2[own], d1[own]))]
    if len(own):
        fresh = np.concatenate([[True], (d1[own][1:] != d1[own][:-1]) | (d2[own][1:] != d2[own][:-1])])
        first = own[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))]
        out[own] = (rid[own] != rid[first]) | (start[own] != start[first]) | (key[own] != key[first]) | (void[own] != void[first])
    return out


#: Digests that are unpacked and put in order at once.
SLICE = 2_000_000


def repeated(docs: DataFrame, min_words: int, lines: bool = False) -> DataFrame:
    """Rows (__rid, start, end), the paragraphs of ``docs`` (__rid, __key, __void, text) that come later than their like.

    Those that come later in the same block of texts are told at once, so that of a passage in any share of all
    documents one row a block goes on. Digests travel packed, dealt by their rest, a bucket of them to a row for each
    block. A bucket is compared at a time: it is held packed, and unpacked in slices of about SLICE digests.
    """
    spread = 2 * partitions(docs.sparkSession)
    names = [*KINDS, "docs", "times"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            rid, key, void = (batch[c].to_numpy(zero_copy_only=False) for c in ("__rid", "__key", "__void"))
            heavy = np.cumsum([len(t) for t in texts]) // BLOCK if texts else np.zeros(0, int)
            for part in np.unique(heavy):
                first, n = int(np.searchsorted(heavy, part)), int((heavy == part).sum())
                doc, start, end, d1, d2 = paragraphs(texts[first : first + n], min_words, lines)
                if not len(doc):
                    continue
                doc = doc + first
                sure = later(d1, d2 >> np.int64(32), void[doc], key[doc], rid[doc], start)
                bucket = np.where(sure, spread, (d1.view(np.uint64) % np.uint64(spread)).astype(np.int64))
                order = np.lexsort((doc, bucket))
                doc, columns = doc[order], [x[order].astype(t) for x, t in zip((d1, d2 >> np.int64(32), start, end), KINDS.values(), strict=True)]
                at = np.searchsorted(bucket[order], np.arange(spread + 2))
                rows = []
                for b in np.nonzero(np.diff(at))[0]:
                    own = slice(at[b], at[b + 1])
                    who, times = np.unique(doc[own], return_counts=True)
                    packed = np.stack([rid[who], key[who], void[who].astype(np.int64)], axis=1).astype("<i8")
                    # what is sure goes to any bucket
                    rows.append((int(b) if b < spread else int(d1[0] % spread), b == spread, *[x[own].tobytes() for x in columns], packed.tobytes(), times.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([bool(r[1]) for r in rows], pa.bool_()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(2, 8)]], names=["bucket", "sure", *names])

    def unpacked(row: dict) -> list[np.ndarray]:
        out = [np.frombuffer(row[c], t) for c, t in KINDS.items()]
        of = np.repeat(np.frombuffer(row["docs"], "<i8").reshape(-1, 3), np.frombuffer(row["times"], "<u4"), axis=0)
        return [*out, of[:, 0], of[:, 1], of[:, 2]]

    def spans(rows: list[dict], sure: bool) -> Iterator[pa.RecordBatch]:
        slices = 1 if sure else max(1, sum(len(r["d1"]) for r in rows) // 8 // SLICE)
        for k in range(slices):
            some = []
            for row in rows:
                columns = unpacked(row)
                if slices > 1:
                    on = (columns[0].view(np.uint64) >> np.uint64(32)) % np.uint64(slices) == k
                    columns = [c[on] for c in columns]
                some.append(columns)
            d1, d2, start, end, rid, key, void = (np.concatenate(x) for x in zip(*some, strict=True))
            on = slice(None) if sure else later(d1, d2, void, key, rid, start)
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (rid, start, end)], names=["__rid", "start", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in ("bucket", "sure", *names)}
                if row["sure"]:
                    yield from spans([row], True)
                    continue
                if row["bucket"] != now and rows:
                    yield from spans(rows, False)
                    rows = []
                now = row["bucket"]
                rows.append(row)
        if rows:
            yield from spans(rows, False)

    packed = docs.mapInArrow(cut, "bucket int, sure boolean, " + ", ".join(f"{c} binary" for c in names))
    return packed.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "__rid long, start int, end int")


def repeated_spans(docs: DataFrame, min_words: int, lines: bool = False) -> DataFrame:
    """Rows (__rid, __spans): of each document that loses any, the spans that go, array<struct<start, end>>, apart and in order."""
    later = repeated(docs, min_words, lines)
    # a document's own spans: those that meet are one
    order = Window.partitionBy("__rid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order)
    apart = later.withColumn("island", island).groupBy("__rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return apart.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, lines: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated passages, and ``removed`` array<struct<start, end>>: their code point offsets.

    ``lines``: each line with a word is such a passage, however short, so of a line that stands anywhere else before it
    none is left; it goes with the white space after it. Blank-line paragraphs that repeat go line by line.

    A unit ends at a line's or a sentence's end, or after a word that its hash chooses; a paragraph is the fewest units
    with ``min_words`` words, from each unit on and up to each unit. Paragraphs are compared in lower case and by single spaces. The one that
    comes first by (doc_id, position), null ids last, stays; all later ones go. Ids that are no integers rank by hash. Shorter repeats stay, but for ``lines``. Repeats inside
    one document count like those in another. So a removed word always stands, amid the same paragraph, in an earlier
    place that stays. Null text stays null and empty text empty, ``removed`` is then empty. Of rows that are equal in
    doc_id and text one is the first, and the others lose all of their text if it has ``min_words`` words (``lines``: a
    word). Other columns stay; an input column ``removed`` is replaced.
    """
    keep = [c for c in docs.columns if c != "removed"]
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    rank = F.col("doc_id").cast("long") if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("doc_id")
    void = F.col("doc_id").isNull()
    ranked = docs.select(key.alias("__rid"), F.coalesce(rank, F.lit(0)).alias("__key"), void.alias("__void"), "text")
    # saved: the digests that were shuffled are gone before the texts are
    spans = saved(repeated_spans(ranked, min_words, lines), "spans")
    met = docs.select(*keep, key.alias("__rid")).join(spans, "__rid", "left")
    nth = F.row_number().over(Window.partitionBy("__rid").orderBy("__rid"))
    again = (nth > 1) & (F.regexp_count("text", F.lit(WORD)) >= (1 if lines else min_words))
    met = met.withColumn("__again", again)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end")))
    removed = F.when(F.col("__again"), whole).otherwise(F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")))
    met = met.withColumn("__gone", removed)
    starts = F.concat(F.array(F.lit(0)), F.col("__gone.end"))
    ends = F.concat(F.col("__gone.start"), F.array(F.char_length("text")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    text = F.when(F.size("__gone") > 0, left).otherwise(F.col("text")).alias("text")
    return met.select(*[text if c == "text" else F.col(c) for c in keep], F.col("__gone").alias("removed"))
