"""SentencePiece encoding and decoding by a batched Viterbi search over numpy arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Base of the substring hashes, which are polynomials in it modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Pair verdicts that a Python worker remembers, 2^REMEMBERED at the most: each in its slot, and a later one may take it.
REMEMBERED = 21


class Pieces:
    """A model's pieces, and the search for the best segmentation of words.

    A unigram model's words get the segmentation of the largest sum of scores. A BPE model's must be those that its
    merges make, which no sum of scores gives; but a sequence is that of the merges exactly when each two neighbours
    are, so the same search runs with 0 for pairs that merges leave apart and minus infinity for all others. Whether
    they do is found by merging the two pieces' text alone (``merges``), once for each pair of pieces.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True):
        """pieces: (text, score, kind) by id, kinds as in the model file: 1 normal, 2 unknown, 4 user defined, 6 byte."""
        self.bpe, self.prefix = bpe, prefix
        self.texts = [p for p, _, _ in pieces]
        self.scores = np.array([s for _, s, _ in pieces])
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (1, 4)}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.encode() for p, _, k in pieces]
        self.longest = max(map(len, self.ids), default=1)
        lengths = np.array([len(p) for p in self.ids], dtype=np.int64)
        keys = np.array([self.hash(p) for p in self.ids], dtype=np.uint64) + lengths.astype(np.uint64)
        order = np.lexsort((keys, self.bits(keys)))
        self.keys, self.at, self.lengths = keys[order], np.array(list(self.ids.values()), dtype=np.int64)[order], lengths[order]
        if len(np.unique(self.keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        #: Keys are ordered by 20 bits of them times an odd number; where those of the same bits begin (-1: none is there; most substrings are no pieces, and end here), and
        #: how many have the same ones at the most.
        head, begin, many = np.unique(self.bits(self.keys), return_index=True, return_counts=True)
        self.first = np.full(1 << 20, -1, dtype=np.int32)
        self.first[head], self.same = begin, int(many.max(initial=1))
        self.chars = {p for p in self.ids if len(p) == 1}
        #: Characters that no merge crosses: they end words, and are words of their own.
        self.breaks = [c for c in "\n\t\r\x0b\f" if c not in self.chars]
        self.alone = re.compile("([" + "".join(map(re.escape, self.breaks)) + f"]|(?<=[^{SPACE}])(?={SPACE}))") if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else None
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.known, self.verdict = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @staticmethod
    def load(path: str = MODEL, kind: int | None = None) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or n.name not in ("identity", ""):
            raise ValueError("models with a normaliser are not supported")
        return Pieces([(p.piece, p.score, p.type) for p in model.pieces], (kind or model.trainer_spec.model_type) == 2, n.add_dummy_prefix)

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(BASE)) >> np.uint64(44)

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # words of one text
    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.alone:
            return [text]
        if SPACE + SPACE not in text and "\0" not in text:  # no run of spaces: each begins a word
            text = text.replace(SPACE, "\0" + SPACE)
            for c in self.breaks:
                if c in text:
                    text = text.replace(c, f"\0{c}\0")
            return [w for w in text.split("\0") if w]
        return [w for w in self.alone.split(text) if w]

    # one word, by merges
    def merged(self, word: str) -> list[str]:
        """The symbols that BPE merges make of the word: the best scored pair first, of equals the leftmost."""
        sym, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (k := self.ids.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            if sym[i] != x or (j := after[i]) >= n or sym[j] != y:
                continue
            sym[i], sym[j] = x + y, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in sym if s]

    def told(self, keys: np.ndarray) -> np.ndarray:
        """What ``merges`` says of each key; verdicts are kept in slots by hash, so that most are made once a worker."""
        if not len(self.known):
            self.known, self.verdict = np.full(1 << REMEMBERED, -1, dtype=np.int64), np.zeros(1 << REMEMBERED, dtype=bool)
        slot = (keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - REMEMBERED)
        out, missing = self.verdict[slot], np.nonzero(self.known[slot] != keys)[0]
        if len(missing):
            new, at, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            verdict = np.array([self.merges(k) for k in new.tolist()], dtype=bool)
            out[missing] = verdict[which]
            to, one = np.unique(slot[missing[at]], return_index=True)
            self.known[to], self.verdict[to] = new[one], verdict[one]
        return out

    def found(self, key: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, id) of the ``key`` (by row: a length, word) that are pieces."""
        first = self.first[self.bits(key)]
        row, word = np.nonzero(first >= 0)
        own, at = key[row, word], first[row, word]
        for _ in range(self.same - 1):
            at = np.minimum(at + (self.keys[at] < own), len(self.keys) - 1)
        hit = (self.keys[at] == own) & (self.lengths[at] == sizes[row])
        return row[hit], word[hit], self.at[at[hit]]

    def merges(self, key: int) -> bool:
        """Whether merges leave apart the pieces of a key left << 20 | right. Without a left one (1 << 40): make the right one."""
        right = self.texts[key & 0xFFFFF]
        left = [] if key >> 40 else [self.texts[key >> 20]]
        return self.merged("".join(left) + right) == [*left, right]

    # many words of one length
    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): for each word and prefix length, the last piece's id (-1: a character that is no piece) and length."""
        m, n = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, m), dtype=np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * np.uint64(BASE) + code[:, i]
        power = [1]
        for _ in range(self.longest):
            power.append(power[-1] * BASE & 0xFFFFFFFFFFFFFFFF)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        last, back = np.full((n + 1, m), -1, dtype=np.int64), np.zeros((n + 1, m), dtype=np.int64)
        for i in range(1, n + 1):
            longest = min(i, self.longest)
            sizes = np.arange(longest, 0, -1)  # of equal scores, the longest last piece is taken
            factor = np.array([power[k] for k in sizes], dtype=np.uint64)[:, None]
            key = prefix[i] - prefix[i - sizes] * factor + sizes[:, None].astype(np.uint64)
            row, word, found = self.found(key, sizes)
            start, single = i - sizes[row], np.ones(m, dtype=bool)
            single[word[row == longest - 1]] = False
            if self.bpe:
                before = last[start, word]
                alone = before < 0  # the word's start, or a character that no merge takes
                ok = self.told(np.where(alone, 1 << 40, before << 20) | found)
                row, word, found, start = row[ok], word[ok], found[ok], start[ok]
            score, ids = np.full((longest, m), -np.inf), np.full((longest, m), -1, dtype=np.int64)
            score[row, word] = best[start, word] + (0.0 if self.bpe else self.scores[found])
            ids[row, word] = found
            lone = np.nonzero(single)[0]  # no piece for the character
            score[-1, lone] = best[i - 1, lone] + (0.0 if self.bpe else self.least - 10)
            top = score.argmax(axis=0)
            best[i], last[i], back[i] = score[top, np.arange(m)], ids[top, np.arange(m)], sizes[top]
        return back, last

    def spell(self, text: str) -> list[int]:
        """Bytes of a character that is no piece."""
        return [self.byte.get(b, self.unknown) for b in text.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def encode_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words in a row, and where each word's begin (one more entry at the end)."""
        count, parts = np.zeros(len(words), dtype=np.int64), []  # parts: words, and their ids in a row
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, all_at in by.items():
            step = max(1, 400_000 // (n * min(n, self.longest)))
            for k in range(0, len(all_at), step):
                at = np.array(all_at[k : k + step])
                length, ids = self.follow([words[i] for i in at], n)
                count[at] = length
                parts.append((at, length, ids))
        start = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(start[-1], dtype=np.int32)
        for at, length, ids in parts:
            flat[np.repeat(start[at] - np.cumsum(length) + length, length) + np.arange(len(ids))] = ids
        return flat, start

    def follow(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word of length ``n`` has, and all ids in a row, along the search's backpointers."""
        back, last = self.search(words)
        end, every, steps = np.full(len(words), n), np.arange(len(words)), []
        while end.any():
            on = end > 0
            steps.append(np.where(on, np.where(last[end, every] >= 0, last[end, every], -1 - end), 0))
            steps[-1][~on] = np.iinfo(np.int64).min
            end = end - np.where(on, back[end, every], 0)
        rows = np.stack(steps[::-1], axis=1)
        used = rows != np.iinfo(np.int64).min
        length, ids = used.sum(axis=1), rows[used]
        if (ids < 0).any():  # spell out what is no piece
            owner = np.repeat(every, length)
            each = [[t] if t >= 0 else self.spell(words[w][-t - 2]) for t, w in zip(ids.tolist(), owner.tolist(), strict=True)]
            length = np.bincount(np.repeat(owner, [len(x) for x in each]), minlength=len(words))
            ids = np.array([t for x in each for t in x])
        return length, ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts in a row, and where each text's begin (one more entry at the end)."""
        split = [self.words(t) for t in texts]
        at, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
        flat, start = self.encode_words(words)
        size = np.diff(start)[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        ids = flat[np.repeat(start[:-1][at] - (ends - size), size) + np.arange(ends[-1])] if len(at) else flat
        docs = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[docs]

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids: pieces and bytes joined, the space that encoding put in front dropped."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def tokenise(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns of each row of ``docs`` with ids array<int>, n_tokens, same (and ``decoded``, on request).

    ids are those that SentencePiece gives for the whole text; ``same`` tells whether their decoding is the text
    again, which fails only where the text has U+2581, the mark of a space. Null text: null ids, n_tokens 0, same
    null. Empty text: no ids. The model file is read on the driver and broadcast (a vocabulary, under 10 MB).
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(path))
    kept = docs.select(*keep, "text")
    extra = [("ids", "array<int>"), ("n_tokens", "long"), ("same", "boolean"), *([("decoded", "string")] if decoded else [])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            heavy = np.cumsum([len(t or "") for t in texts]) // 3_000_000 if texts else np.zeros(0, int)
            for part in np.unique(heavy):  # a few MB of text at a time
                rows = np.nonzero(heavy == part)[0]
                first, n = int(rows[0]), len(rows)
                own = texts[first : first + n]
                ids, at = model.encode([t or "" for t in own])
                back = [model.decode(ids[at[i] : at[i + 1]]) for i in range(n)]
                void = np.array([t is None for t in own])
                offsets = pa.array(at.astype(np.int32), pa.int32(), mask=np.append(void, False))
                columns = [*[batch[c].slice(first, n) for c in keep], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(np.diff(at), pa.int64()), pa.array([None if t is None else t == b for t, b in zip(own, back, strict=True)], pa.bool_())]
                if decoded:
                    columns.append(pa.array([None if t is None else b for t, b in zip(own, back, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[c for c, _ in extra]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema], *[f"{c} {t}" for c, t in extra]])
    return kept.mapInArrow(of, schema)
