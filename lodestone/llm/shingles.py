"""Near copies of five-word shingle sets: wide SimHash fingerprints are compared tile by tile, each pair found is counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, half_space, met, partitions, saved, scratch, tile_pairs
from .simhash import SEED, near_wide, wide

SHINGLE = 5
#: Sets link at a Jaccard similarity of 4 / 5: a set of n shares 4 n / 5 at least with any that it links with.
NUM, DEN = 4, 5
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: Words of 64 bits of a fingerprint, and the radius. Sets at 4 / 5 differ in 15 % of the bits: 78 of 512, give or take
#: 8, so that one pair in some ten million lies beyond; of sets of 4 and 5 shingles 96 differ, and one in 300 does.
WORDS, RADIUS = 8, 120
#: Fingerprints in one piece of a tile, 512 kB, and shingles in one piece where sets are compared, about 2 MB.
PIECE, HEAVY = 8192, 1 << 18
#: Links of a pair of pieces that are held before they are made a forest.
HELD = 1 << 20
#: Characters that are cut into shingles at once.
CHARS = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Fewer words than a shingle: one shingle; none: no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(h))
    g = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        g += h[i : len(h) - size + 1 + i] * MULTIPLIERS[i]
    g ^= g >> np.uint64(32)
    g *= MULTIPLIERS[3]
    return np.unique(g ^ (g >> np.uint64(29)))


def set_id(g: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(g.tobytes(), SEED)).view(np.int64))


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n): each document's set of shingles by its hash, and the set's size."""

    @F.pandas_udf("sid long, n int")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            g = [(set_id(x), len(x)) for x in map(shingles, t)]
            yield pd.DataFrame({"sid": np.array([s for s, _ in g], dtype=np.int64), "n": np.array([n for _, n in g], dtype=np.int32)})

    return docs.select("doc_id", of("text").alias("__s")).select("doc_id", "__s.sid", "__s.n")


def common_counts(docs: DataFrame) -> DataFrame:
    """(sid, c): how many shingles, over all copies of a set, some other set has too; sets without any are left out.

    c may be too large, as hashes of under 64 bits stand for the shingles, but never too small.

    Shingles travel as packed arrays of 32 bits, dealt by the rest of their hash, and are sorted a bucket at a time: a task's buckets come one after the other.
    """
    spread = 2 * partitions(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)) // CHARS
            for k in np.unique(part):
                first, end = np.searchsorted(part, [k, k + 1])
                sets = [g for t in batch["text"][first:end] if len(g := shingles(t.as_py()))]
                if not sets:
                    continue
                h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets])
                sid = np.array([set_id(g) for g in sets], dtype=np.int64)
                bucket = (h % np.uint64(spread)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(spread + 1))
                low = (h >> np.uint64(32)).astype(np.uint32)
                rows = []
                for b in np.nonzero(np.diff(at))[0]:
                    own = order[at[b] : at[b + 1]]
                    who, times = np.unique(owner[own], return_counts=True)  # ``own`` keeps the order of documents
                    rows.append((int(b), low[own].tobytes(), sid[who].tobytes(), times.astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], names=["bucket", "low", "sid", "times"])

    def shared(low: list[np.ndarray], sid: list[np.ndarray]) -> pa.RecordBatch:
        key, own = np.concatenate(low), np.concatenate(sid)
        order = np.argsort(key)
        key, own = key[order], own[order]
        at = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        several = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)
        who, c = np.unique(own[np.repeat(several, np.diff(at, append=len(key)))], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(c.astype(np.int64), pa.int64())], names=["sid", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lows, sids = None, [], []
        for batch in batches:
            for row in range(batch.num_rows):
                b, low, sid, times = (batch[c][row].as_py() for c in ("bucket", "low", "sid", "times"))
                if b != now and lows:
                    yield shared(lows, sids)
                    lows, sids = [], []
                now = b
                lows.append(np.frombuffer(low, np.uint32))
                sids.append(np.repeat(np.frombuffer(sid, np.int64), np.frombuffer(times, np.uint32)))
        if lows:
            yield shared(lows, sids)

    packed = docs.select("text").mapInArrow(pack, "bucket int, low binary, sid binary, times binary")
    return packed.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "sid long, c long").groupBy("sid").agg(F.sum("c").alias("c"))


def candidates(docs: DataFrame, printed: DataFrame) -> DataFrame:
    """(sid, n, grams array<long>, fp array<long>): each distinct set that shares 4 / 5 of its shingles with other sets together.

    A set that links with another does so, so that all others can be left out of the comparison.
    """
    nodes = printed.where("n > 0").groupBy("sid").agg(F.sum("n").alias("all"), F.min("doc_id").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"]:
                if len(g := shingles(t.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(g)], pa.int64()), pa.array([len(g)], pa.int32()), *[pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (g, wide(g, WORDS))]], names=["sid", "n", "grams", "fp"])

    with scratch(docs.sparkSession):
        some = saved(nodes.join(common_counts(docs), "sid").where(DEN * F.col("c") >= NUM * F.col("all")).select("sid", "doc_id"), "some")
        wanted = some.select(F.col("doc_id").alias("__id")).distinct()
        own = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        found = own.select("text").mapInArrow(sets, "sid long, n int, grams array<long>, fp array<long>").join(some.select("sid"), "sid", "left_semi")
        return saved(found.dropDuplicates(["sid"]), "candidates", out=True)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets, a few a set, whose Jaccard similarity is 4 / 5 or more."""
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return saved(both.where((DEN + NUM) * shared >= NUM * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "linked")


def size_class() -> Column:
    """A set's size as a cell: sets of one differ by a factor of 1.26 at most, so that only neighbouring cells have sets within
    5 / 4 of another."""
    return F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int")


def pieces_of(sets: DataFrame, payload: list[str], pieces: Column, name: str) -> DataFrame:
    """Pairs of pieces of ``sets`` (space, cell int, *payload), for ``met``, of one space and the same cell or neighbouring ones;
    ``pieces``: how many a cell of a space is cut into. Spaces and cells are few: their numbers are broadcast."""
    cells = sets.select("space", F.array("cell").alias("cell"), *payload)
    counts = F.broadcast(cells.groupBy("space", "cell").agg(pieces.cast("int").alias("__n")))
    items = F.collect_list(F.struct(*payload)).alias("x")
    tiles = cells.join(counts, ["space", "cell"]).groupBy("space", "cell", F.pmod(F.xxhash64("sid"), "__n").alias("piece")).agg(items)
    flat = [F.flatten(f"x.{c}").alias(c) if c in ("fp", "grams") else F.col(f"x.{c}").alias(c) for c in payload]
    return tile_pairs(tiles.select("space", "cell", "piece", *flat), half_space(1, 1, lambda o: True), payload, name)


def near_pieces(sets: DataFrame, name: str) -> DataFrame:
    """Pairs of pieces of ``sets`` (CLOSE) of about the same size: a cell for each power of 1.26, under 200 of them."""
    laid = sets.select(F.lit(0).alias("space"), size_class().alias("cell"), *CLOSE)
    return pieces_of(laid, CLOSE, F.ceil(F.count(F.lit(1)) / PIECE), name)


def close(left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of two pieces (sid, n, root, fp) within the radius, of sizes that can link and of two roots."""
    (_, n, root, fp), (_, n2, root2, fp2) = left, right
    for i, j, bits in near_wide(fp.view("<u8").reshape(-1, WORDS), fp2.view("<u8").reshape(-1, WORDS), RADIUS):
        ok = (root[i] != root2[j]) & (DEN * n[i] >= NUM * n2[j]) & (DEN * n2[j] >= NUM * n[i])
        yield i[ok], j[ok], bits[ok]


def arrays(row: tuple) -> tuple:
    return tuple(x.values.to_numpy(zero_copy_only=False) for x in row)


CLOSE = ["sid", "n", "root", "fp"]
#: The cell of buckets of families: no cell of a size is next to it.
APART = -9


def nearest(sets: DataFrame) -> DataFrame:
    """(a, b): each set with the nearest one within the radius whose root is another, at most a pair a set."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, _ in met(batches, CLOSE):
            one, two = arrays(left), arrays(right)
            best: dict[int, tuple[int, int]] = {}
            for i, j, bits in close(one, two):
                a, b, d = np.concatenate([one[0][i], two[0][j]]), np.concatenate([two[0][j], one[0][i]]), np.concatenate([bits, bits])
                order = np.lexsort((b, d, a))
                a, b, d = a[order], b[order], d[order]
                first = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
                for x, y, z in zip(a[first].tolist(), b[first].tolist(), d[first].tolist(), strict=True):
                    best[x] = min(best.get(x, (1 << 20, 0)), (z, y))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([y for _, y in best.values()], pa.int64()), pa.array([z for z, _ in best.values()], pa.int32())], names=["a", "b", "bits"])

    with scratch(sets.sparkSession):
        found = near_pieces(sets, "near-tiles").mapInArrow(compare, "a long, b long, bits int")
        one = found.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
        return saved(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest", out=True)


def families(sets: DataFrame) -> DataFrame:
    """(sid, family) of the sets that have another within the radius whose root is another: chains of such pairs are a family.

    Fingerprints alone are compared; a pair of pieces gives a forest of its links, an edge a set at most.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, _ in met(batches, CLOSE):
            one, two = arrays(left), arrays(right)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            more, n = [], 0
            for i, j, _ in close(one, two):
                more.append((one[0][i], two[0][j]))
                n += len(i)
                if n > HELD:
                    a, b = forest(*(np.concatenate(x) for x in zip((a, b), *more, strict=True)))
                    more, n = [], 0
            if n:
                a, b = forest(*(np.concatenate(x) for x in zip((a, b), *more, strict=True)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    with scratch(sets.sparkSession):
        roots = components(near_pieces(sets, "open-tiles").mapInArrow(compare, "a long, b long"))
        return saved(roots.select(F.col("node").alias("sid"), F.col("root").alias("family")), "families", out=True)


def counted(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (family, sid, n, root, fp, grams) that link their roots: shingles are counted piece by piece.

    Only sets of one family meet. Families are dealt to buckets of about HEAVY shingles, each a piece that meets itself, so that
    shingles travel once; a family of more is one space of its own, in pieces by size.
    Pairs stay inside a task, and those whose roots it has joined already are not counted, so that a group gives few rows.
    """
    payload = [*CLOSE, "grams"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, _ in met(batches, payload):
            one, two = arrays(left), arrays(right)
            at, at2 = (np.concatenate([[0], np.cumsum(x[1], dtype=np.int64)]) for x in (one, two))
            parent: dict[int, int] = {}

            def top(x: int, parent: dict[int, int] = parent) -> int:
                while (y := parent.get(x, x)) != x:
                    parent[x] = parent.get(y, y)
                    x = y
                return x

            found = []
            for i, j, bits in close(one[:4], two[:4]):
                for k in np.argsort(bits, kind="stable").tolist():
                    x, y = int(i[k]), int(j[k])
                    r, r2 = top(int(one[2][x])), top(int(two[2][y]))
                    if r == r2:
                        continue
                    g, g2 = one[4][at[x] : at[x + 1]].view(np.uint64), two[4][at2[y] : at2[y + 1]].view(np.uint64)
                    shared = int((g2[np.minimum(np.searchsorted(g2, g), len(g2) - 1)] == g).sum())
                    if (DEN + NUM) * shared >= NUM * (len(g) + len(g2)):
                        parent[max(r, r2)] = min(r, r2)
                        found.append((int(one[0][x]), int(two[0][y])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    weights = sets.groupBy("family").agg(F.sum("n").alias("all"))
    with scratch(sets.sparkSession):
        weights = saved(weights, "weights")
        buckets = max(1, -(-(weights.agg(F.sum("all")).first()[0] or 0) // HEAVY))
        large = F.broadcast(weights.where(F.col("all") > HEAVY).select("family", F.lit(True).alias("large")))  # one in HEAVY shingles
        laid = sets.join(large, "family", "left")
        space = F.when(F.col("large"), F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(buckets)))
        cell = F.when(F.col("large"), size_class()).otherwise(F.lit(APART))
        laid = laid.select(space.alias("space"), cell.alias("cell"), *payload)
        pairs = pieces_of(laid, payload, F.ceil(F.sum("n") / (2 * HEAVY)), "set-tiles").mapInArrow(compare, "a long, b long")
        return saved(pairs, "counted", out=True)


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets (sid, n, grams, fp) which chains of pairs with a similarity of 4 / 5 connect.

    First each set is counted against its nearest one, which joins most of a large group without its pairs. Sets that
    still have one within the radius that is not connected to them then meet with their shingles, by families of such sets.
    """

    def rooted(edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return saved(sets.join(roots, sets["sid"] == roots["node"], "left").select("sid", "n", "fp", F.coalesce("root", "sid").alias("root")), "placed")

    first = linked(nearest(sets.select("sid", "n", "fp", F.col("sid").alias("root"))), sets)
    second = first.unionByName(linked(nearest(rooted(first)), sets))
    placed = rooted(second)
    rest = placed.join(families(placed), "sid").join(sets.select("sid", "grams"), "sid")
    return second.unionByName(counted(rest))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id. Columns stay as they are.

    Documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more, without case of A-Z
    and by words between ASCII white space, and their fingerprints are within the radius; a group is what links reach. Equal sets are one node. Null, empty and blank
    texts are one group. A document with a null doc_id is kept only where no other of its group has an id; repeated
    rows of the kept id stay repeated.
    """
    with scratch(docs.sparkSession):
        printed = saved(prints(docs), "prints")
        roots = components(links(candidates(docs, printed)))
        group = printed.join(roots, printed["sid"] == roots["node"], "left").select("doc_id", F.coalesce("root", "sid").alias("root"))
        kept = saved(group.groupBy("root").agg(F.min("doc_id").alias("__keep")).select("__keep").distinct(), "kept", out=True)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__keep"]), "left_semi").select(*docs.columns)
