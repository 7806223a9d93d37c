"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by exact tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, half_space, met, saved, tile_pairs

SEED = 42
#: Fingerprints in one piece of a tile: 512 kB.
PIECE = 65_536
#: Pairs that are compared at once.
BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64. Fewer words than a shingle: one shingle; none: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with a column ``__fp`` (long, the fingerprint's 64 bits). Null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in t], dtype="<u8").view("<i8"))

    return docs.withColumn("__fp", of(F.col(text)))


def pops(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of each of ``parts`` equal parts of the fingerprints, one column a part."""
    eight = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    return eight.reshape(len(fp), parts, 8 // parts).sum(axis=2)


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool, parts: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links of ``a`` with ``b`` (or inside ``a``): exclusive-or and bit counts, tile by tile.

    A tile pair whose population counts differ by more than the radius in sum is skipped: each differing bit changes
    one part's count by one. Tiles that are still large are cut again by the counts of smaller parts.
    """
    if len(a) * len(b) <= BLOCK or parts > 8:
        out = []
        for i in range(0, len(a), max(1, BLOCK // max(1, len(b)))):
            rows = a[i : i + max(1, BLOCK // max(1, len(b)))]
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, :]) <= radius)
            if same:
                x, y = x[keep := y > x + i], y[keep]
            if len(x):
                out.append(forest(rows[x].view("<i8"), b[y].view("<i8")))
        return out
    ka, ia = np.unique(pops(a, parts), axis=0, return_inverse=True)
    kb, ib = (ka, ia) if same else np.unique(pops(b, parts), axis=0, return_inverse=True)
    ga = np.split(a[np.argsort(ia, kind="stable")], np.cumsum(np.bincount(ia))[:-1])
    gb = ga if same else np.split(b[np.argsort(ib, kind="stable")], np.cumsum(np.bincount(ib))[:-1])
    out = []
    for i in range(len(ka)):
        for j in np.nonzero(np.abs(kb - ka[i]).sum(axis=1) <= radius)[0]:
            if not same or j >= i:
                out += near(ga[i], gb[j], radius, same and i == j, parts * 2)
    return out


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``__fp`` that span each group linked at ``radius`` differing bits.

    Tiles hold one population count each, so that those within the radius of each other meet; ``near`` cuts them finer.
    """
    cells = prints.select("__fp", F.array(F.bit_count("__fp").cast("int")).alias("cell"))
    # population counts of 64 bits: 65 cells at most, so their sizes may be broadcast
    pieces = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("__n")))
    tiles = cells.join(pieces, "cell").groupBy("cell", F.pmod(F.xxhash64("__fp"), "__n").alias("piece")).agg(F.collect_list("__fp").alias("fps"))
    pairs = tile_pairs(tiles.withColumn("space", F.lit(0)), half_space(1, radius, lambda o: True), ["fps"], "tiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in met(batches, ["fps"]):
            a, b = (x[0].values.to_numpy(zero_copy_only=False).view("<u8") for x in (left, right))
            if found := near(a, b, radius, same):
                x, y = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits from distinct 64-bit hashes, mixed anew for each 64 bits."""
    out = np.zeros(words, dtype=np.uint64)
    for k in range(words):
        h = (hashes ^ np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 65_536):
            ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def near_wide(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of the rows of ``a`` and ``b``, fingerprints of several words, within the radius.

    The first half of the words alone exceeds it for most pairs.
    """
    half = max(1, a.shape[1] // 2)
    step = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        bits = sum(np.bitwise_count(a[at : at + step, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(half))
        i, j = np.nonzero(bits <= radius)
        bits = bits[i, j] + np.bitwise_count(a[at + i, half:] ^ b[j, half:]).sum(axis=1, dtype=np.uint16)
        ok = bits <= radius
        yield at + i[ok], j[ok], bits[ok]


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest key that
    links reach. Equal fingerprints are one node, so a group of copies costs one comparison. Null and empty texts have
    fingerprint zero and link like any other. A null key takes part in links but names no component, unless all of its
    component have null keys (then component_id is null). Repeated rows each give a row. Other columns are ignored.
    """
    prints = saved(fingerprints(docs.select(key, "text"), shingle).select(key, "__fp"), "fingerprints")
    return with_components(prints, radius, key)


def with_components(prints: DataFrame, radius: int, key: str) -> DataFrame:
    groups = saved(prints.groupBy("__fp").agg(F.min(key).alias("__low")), "groups")
    roots = components(links(groups, radius))
    rooted = groups.join(roots, groups["__fp"] == roots["node"], "left").select("__fp", "__low", F.coalesce("root", "__fp").alias("__root"))
    low = rooted.groupBy("__root").agg(F.min("__low").alias("component_id"))
    named = rooted.join(low, "__root").select("__fp", "component_id")
    return prints.join(named, "__fp").select(key, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
