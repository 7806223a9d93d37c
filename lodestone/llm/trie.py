"""A trie of conversation prefixes: each family of conversations builds its own small trie, and only these are merged."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, partitions, saved

#: Conversations of a family, and turns at most that one takes from its base.
FAMILY, HEAD = 20, 4
#: Nodes that a task holds at most; a family of more hands its trie on in parts, which the merge adds up.
HELD = 50_000
#: Ids of conversations that end at a node are joined in ranges of so many (a power of two).
RANGE = 14
ROOT = bytes(16)
NODE = "key binary, ups array<binary>, depth int, words long, conv_id long, n_convs long, ends array<long>"


def items(convs: DataFrame) -> DataFrame:
    """(family, later, conv_id, turn, role, item, words): turns by their digest, so that no text is shuffled."""
    role, text, c = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id")
    item = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    family = c - c % FAMILY
    return convs.where(c.isNotNull()).select(family.alias("family"), (c != family).alias("later"), c, "turn", role.alias("role"), item.alias("item"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each family's trie, of rows that stand by family, its base first, then conversation and turn.

    A node's key is the digest of its parent's key and its turn. ``ups`` are the ancestors 1, 2, 4 ... above it.
    """
    kinds = pa.schema([("key", pa.binary()), ("ups", pa.list_(pa.binary())), ("depth", pa.int32()), ("words", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.list_(pa.int64()))])
    nodes: dict[bytes, list] = {}
    path: list[tuple[bytes, int]] = []  # of the conversation at hand: keys and words
    base: list[tuple[bytes, int]] = []  # first turns of the family's base
    family = conv = None
    nth = skip = 0

    def node(depth: int) -> list:
        key, words = path[depth]
        if key not in nodes:
            nodes[key] = [[path[depth - (1 << k)][0] for k in range(depth.bit_length())], depth, words, conv, 0, []]
        nodes[key][3] = min(nodes[key][3], conv)
        return nodes[key]

    def grow(item: bytes, words: int) -> None:
        path.append((hashlib.blake2b(path[-1][0] + item, digest_size=16).digest(), words))
        node(len(path) - 1)[4] += 1

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if len(nodes) > least:
            columns = [list(nodes), *map(list, zip(*nodes.values(), strict=True))]
            nodes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    for batch in batches:
        for of, c, item, words in zip(*[batch[k].to_pylist() for k in ("family", "conv_id", "item", "words")], strict=True):
            if c != conv:
                if path:
                    node(len(path) - 1)[5].append(conv)
                yield from flushed(HELD)
                if of != family:
                    family, base = of, []
                conv, nth = c, 0
                path = [(ROOT, 0)]
                node(0)[4] += 1
                skip = 0 if c == of else zlib.crc32(str(c).encode()) % HEAD
                for turn in base[:skip]:
                    grow(*turn)
            if c == of and nth < HEAD - 1:
                base.append((item, words))
            if nth >= skip:
                grow(item, words)
                if len(nodes) > HELD:  # a conversation without end
                    yield from flushed(HELD)
            nth += 1
    if path:
        node(len(path) - 1)[5].append(conv)
    yield from flushed(0)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, ids), texts that are joined by commas as they stand."""
    key = sha = None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k == key:
                sha.update(b",")
            else:
                done += [(key, sha.hexdigest())] if sha else []
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.binary()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
    if sha:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [sha.hexdigest()]})


def ended(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids that end at a node, in order. Ids are joined range by range, so a node
    where a third of all conversations end is some rows a range, which one task reads in turn and holds none of."""
    ids = nodes.where(F.size("ends") > 0).select("key", F.explode("ends").alias("id"))
    ranges = ids.groupBy("key", F.shiftright("id", RANGE).alias("at")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    ranges = ranges.select("key", "at", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return ranges.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "at").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


def below(shared: DataFrame) -> DataFrame:
    """(key, leaves, saved) summed over each node's subtree, of rows (key, ups, depth, leaves, saved): a round takes in
    what stands 1, 2, 4 ... below, so there are as many rounds as the depth has bits, each a sum by ancestor."""
    deep = (shared.agg(F.max("depth")).first()[0] or 0).bit_length()
    for k in range(deep):
        up = shared.where(F.size("ups") > k).groupBy(F.get("ups", F.lit(k)).alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        shared = saved(shared.join(up, "key", "left").select("key", "ups", *sums), "subtrees")
    return shared.select("key", "leaves", "saved")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id. A node with over a thousandth of all nodes as children is a hub: these are a
    thousand at most and are broadcast, so that no task gets a hub's children."""
    many = max(1000, nodes.count() // 1000)
    parents = nodes.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > many).alias("hub"))
    hubs = parents.where("hub").select(F.col("up").alias("hub_key"), F.col("parent_conv_id").alias("hub_conv_id"))
    near = nodes.withColumn("up", F.get("ups", F.lit(0))).join(F.broadcast(hubs), F.col("up") == F.col("hub_key"), "left").drop("hub_key")
    rest = near.where("hub_conv_id is null").drop("hub_conv_id").join(parents.where("not hub").drop("hub"), "up", "left")
    found = near.where("hub_conv_id is not null").withColumnRenamed("hub_conv_id", "parent_conv_id")
    return found.unionByName(rest).drop("up")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and ``key``, the node's digest.

    ``convs``: rows (conv_id, turn, role, text); a conversation stands by turn (null first), rows of one turn by role,
    then by their digest. Conversation c is rebuilt from the first h turns of its base c - c % 20 and its own after
    its first h, h = crc32(c) % 4. A family (the conversations of one base) is cogrouped by a sort with the base first: one pass rebuilds its
    conversations, holds three turns of the base and the family's trie, and hands on a row a node with what the
    family has of it. These rows alone are shuffled again and summed by key; sums and minima are pre-aggregated, so a
    prefix that all conversations share is a row a task. A node of one conversation has one leaf below and saves
    nothing; sums over subtrees are of shared nodes only.

    Null roles and texts are empty ones. Rows without a conv_id belong to no conversation and are left out. Repeated
    rows are turns of their own. An empty table gives no rows, not even a root. Other columns are ignored.
    """
    spark = convs.sparkSession
    laid = items(convs).repartition(partitions(spark), "family").sortWithinPartitions("family", "later", "conv_id", F.col("turn").asc_nulls_first(), "role", "item")
    parts = saved(laid.select("family", "conv_id", "item", "words").mapInArrow(families, NODE), "families")
    merged = parts.groupBy("key").agg(F.any_value("ups").alias("ups"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = saved(merged, "nodes")
    kids = merged.where("depth > 0").groupBy(F.get("ups", F.lit(0)).alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = saved(merged.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("alone", F.coalesce("alone", F.lit(0))), "nodes")
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("alone")).cast("long")
    shared = nodes.where("n_convs > 1").select("key", "ups", "depth", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    whole = with_parents(nodes).join(below(shared), "key", "left").join(ended(parts), "key", "left")
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.lower(F.hex("key")).alias("key"),
    )
