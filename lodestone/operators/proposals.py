"""Proposed relationships, held against the text that is said to state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import insert_only

# fixed values: confidence of a kind, and the stems of which its quote must have one
KINDS = {
    "supplies": (0.55, ["suppl", "provide", "ship", "deliver", "sell"]),
    "manufactures": (0.55, ["manufactur", "fabricat", "produce", "make", "foundry", "build"]),
    "customer_of": (0.5, ["customer", "buy", "purchas", "order", "client"]),
    "partners_with": (0.6, ["partner", "collaborat", "joint", "alliance", "team up", "deal"]),
    "competes_with": (0.4, ["compet", "rival", "versus", " vs ", "challeng", "take on"]),
    "invests_in": (0.65, ["invest", "stake", "funding", "back", "round"]),
    "acquired": (0.7, ["acqui", "buyout", "takeover", "purchase of", "merg"]),
}
# fixed values: kinds that are known but stated by no news sentence
OTHER_KINDS = ["depends_on", "produces", "uses", "deploys", "operates", "located_in"]
LEAST_QUOTE = 25
# fixed values: characters of typography and what stands for them
TYPOGRAPHY = ("\u2019\u2018\u201c\u201d\u2014\u2013\u00a0", "''\"\"-- ")


def plain(text: Column) -> Column:
    """Lower case, straight quotes and dashes, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, *TYPOGRAPHY), r"(?U)\s+", " ")))


def validate(proposals: DataFrame, documents: DataFrame, names: DataFrame) -> DataFrame:
    """``proposals`` (doc_id, source, target, relation, quote) with source_slug, target_slug, confidence, reject_reason.

    ``documents`` (doc_id, text); ``names`` (name, slug), one row a lower-cased surface of an entity. The reason is the
    first check that fails, null if none does: entities known and not the same, relation known and one that a sentence
    can state, quote of 25 characters or more found in the text, both ends named in it, a stem of the relation in it.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    surfaces = names.groupBy("slug").agg(F.collect_set("name").alias("__all"))  # an entity's few names
    rows = proposals.withColumn("__s", clean("source")).withColumn("__t", clean("target")).withColumn("__k", clean("relation"))
    for end, key in (("source", "__s"), ("target", "__t")):
        one = names.groupBy("name").agg(F.min("slug").alias("slug")).join(surfaces, "slug")
        rows = rows.join(one.select(F.col("name").alias(key), F.col("slug").alias(f"{end}_slug"), F.col("__all").alias(f"__{end}_names")), key, "left")
    rows = rows.join(documents.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    q = plain(quote)
    names_end = lambda end: F.coalesce(F.exists(f"__{end}_names", lambda x: q.contains(plain(x))), F.lit(False))
    cues = F.create_map(*[x for k, (_, stems) in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, stems)))])
    sure = F.create_map(*[x for k, (c, _) in KINDS.items() for x in (F.lit(k), F.lit(c))])
    reason = (
        F.when(F.col("source_slug").isNull() | F.col("target_slug").isNull(), "unknown_entity")
        .when(F.col("source_slug") == F.col("target_slug"), "self_relationship")
        .when(~F.col("__k").isin([*KINDS, *OTHER_KINDS]), "unknown_relation")
        .when(~F.col("__k").isin([*KINDS]), "relation_not_extractable")
        .when((F.char_length(quote) < LEAST_QUOTE) | ~F.coalesce(plain(F.col("__text")).contains(q), F.lit(False)), "quote_not_in_source")
        .when(~(names_end("source") & names_end("target")), "quote_missing_an_entity")
        .when(~F.exists(cues[F.col("__k")], lambda c: q.contains(c)), "quote_lacks_relational_cue")
    )
    out = rows.withColumn("reject_reason", reason).withColumn("confidence", F.when(F.col("reject_reason").isNull(), sure[F.col("__k")]))
    return out.select(*proposals.columns, "source_slug", "target_slug", "confidence", "reject_reason")


def causes(checked: DataFrame) -> DataFrame:
    """How many proposals each cause turned away; ``accepted`` for the rest."""
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Entities that a document must name to be asked for relations, and proposals that are taken from one.
LEAST_ENTITIES, MOST_PROPOSALS = 2, 4


def askable(documents: DataFrame, mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that name two entities or more (mentions: key, entity)."""
    enough = mentions.groupBy(key).agg(F.countDistinct("entity").alias("n")).where(F.col("n") >= LEAST_ENTITIES)
    return documents.join(enough.select(key), key, "left_semi")


def taken(checked: DataFrame) -> DataFrame:
    """Accepted proposals, each relation of two entities once, four of a document at most, the surest first."""
    relation = ["source_slug", "target_slug", "relation"]
    good = checked.where(F.col("reject_reason").isNull())
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), *relation))
    some = good.dropDuplicates(["doc_id", *relation]).withColumn("__n", rank).where(F.col("__n") <= MOST_PROPOSALS)
    best = F.max_by(F.struct("doc_id", "confidence"), F.struct("confidence", -F.col("doc_id"))).alias("b")
    return some.groupBy(*relation).agg(best).select(*relation, "b.doc_id", "b.confidence")


def extract(documents: DataFrame, proposals: DataFrame, names: DataFrame, mentions: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """``stored`` proposals (source_slug, target_slug, relation, doc_id, confidence, status) and new ones, pending, of the
    newest ``limit`` documents; those that are stored stay as they were reviewed."""
    newest = askable(documents.orderBy(F.desc("doc_id")).limit(limit), mentions)
    found = taken(validate(proposals.join(newest.select("doc_id"), "doc_id", "left_semi"), newest, names))
    return insert_only(stored, found.withColumn("status", F.lit("pending")), ["source_slug", "target_slug", "relation"])
