"""Tags from a curated dictionary: companies, segments, keywords and tickers that a text names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import url_key

MOST_KEYWORDS = 20


def named(aliases: list[str]) -> str:
    """A pattern of whole words, for lower-cased texts; longer aliases come first, so that the whole of one is found."""
    return r"\b(" + "|".join(re.escape(a) for a in sorted({a.lower() for a in aliases}, key=lambda a: (-len(a), a))) + r")\b"


def hits(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which the text has an alias, in the dictionary's order."""
    return F.array_compact(F.array(*[F.when(text.rlike(named(a)), F.lit(k)) for k, a in groups.items()])) if groups else F.array().cast("array<string>")


def tag(df: DataFrame, text: str, companies: dict[str, list[str]], segments: dict[str, list[str]], symbols: dict[str, list[str]]) -> DataFrame:
    """``df`` with companies (sorted), tags, keywords (as first seen, 20 at most), tagged_tickers and relevant.

    The dictionary is configuration of a bounded size, so each group is a pattern and no join is needed. A text is
    relevant if it names a company or a segment; null texts name none.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = [a for g in (companies, segments) for aliases in g.values() for a in aliases]
    found = df.withColumn("companies", F.array_sort(hits(low, companies))).withColumn("tags", hits(low, segments))
    keywords = F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(named(words)), F.lit(0))), 1, MOST_KEYWORDS)
    tickers = [F.when(F.array_contains("companies", slug), F.array(*map(F.lit, symbols[slug]))) for slug in sorted(companies) if symbols.get(slug)]
    flat = F.array_distinct(F.flatten(F.array_compact(F.array(*tickers)))) if tickers else F.array().cast("array<string>")
    return found.withColumn("keywords", keywords).withColumn("tagged_tickers", flat).withColumn("relevant", (F.size("companies") > 0) | (F.size("tags") > 0))


def normalise(tagged: DataFrame, url: str = "url", asserted: str = "asserted") -> DataFrame:
    """Tagged articles with url_hash and tickers, those that the source asserts first; articles without either and not relevant go."""
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col(asserted), none)
    out = tagged.withColumn("tickers", F.array_distinct(F.concat(own, "tagged_tickers"))).withColumn("url_hash", url_key(F.col(url)))
    return out.where(F.col("relevant") | (F.size(own) > 0)).drop("tagged_tickers", asserted)
