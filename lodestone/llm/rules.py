"""Quality rules whose thresholds adapt to each language and source, by mergeable quantile sketches; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Width of a sketch's bins: quantiles are right within a quarter of a percent.
GAMMA = 1.005
#: A group's quantiles count as its documents do, those of all documents of its language as this many.
SHRINK = 30
#: A value passes up to FENCE times the spread beyond its quartile.
FENCE = 3.0
#: measure: (numerator, denominator, steps in which the numerator grows). Its values are sketched, and its denominators.
SHARES = {"symbol_share": ("n_symbols", "word_chars", 1), "line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", WINDOW)}
SKETCHED = ("word_length", *SHARES, "n_words", "word_chars", "n_lines")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of whole texts."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select("doc_id", "lang", "source", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        "doc_id", "lang", "source",
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.filter(F.split("t", SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    wins = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    again = F.size("lines") - F.size(F.array_distinct("lines"))
    counts = [F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), again.cast("long").alias("n_dup_lines")]
    step = step.select("doc_id", "lang", "source", "word_chars", "n_symbols", *counts, wins.alias("wins"))
    # few texts repeat a window: only those sort theirs
    placed = F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("placed", placed).drop("wins")
    twin = lambda x, k: (x["h"] == F.get("placed", k - 1)["h"]) | F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False))
    at = F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(F.filter("placed", lambda x, k: F.coalesce(twin(x, k), x["h"] == F.get("placed", k + 1)["h"], F.lit(False))), lambda x: x["i"])))
    step = step.withColumn("at", at).drop("placed")
    # a window adds the words that the one before it does not cover
    spread = F.transform("at", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("at", k - 1))))
    covered = F.coalesce(F.aggregate(spread, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    step = step.withColumn("n_repeat_words", covered).drop("at")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return step.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def values() -> dict[str, Column]:
    of = lambda x, y: F.col(x) / F.nullif(F.col(y), F.lit(0))
    return {"word_length": of("word_chars", "n_words"), **{k: of(x, y) for k, (x, y, _) in SHARES.items()}, **{c: F.col(c).cast("double") for c in ("n_words", "word_chars", "n_lines")}}


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches, rows (lang, source, measure, bin, n): logarithmic bins and how many values fall in each.

    Two sketches merge by adding the counts of equal bins, which the map side does before anything is shuffled. A
    group has as many rows as it has bins, whatever its share of the documents. Bin -1,000,000 holds zeros.
    """
    each = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in values().items()])).alias("m")).select("lang", "source", "m.measure", "m.x").where("x is not null")
    bin_of = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.log(F.lit(GAMMA)))).otherwise(F.lit(-1_000_000)).cast("int")
    return each.groupBy("lang", "source", "measure", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged by the columns ``by``: docs, and q1, q2 and q3 of each measure, a row for each group and measure."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    value = F.when(F.col("bin") > -1_000_000, 2 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA)).otherwise(F.lit(0.0))
    return ranked.groupBy(*by, "measure").agg(F.max("all").alias("docs"), *[F.min(F.when(4 * F.col("upto") >= q * F.col("all"), value)).alias(f"q{q}") for q in (1, 2, 3)])


def shrunk(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """``own`` with its quartiles drawn to those of the wider group: weights docs and SHRINK."""
    names = [c for c in own.columns if c not in ("q1", "q2", "q3")]
    right = wider.select(*[F.col(c).alias(f"__{c}") for c in on], *[F.col(q).alias(f"__{q}") for q in ("q1", "q2", "q3")])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    drawn = [((F.col("docs") * F.col(q) + SHRINK * F.col(f"__{q}")) / (F.col("docs") + SHRINK)).alias(q) for q in ("q1", "q2", "q3")]
    return own.join(right, same).select(*names, *drawn)


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: q1, q2 and q3 of each measure, drawn to its language's, and these to all's."""
    by_lang = shrunk(quartiles(sketch, ["lang"]), quartiles(sketch, []), ["measure"])
    both = shrunk(quartiles(sketch, ["lang", "source"]), by_lang, ["lang", "measure"])
    of = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(q))).alias(f"{q}_{k}")
    wide = both.groupBy("lang", "source").agg(*[of(k, q) for k in SKETCHED for q in ("q1", "q2", "q3")])
    return wide.withColumnsRenamed({"lang": "__lang", "source": "__source"})


def passes() -> Column:
    """Whether a document that has words lies within the fences of its group.

    A fence is FENCE spreads beyond a quartile. The spread of the mean length of words is that between the quartiles,
    for texts shorter than the median one wider by the root of how much; that of a share is the same, or a step of its
    numerator in the median text, or in the text itself if that is shorter.
    """
    length = values()["word_length"]
    wide = (F.col("q3_word_length") - F.col("q1_word_length")) * F.sqrt(F.greatest(F.lit(1.0), F.try_divide(F.col("q2_n_words"), F.col("n_words").cast("double"))))
    good = length.between(F.col("q1_word_length") - FENCE * wide, F.col("q3_word_length") + FENCE * wide)
    for k, (_, y, step) in SHARES.items():
        spread = F.greatest(F.col(f"q3_{k}") - F.col(f"q1_{k}"), F.try_divide(F.lit(float(step)), F.least(F.col(f"q2_{y}"), F.col(y).cast("double"))))
        good = good & (values()[k] <= F.col(f"q3_{k}") + FENCE * spread)
    return good


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, source, the base counts, base_failed, kept.

    kept is false where base_failed is true, and else where a measure (characters a word; symbols for each character;
    repeated lines of all; repeated words of all) lies beyond the fences that the sketches of its language and source
    set. A small group's are drawn to its language's, by how few its documents are. Null lang and null source are groups
    of their own. Null, empty and blank texts have no words and fail. Repeated rows count and are judged each. An empty
    table gives no rows. Other columns are ignored.
    """
    measured = saved(measure(docs), "measured")
    limits = thresholds(saved(sketches(measured), "sketches"))
    met = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    kept = ~F.col("base_failed") & F.coalesce(passes(), F.lit(False))
    return met.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
