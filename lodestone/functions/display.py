"""Figures as people read them: money at human scale, thousands separators, units, numbered lines of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = [(1e12, " trillion"), (1e9, " billion"), (1e6, " million")]


def money(amount: Column) -> Column:
    """``4.66 trillion USD``: the largest scale that the amount reaches, two decimals; null stays null."""
    value, out = amount.cast("double"), None
    for least, word in SCALES:
        text = F.concat(F.format_number(value / least, 2), F.lit(f"{word} USD"))
        out = F.when(F.abs(value) >= least, text) if out is None else out.when(F.abs(value) >= least, text)
    return out.otherwise(F.concat(F.format_number(value, 2), F.lit(" USD")))


def shown(df: DataFrame, name: str) -> Column:
    """A column as text: two decimals for fractions, separators for whole numbers, ISO dates, other values as they are."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float", "decimal"):
        return F.format_number(name, 2)
    if kind in ("byte", "short", "integer", "long"):
        return F.format_number(name, 0)
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def absolute(millions: Column | str) -> Column:
    """Figures that come in millions, as whole units; what can't be read as a number is null."""
    return (millions if isinstance(millions, Column) else F.col(millions)).try_cast("double") * 1_000_000


def fact_lines(df: DataFrame, facts: list[tuple[str, Column]]) -> Column:
    """``[1] label: text`` a line for each (label, text) that is there: nulls are left out and take no number."""
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{label}: "), text) for label, text in facts]))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
