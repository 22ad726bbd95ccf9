"""Text and number rules of the compat profile, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def folded(c: Column) -> Column:
    """A text key for joins, filters and sorting: case folded to capitals, null as ''."""
    return F.upper(F.coalesce(c.cast("string"), F.lit("")))


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case; null equals nothing."""
    return F.upper(a.cast("string")) == F.upper(b.cast("string"))


def number(c: Column) -> Column:
    """The value as a double; what isn't a number counts as 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def sum_of_text(c: Column) -> Column:
    return F.sum(number(c))


def mean_of_text(c: Column) -> Column:
    """The sum over all rows, those without a value too."""
    return F.sum(number(c)) / F.count("*")


def plain_number(c: Column) -> Column:
    """A double as text: without decimals if it is whole, '0' if it isn't finite."""
    whole = F.format_string("%.0f", c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("0")).when(c == F.floor(c), whole).otherwise(c.cast("string"))
