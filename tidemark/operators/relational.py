"""Relational operators that are more than one call of the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import folded, mean_of_text, same_text, sum_of_text

__all__ = ["folded", "having_match", "lacking_match", "mean_of_text", "natural_join", "placed", "same_text", "sum_of_text", "with_scalar"]


def having_match(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str) -> DataFrame:
    """Rows of outer whose key occurs in inner, once each (IN, EXISTS)."""
    keys = inner.select(F.col(inner_key).alias("_inner_key"))
    return outer.join(keys, F.col(outer_key) == F.col("_inner_key"), "left_semi")


def lacking_match(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str) -> DataFrame:
    """Rows of outer whose key does not occur in inner (NOT EXISTS)."""
    keys = inner.select(F.col(inner_key).alias("_inner_key"))
    return outer.join(keys, F.col(outer_key) == F.col("_inner_key"), "left_anti")


def with_scalar(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, aggregate: Column, name: str, empty=None) -> DataFrame:
    """outer with one aggregate of the inner rows that share its key: aggregated first, then joined.

    Without inner rows the value is ``empty``.
    """
    sums = inner.groupBy(F.col(inner_key).alias("_inner_key")).agg(aggregate.alias(name))
    joined = outer.join(sums, F.col(outer_key) == F.col("_inner_key"), "left").drop("_inner_key")
    return joined if empty is None else joined.withColumn(name, F.coalesce(F.col(name), F.lit(empty)))


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equality on all columns that both sides have; without any, the cross join."""
    shared = [x for x in left.columns if x in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


def placed(ordered: DataFrame) -> DataFrame:
    """ordered with the place of each row, from 0: numbered within the written partitions, whose counts come before; never in one task."""
    from tidemark.plans.database import ROW_ID, numbered, staged
    from tidemark.plans.scratch import Scratch

    return numbered(staged(ordered, f"{Scratch(ordered.sparkSession, 'placed').path}/rows"), 0).withColumnRenamed(ROW_ID, "place")
