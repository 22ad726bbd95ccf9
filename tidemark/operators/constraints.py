"""Constraint checks as distributed plans: an empty result means that the constraint holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of their rows (PRIMARY KEY, UNIQUE)."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key the parent lacks; a null key refers to nothing (FOREIGN KEY)."""
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent_key"), "left_anti")


def still_referenced(going: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Rows about to be deleted that a child row refers to."""
    keys = child.select(F.col(child_key).alias("_child_key"))
    return going.join(keys, F.col(parent_key) == F.col("_child_key"), "left_semi")


def lacking(going: DataFrame, staying: DataFrame, key: str) -> DataFrame:
    """Rows that go and whose key no staying row has."""
    keys = staying.select(F.col(key).alias("_staying_key"))
    return going.join(keys, F.col(key) == F.col("_staying_key"), "left_anti")


def taken(new: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Keys of new rows that other rows have already; a key without any value is no key."""
    keys = new.dropna(how="all", subset=key).select([F.col(f"`{k}`").alias(f"_new_{i}") for i, k in enumerate(key)])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_new_{i}")) for i, k in enumerate(key)]
    return others.select([F.col(f"`{k}`") for k in key]).join(keys, same, "left_semi")
