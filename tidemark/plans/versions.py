"""Which row versions a snapshot sees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def visible_at(snapshot: int, xmin: str = "xmin", xmax: str = "xmax") -> Column:
    """Created by then, and not yet deleted or deleted later."""
    return (F.col(xmin) <= snapshot) & ((F.col(xmax) == 0) | (F.col(xmax) > snapshot))


def dead_at(committed: int, xmax: str = "xmax") -> Column:
    """Deleted by a change that is committed, so that no later snapshot sees the row."""
    return (F.col(xmax) > 0) & (F.col(xmax) <= committed)
