"""Connected components by contraction in the order of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label each endpoint of edges (a, b) with the smallest id it can reach: columns node, comp.

    Nodes are ordered by hash. In every round each node looks for the first of its
    neighbours and itself, and goes over into the one that this one has found. Edges
    between different nodes that remain are the next round's, so nodes and edges
    shrink by a factor each round, chains of ascending ids too, and what is done takes
    no further part. Then nodes are followed through the rounds, the last first. A hub's
    neighbours are combined before the shuffle; no neighbour list is ever gathered.
    Empty edges give an empty table; self loops give single nodes.
    """

    def sides(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    place = lambda k: F.struct(F.xxhash64(k), F.col(k).alias("id"))
    live, rounds = scratch.table(edges.select(*sides(F.col("a"), F.col("b"))).distinct(), "edges"), []
    while True:
        both = live.select("a", "b").union(live.select("b", "a"))
        first = scratch.table(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), "m")["id"].alias("first")), "first")
        second = first.select(F.col("node").alias("first"), F.col("first").alias("into"))
        into = scratch.table(first.join(second, "first").select("node", "into"), "into")
        scratch.drop(first)
        rounds.append(into)
        # Neighbours that went over into the same node meet the other side once.
        near = live.join(into.withColumnRenamed("node", "a"), "a").select(F.col("into").alias("a"), "b").distinct()
        left = near.join(into.withColumnRenamed("node", "b"), "b").select(*sides(F.col("a"), F.col("into"))).where("a != b").distinct()
        before, live = live, scratch.table(left, "edges")
        scratch.drop(before)
        if live.isEmpty():
            break
    labels = rounds[-1].withColumnRenamed("into", "comp")
    for into in reversed(rounds[:-1]):
        labels = into.join(labels.withColumnRenamed("node", "into"), "into", "left").select("node", F.coalesce("comp", "into").alias("comp"))
    labels = scratch.table(labels, "labels")
    scratch.drop(live, *rounds)
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    found = scratch.table(labels.join(least, "comp").select("node", F.col("least").alias("comp")), "components")
    scratch.drop(labels)
    return found
