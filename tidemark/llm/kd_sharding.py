"""K-d tree sharding: weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.plans.scratch import Scratch

SHARDS = 40
ROW_BYTES = 16
#: Parts into which one pass of the median search cuts a node's key range.
FAN = 1024
#: A median is found once the undecided part weighs less than this share of a leaf.
CLOSE = 0.001
GRID = 2**31 - 1
ROWS_PER_BLOCK = 20_000
LEAST_BLOCKS = 64


@dataclass
class Node:
    name: int
    leaves: int
    first: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _ranked(meta: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The column's distinct values with their place in code-point order (null: lowest); one row per value, so one window over all of them."""
    values = meta.groupBy(name).agg(F.lit(1).alias("one"))
    rank = F.row_number().over(W.orderBy(F.col(name).cast("binary").asc_nulls_first())).cast("double")
    return scratch.table(values.select(F.col(name).alias(f"{name}_value"), rank.alias(f"raw_{name}")), f"{name}s")


def _where(node: Node, keys):
    """Name of the lowest node that a row has reached so far."""
    if node.left is None:
        return F.lit(node.name)
    return F.when(keys[node.dim] <= F.lit(node.cut), _where(node.left, keys)).otherwise(_where(node.right, keys))


def _lowest(node: Node) -> list[Node]:
    return [node] if node.left is None else _lowest(node.left) + _lowest(node.right)


def _beside(rows: DataFrame, names: tuple[str, ...], values: list[tuple]) -> DataFrame:
    """rows with the values of their node: (node, value, ...) for each. A table to broadcast, as there are at most twice as many nodes as shards."""
    if len(values) == 1:
        return rows.where(F.col("node") == F.lit(values[0][0])).withColumns({n: F.lit(v).cast("long") for n, v in zip(names, values[0][1:], strict=True)})
    table = f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in r) + ')' for r in values)} AS t(node, {', '.join(names)})"
    return rows.join(F.broadcast(rows.sparkSession.sql(table)), "node")


def kd_shards(documents: DataFrame, scratch: Scratch, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Deal documents (doc_id, text, lang, source, n_chars) into shards of near-equal bytes (law ``bytes``).

    A row weighs its UTF-8 bytes plus ``row_bytes``. Dimensions are source and
    lang (their place among the distinct values), n_chars and doc_id, each scaled to
    a common grid, with a row hash and then the row's place in the table below the
    grid value, so that ties and repeated rows can be split too. All nodes of a level
    are split together at the weighted quantile that gives each side its share
    of leaves: histograms of the key range, summed in the tasks, close in on it
    over a few passes until the undecided part is under a thousandth of a leaf.
    The driver sees only histograms of at most ``shards`` nodes. The texts are
    read once; the passes scan a table of numbers.

    Slots come from block counts: each shard's rows are hashed into blocks,
    counted, and numbered within the block after the rows of earlier blocks, so
    no shard is ever gathered into one task.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this
    law moves rows when a shard is added). Null text weighs ``row_bytes`` and has
    crc 0; other nulls sort lowest. Rows that repeat, or a text on a third of all
    rows, are spread over shards by their place. A row heavier than a leaf leaves some shards light
    or empty. An empty table gives an empty result.
    """
    raw = ("source", "lang", "n_chars", "doc_id")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(-1.0)).alias(f"raw_{name}")
    place = F.monotonically_increasing_id()
    meta = scratch.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + row_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64("doc_id", "text").alias("hash"), place.alias("place"), "source", "lang", number("n_chars"), number("doc_id"),
        ),
        "meta",
    )
    for name in ("source", "lang"):
        meta = meta.join(_ranked(meta, name, scratch), F.col(name).eqNullSafe(F.col(f"{name}_value"))).drop(f"{name}_value")
    span = meta.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *[f(f"raw_{k}").alias(f"{k}_{w}") for k in raw for w, f in (("lo", F.min), ("hi", F.max))]).first()
    # 20 bits of the row's hash, then 12 of its place, which only rows that repeat need.
    tie = F.col("hash").bitwiseAND(F.lit(0xFFFFF000)).bitwiseOR(F.xxhash64("place").bitwiseAND(F.lit(0xFFF)))

    def grid(k):
        lo, wide = span[f"{k}_lo"] or 0.0, (span[f"{k}_hi"] or 0.0) - (span[f"{k}_lo"] or 0.0)
        return F.floor((F.col(f"raw_{k}") - F.lit(lo)) / F.lit(wide or 1.0) * GRID).cast("long")

    keyed = scratch.table(meta.select("doc_id", "size", "text_crc32", "place", *[F.shiftleft(grid(k), 32).bitwiseOR(tie).alias(f"k{i}") for i, k in enumerate(raw)]), "keyed")
    keys = [F.col(f"k{i}") for i in range(len(raw))]
    root = Node(0, shards, 0)
    named, leaf = 1, max(1.0, (span["total"] or 0) / shards)
    while open_ := [n for n in _lowest(root) if n.leaves > 1]:
        at = keyed.select("size", _where(root, keys).cast("long").alias("node"), *keys)
        seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(len(keys)) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        look: dict[int, list] = {}
        for n in open_:
            if (r := seen.get(n.name)) is None:
                n.dim, n.cut = 0, 0
                continue
            n.dim = max(range(len(keys)), key=lambda i: ((r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32), -i))
            look[n.name] = [r[f"lo{n.dim}"], r[f"hi{n.dim}"], 0, r["w"] * (n.leaves // 2) / n.leaves]  # range, weight below it, goal
        while look:
            near = [n for n in open_ if n.name in look]
            names, ranges = ("dim", "low", "high", "width"), [(n.name, n.dim, (v := look[n.name])[0], v[1], (v[1] - v[0]) // FAN + 1) for n in near]
            own = _beside(at, names, ranges).withColumn("own", F.element_at(F.array(*keys), (F.col("dim") + 1).cast("int")))
            part = F.expr("(own - low) div width")
            found = own.where("own >= low and own <= high").groupBy("node", part.alias("part")).agg(F.sum("size").alias("w"), F.min("own").alias("a"), F.max("own").alias("b")).collect()
            for n in near:
                lo, hi, below, goal = look[n.name]
                done = True
                rows = sorted((r for r in found if r["node"] == n.name), key=lambda r: r["a"])
                n.cut = lo - 1
                for r in rows:
                    if below + r["w"] <= goal:
                        below, n.cut = below + r["w"], r["b"]
                        continue
                    if r["a"] == r["b"] or r["w"] <= CLOSE * leaf:
                        if goal - below > below + r["w"] - goal:
                            n.cut = r["b"]
                    else:
                        look[n.name], done = [r["a"], r["b"], below, goal], False
                    break
                if done:
                    del look[n.name]
        for n in open_:
            half = n.leaves // 2
            n.left, n.right = Node(named, half, n.first), Node(named + 1, n.leaves - half, n.first + half)
            named += 2
    at = keyed.select("doc_id", "size", "text_crc32", "place", _where(root, keys).cast("long").alias("node"))
    dealt = _beside(at, ("first",), [(n.name, n.first) for n in _lowest(root)]).withColumn("shard", F.col("first").cast("int"))
    blocks = max(LEAST_BLOCKS, (span["n"] or 0) // (ROWS_PER_BLOCK * shards))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    ahead = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = scratch.table(
        dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")), "starts"
    )
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("place"))
    return dealt.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
