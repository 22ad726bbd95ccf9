"""Near-duplicate embeddings: learned rotations, binary codes, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.components import connected_components
from tidemark.plans.scratch import Scratch

LEAST_COSINE = 0.9
#: Vectors, by smallest hash, on which the rotation is learned.
SAMPLE = 20_000
ROUNDS = 40
CODE_BITS = 64
#: Vectors that a bucket of the narrowest buckets should hold on average.
PER_BUCKET = 256
#: Vectors and components of a block at most.
PER_BLOCK, BLOCK_PARTS = 1024, 1 << 16
#: Share of pairs just at the least cosine that must meet in a bucket, by pairs planted around PLANTED sample vectors.
RECALL, PLANTED = 0.97, 4000
#: Share of those pairs whose codes, over all rotations, differ in no more bits than candidates may.
CLOSE_CODES = 0.999
#: Codes from rotations of their own at most; vectors on which those after the first are learned.
MOST_CODES, MORE_SAMPLE = 32, 5000
#: Bits of the widest substrings.
MOST_WIDTH = 32
#: Work of a vector in one more table, in comparisons.
TABLE_WORK = 2000


@dataclass(frozen=True)
class Rotation:
    """Projects unit vectors of one dimension onto axes whose signs are the code."""

    mean: np.ndarray
    axes: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = ((unit - self.mean) @ self.axes > 0).astype(np.uint64)
        return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def learn_rotation(unit: np.ndarray, bits: int = CODE_BITS, rounds: int = ROUNDS, seed: int = 1) -> Rotation:
    """Iterative quantisation: principal axes, then a rotation that brings the projections close to their own signs."""
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :bits]
    seen = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(seen.T @ np.where(seen @ turn > 0, 1.0, -1.0))
        turn = u @ v
    return Rotation(mean, axes @ turn)


@dataclass(frozen=True)
class Tables:
    """How the bits of a code are dealt to tables: shift and width of each."""

    shifts: tuple[int, ...]
    width: int

    @staticmethod
    def of_width(width: int, bits: int) -> Tables:
        """As many whole tables as fit; a single one of one bucket if the width is 0."""
        return Tables(tuple(range(0, bits - width + 1, width)) if width else (0,), width)

    @staticmethod
    def for_rows(rows: int, bits: int) -> Tables:
        """About PER_BUCKET rows a bucket if codes are balanced, in as many whole tables as fit."""
        return Tables.of_width(max(1, min(MOST_WIDTH, bits, round(math.log2(max(2, rows / PER_BUCKET))))), bits)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.width) - 1)
        return np.stack([(codes >> np.uint64(s)) & mask for s in self.shifts])


@dataclass(frozen=True)
class Index:
    """The tables of all codes: those of the first rotation, then of the next; the first ``count`` are used.

    Two vectors that share a bucket are candidates if their codes differ in at most ``limit`` bits.
    """

    rotations: list[Rotation]
    tables: Tables
    count: int
    limit: int = 0

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """A row per vector, a column per rotation."""
        return np.stack([r.codes(unit) for r in self.rotations], axis=1) if self.rotations else np.zeros((len(unit), 0), dtype=np.uint64)

    def keys_of(self, codes: np.ndarray) -> np.ndarray:
        """The bucket of every code in each table; a single one if there are no codes."""
        if not codes.shape[1]:
            return np.zeros((1, len(codes)), dtype=np.uint64)
        return np.concatenate([self.tables.keys(c) for c in codes.T])[: self.count]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        return self.keys_of(self.codes(unit))

    def candidates(self, a: np.ndarray, b: np.ndarray, same: bool, table: int) -> np.ndarray:
        """Which of the codes a and b of one bucket are close, and met in no table before this one."""
        if not a.shape[1]:
            close = np.ones((len(a), len(b)), dtype=bool)
        else:
            apart = np.zeros((len(a), len(b)), dtype=np.uint16)
            for x, y in zip(a.T, b.T, strict=True):
                apart += np.bitwise_count(x[:, None] ^ y[None, :])
            close = apart <= self.limit
        if same:
            np.fill_diagonal(close, False)
        if table:
            drop_met(close, self.keys_of(a), self.keys_of(b), table)
        return close


def drop_met(close: np.ndarray, a: np.ndarray, b: np.ndarray, table: int) -> None:
    """Clear the pairs whose keys are equal in a table before this one."""
    x, y = np.nonzero(close)
    before = np.zeros(len(x), dtype=bool)
    for t in range(table if len(x) else 0):
        before |= a[t, x] == b[t, y]
    close[x[before], y[before]] = False


def planted_partners(unit: np.ndarray, least: float, seed: int = 1) -> list[np.ndarray]:
    """Partners of cosine ``least`` for unit vectors: once in any direction, once by moving about the mean along differences of the data.

    The second are what pairs around a common mean look like: they keep the mean
    and turn the rest further.
    """
    rng = np.random.default_rng(seed)
    length = lambda m: np.sqrt((m * m).sum(axis=1, keepdims=True))
    scaled = lambda m: m / np.maximum(length(m), 1e-300)

    def beside(m: np.ndarray, axis: np.ndarray) -> np.ndarray:
        """The directions of m across axis; 0 where nothing but rounding is left."""
        across = m - (m * axis).sum(axis=1, keepdims=True) * axis
        return np.where(length(across) > 1e-9 * length(m), scaled(across), 0.0)

    any_way = beside(rng.standard_normal(unit.shape), unit)
    out = [scaled(least * unit + math.sqrt(1 - least * least) * any_way)]
    mean = unit.mean(axis=0)
    rest = unit - mean
    side = beside(unit[rng.permutation(len(unit))] - unit[rng.permutation(len(unit))], scaled(rest)) * length(rest)
    low, high = np.zeros((len(unit), 1)), np.full((len(unit), 1), math.pi)
    for _ in range(40):
        turn = (low + high) / 2
        moved = scaled(mean + np.cos(turn) * rest + np.sin(turn) * side)
        near = (moved * unit).sum(axis=1, keepdims=True) > least
        low, high = np.where(near, turn, low), np.where(near, high, turn)
    return [*out, moved]


def choose_index(unit: np.ndarray, rows: int, least: float = LEAST_COSINE) -> Index:
    """The width and number of tables with the least work for ``rows`` vectors of which ``unit`` is a sample.

    For every width, tables are added, over several rotations if need be, until
    RECALL of the planted pairs of either kind share a bucket. Narrower tables
    have larger buckets and lose fewer pairs; width 0 compares all and loses none,
    so some width always suffices.
    """
    bits = min(CODE_BITS, unit.shape[1])
    seen = unit[:PLANTED]
    partners = planted_partners(seen, least)
    rotations: list[Rotation] = []
    codes: list[list[np.ndarray]] = []

    def met(tables: Tables, k: int) -> np.ndarray:
        """Which pairs of either kind share a bucket of the k-th table."""
        turn, shift = k // len(tables.shifts), k % len(tables.shifts)
        if turn == len(rotations):
            rotations.append(learn_rotation(unit if turn == 0 else unit[:MORE_SAMPLE], bits, seed=turn + 1))
            codes.append([rotations[turn].codes(m) for m in (seen, *partners)])
        apart = np.stack([codes[turn][0] ^ c for c in codes[turn][1:]]) >> np.uint64(tables.shifts[shift])
        return (apart & np.uint64((1 << tables.width) - 1)) == 0

    best, least_work = Index([], Tables.of_width(0, bits), 1), rows / 2 + TABLE_WORK
    for width in range(1, Tables.for_rows(rows, bits).width + 1):
        tables, count = Tables.of_width(width, bits), 0
        hit = np.zeros((len(partners), len(seen)), dtype=bool)
        # Buckets are as uneven as the sample's, so what they cost is taken from it.
        work = 0.0
        while hit.mean(axis=1).min() < RECALL and count < MOST_CODES * len(tables.shifts) and work < least_work:
            hit |= met(tables, count)
            turn, shift = divmod(count, len(tables.shifts))
            share = np.bincount(((codes[turn][0] >> np.uint64(tables.shifts[shift])) & np.uint64((1 << width) - 1)).astype(np.int64)) / len(seen)
            work += (share * share).sum() * rows / 2 + TABLE_WORK
            count += 1
        if hit.mean(axis=1).min() >= RECALL and work < least_work:
            best, least_work = Index(rotations, tables, count), work
    if not best.tables.width:
        return best
    turns = -(-best.count // len(best.tables.shifts))
    apart = [sum(np.bitwise_count(codes[t][0] ^ codes[t][k]).astype(np.int64) for t in range(turns)) for k in (1, 2)]
    return Index(rotations[:turns], best.tables, best.count, int(np.ceil(np.quantile(apart, CLOSE_CODES, axis=1).max())))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long float lists as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest part first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(column):
    """Neither null nor empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(column) > 0) & F.forall(column, finite) & F.exists(column, lambda x: x != 0), F.lit(False))


def compare_blocks(a: dict, b: dict, same: bool, table: int, least: float):
    """Links between two sets of vectors that this table is the first to show; "keys" are their buckets in every table.

    Returns ids, the weight linked to each, and a root of each in the forest of
    these links: never the pairs themselves.
    """
    links = a["unit"] @ b["unit"].T >= least
    if same:
        np.fill_diagonal(links, False)
    if table:
        drop_met(links, a["keys"], b["keys"], table)
    return summed_links(links, a, b, same)


def summed_links(links: np.ndarray, a: dict, b: dict, same: bool):
    """ids, linked weight and forest root for each row of a and b with a link."""
    if not links.any():
        return None
    ids, weight = (a["id"], links @ b["weight"]) if same else (np.concatenate([a["id"], b["id"]]), np.concatenate([links @ b["weight"], a["weight"] @ links]))
    root_a, root_b = a["id"].copy(), b["id"].copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(root_a, np.where(links, root_b[None, :], far).min(axis=1))
        new_b = new_a if same else np.minimum(root_b, np.where(links, new_a[:, None], far).min(axis=0))
        if (new_a == root_a).all() and (new_b == root_b).all():
            break
        root_a, root_b = new_a, new_b
    roots = root_a if same else np.concatenate([root_a, root_b])
    has = weight > 0
    return ids[has], weight[has], roots[has]


def near_duplicate_vectors(embeddings: DataFrame, scratch: Scratch, least: float = LEAST_COSINE, sample: int = SAMPLE) -> DataFrame:
    """Link vectors (vec_id, embedding) with cosine >= ``least`` and group what the links reach.

    Equal vectors become one class with a weight, so copies are counted, not
    paired. Classes get codes: signs after rotations learned on ``sample`` unit
    vectors. Codes are cut into substrings, one table each; two vectors are
    candidates if a substring is the same. How wide substrings are and how many
    tables and rotations it takes is chosen so that RECALL of pairs planted in
    the sample, just at ``least``, share a bucket; where all pairs are less work
    than that, all are compared. Buckets are held as blocks of bounded size,
    dealt by hash when a bucket is large, and each pair of a bucket's blocks is
    compared in one step by cosine in double precision. A pair belongs to the
    first table that shows it. What leaves a comparison is a count for each
    vector and a forest of its links, never all pairs of a group.

    Links are exact where found; tests measure the share of links found against
    brute force. Vectors of different length don't link.

    Returns vec_id, n_links, component_id, kept for every row. A vector that is
    null, empty, zero or has null or non-finite components links with nothing and
    is its own component. Rows that share a vec_id count as rows. Rows without a
    vec_id take part; a component without any vec_id has a null id. An empty table
    gives an empty result; extra columns are ignored.
    """
    spark = scratch.spark
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")))
    classes = scratch.table(
        good.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    dims = [r["d"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()]
    found = [_links_of_length(classes.where(F.size("embedding") == d), d, scratch, least, sample) for d in dims]
    if not found:
        linked = spark.createDataFrame([], "cid long, n long, root long")
    else:
        linked = found[0]
        for more in found[1:]:
            linked = linked.union(more)
    counts = linked.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = connected_components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    named = classes.select("cid", *_digests(), "least_id", "weight").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ids = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    result = scratch.table(
        named.join(ids, "comp").join(counts, "cid", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "result"
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    linkable = good.select("vec_id", *_digests()).join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id", kept)
    rest = rows.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.union(rest.select("vec_id", "n_links", "component_id", kept))


def _digests():
    """128 bits of a vector, by which rows find their class without carrying it; a negative zero counts as zero, as in grouping."""
    plain = F.transform("embedding", lambda x: x + 0.0)
    return F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2")


def _links_of_length(classes: DataFrame, dim: int, scratch: Scratch, least: float, sample: int) -> DataFrame:
    """cid, n (weight linked) and root for the classes of one vector length."""
    picked = classes.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(sample).collect()
    index = choose_index(_unit(np.array([r["embedding"] for r in picked])), classes.count(), least)
    per_block = max(16, min(PER_BLOCK, BLOCK_PARTS // dim))
    n_codes = len(index.rotations)

    def keyed(batches, whole: bool):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = index.codes(_unit(_matrix(batch.column("embedding"))))
            keys = index.keys_of(codes)
            own = [batch.column("cid"), pa.array([x.tobytes() for x in codes], type=pa.binary())] if whole else []
            for t, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key.astype(np.int64)), *own], names=["t", "key", "cid", "codes"][: 2 + len(own)])

    bucket = ["t", "key"]
    sizes = classes.select("embedding").mapInArrow(partial(keyed, whole=False), "t int, key long").groupBy(*bucket).agg(F.ceil(F.count("*") / per_block).alias("parts"))
    coded = classes.select("cid", "embedding").mapInArrow(partial(keyed, whole=True), "t int, key long, cid long, codes binary")
    blocks = scratch.table(
        coded.join(scratch.table(sizes, "sizes"), bucket)
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
        .groupBy(*bucket, "part").agg(F.collect_list(F.struct("cid", "codes")).alias("rows"), F.first("parts").alias("parts")),
        "blocks",
    )
    # Blocks of one bucket meet in pairs, each made from its own block's row; a bucket of one block has none.
    pairs = blocks.where("part + 1 < parts").select(*bucket, F.col("part").alias("a"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("b"))
    side = lambda name: blocks.select(*bucket, F.col("part").alias(name), F.col("rows").alias(f"rows_{name}"))
    across = pairs.join(side("a"), [*bucket, "a"]).join(side("b"), [*bucket, "b"])

    def members(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return rows.field("cid").to_numpy(), np.frombuffer(b"".join(rows.field("codes").to_pylist()), dtype=np.uint64).reshape(len(rows), n_codes)

    def retrieve(batches):
        """Rows with a candidate: the pair of blocks they are in, their side, cid."""
        for batch in batches:
            same = "rows" in batch.schema.names
            for i in range(batch.num_rows):
                t, key, *ends = (batch.column(c)[i].as_py() for c in (*bucket, *(["part"] if same else ["a", "b"])))
                ids_a, a = members(batch.column("rows" if same else "rows_a")[i].values)
                ids_b, b = (ids_a, a) if same else members(batch.column("rows_b")[i].values)
                close = index.candidates(a, b, same, t)
                for k, cids in enumerate([ids_a[close.any(axis=1)]] if same else [ids_a[close.any(axis=1)], ids_b[close.any(axis=0)]]):
                    n = len(cids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), *(pa.array(np.full(n, x, np.int64)) for x in (key, ends[0], ends[-1])), pa.array(np.full(n, k, np.int32)), pa.array(cids)], names=[*bucket, "a", "b", "side", "cid"]
                    )

    place = "t int, key long, a long, b long, side int, cid long"
    near = scratch.table(
        blocks.select(*bucket, "part", "rows").mapInArrow(retrieve, place).union(across.select(*bucket, "a", "b", "rows_a", "rows_b").mapInArrow(retrieve, place)), "near"
    )
    scratch.drop(blocks)
    met = near.join(classes.select("cid", "weight", "embedding"), "cid").groupBy(*bucket, "a", "b").agg(F.collect_list(F.struct("side", "cid", "weight", "embedding")).alias("rows"))

    def rerank(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                unit, of_b = _unit(_matrix(rows.field("embedding"))), rows.field("side").to_numpy() == 1
                whole = {"id": rows.field("cid").to_numpy(), "weight": rows.field("weight").to_numpy(), "unit": unit}
                keys, same = index.keys(unit), not of_b.any()
                a, b = ({**{k: v[w] for k, v in whole.items()}, "keys": keys[:, w]} for w in (~of_b, of_b))
                if (r := compare_blocks(a, a if same else b, same, batch.column("t")[i].as_py(), least)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], names=["cid", "n", "root"])

    return scratch.table(met.select("t", "rows").mapInArrow(rerank, "cid long, n long, root long"), "links")
