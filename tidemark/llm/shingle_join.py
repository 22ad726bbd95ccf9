"""N-gram Jaccard join with a forest of signature trees."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import NOT_SPACE, Words, mixed, steps, text_bytes
from tidemark.llm.embedding_dedup import summed_links
from tidemark.plans.components import connected_components
from tidemark.plans.scratch import Scratch

WORDS = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bits of a token bitmap.
BITS = 2048
#: A leaf holds about this many tokens and at most about this many documents; an upper node this many leaves.
LEAF_TOKENS, LEAF_ROWS, NODE_LEAVES = 1 << 16, 256, 256
#: Sets of up to this many shingles have all of them counted: in few tokens, chance leaves too few that no other set has.
SHORT = 128
#: Leaf pairs compared at a time: PAIRS at least, or this many for each leaf, so that the leaves that travel follow the sets and not the pairs.
PAIRS, PAIRS_A_LEAF = 1024, 8
#: Columns of the 0/1 matrices in which intersections are counted at a time.
COLUMNS = 4096


def shingle_sets(words: Words, texts: int, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin, with the end of the last.

    A text with fewer words than ``size`` has its whole word sequence as its only shingle.
    """
    h = words.hash
    spin = np.uint64(0x9E3779B97F4A7C15)

    def chained(start: np.ndarray, n: int) -> np.ndarray:
        x = np.full(len(start), n, dtype=np.uint64)
        for k in range(n):
            x = mixed(x * spin + h[start + k])
        return x

    full = np.arange(max(0, len(h) - size + 1))
    full = full[words.text[full] == words.text[full + size - 1]]
    values, owner = [chained(full, size)], [words.text[full]]
    counts = np.diff(words.first)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        values.append(chained(words.first[short], n))
        owner.append(short)
    value, text = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[first], text[first]
    return value, np.searchsorted(text, np.arange(texts + 1))


def word_digests(words: Words, at: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's word sequence."""
    inside = NOT_SPACE[words.data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[at[:-1][at[:-1] < len(keep)]] = inside[at[:-1][at[:-1] < len(keep)]]
    kept = np.where(inside, words.data, 0x20).astype(np.uint8)[keep].tobytes()
    bound = np.concatenate([[0], np.cumsum(keep)])[at].tolist()
    return [hashlib.blake2b(kept[a:b].rstrip(b" "), digest_size=16).digest() for a, b in zip(bound, bound[1:], strict=False)]


def prefix_lengths(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of a set's tokens, in one fixed order, any set that links with it must meet one of."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _ragged(value: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """value[first[i] : first[i] + length[i]] for all i, one after another."""
    ends = np.cumsum(length)
    return value[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(first, length)]


def bitmap_of(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def may_link(a: dict, b: dict, percent: int = PERCENT) -> np.ndarray:
    """For each node of a and each of b: can any set below one link with any below the other?

    Common tokens lie in bits that both bitmaps have; a set can have more tokens
    than bits by its collisions only. The overlap must reach percent / (100 +
    percent) of the two sizes, and neither size may be too far from the other.
    """
    overlap = np.bitwise_count(a["bits"][:, None, :] & b["bits"][None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(a["spare"][:, None], b["spare"][None, :])
    overlap = np.minimum(overlap, np.minimum(a["high"][:, None], b["high"][None, :]))
    enough = overlap * (100 + percent) >= percent * (a["low"][:, None] + b["low"][None, :])
    return enough & (100 * np.minimum(a["high"][:, None], b["high"][None, :]) >= percent * np.maximum(a["low"][:, None], b["low"][None, :]))


def merged(node: dict) -> dict:
    """The parent of some nodes: bitmaps OR-combined, sizes and collisions as ranges."""
    return {"bits": np.bitwise_or.reduce(node["bits"], axis=0)[None], "low": node["low"].min(keepdims=True), "high": node["high"].max(keepdims=True), "spare": node["spare"].max(keepdims=True)}


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, from 0/1 matrices over the tokens that both sides have."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(common):
        return out
    placed = []
    for flat, sets in ((flat_a, a), (flat_b, b)):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        has = common[at] == flat
        placed.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[has], at[has]))
    for low in range(0, len(common), COLUMNS):
        sides = []
        for (row, col), sets in zip(placed, (a, b), strict=True):
            m = np.zeros((len(sets), min(COLUMNS, len(common) - low)), dtype=np.float32)
            here = (col >= low) & (col < low + COLUMNS)
            m[row[here], col[here] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def compare_leaves(a: dict, b: dict, same: bool, percent: int = PERCENT):
    """Links between the sets of two leaves, summed as by summed_links."""
    close = may_link(a, b, percent)
    if same:
        np.fill_diagonal(close, False)
    rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return None
    both = intersections([a["sets"][i] for i in rows], [b["sets"][i] for i in cols]).astype(np.int64)
    links = np.zeros_like(close)
    links[np.ix_(rows, cols)] = both * (100 + percent) >= percent * (a["low"][rows][:, None] + b["low"][cols][None, :])
    return summed_links(links & close, a, b, same)


def _nodes(members: pa.Array) -> dict:
    """Tree nodes from an Arrow array of structs with bits, low, high, spare."""
    number = lambda k: members.field(k).to_numpy(zero_copy_only=False)
    return {"bits": np.frombuffer(b"".join(members.field("bits").to_pylist()), dtype=np.uint64).reshape(len(members), -1), **{k: number(k) for k in ("low", "high", "spare")}}


def _leaf(members: pa.Array) -> dict:
    """The documents of a leaf, as its lowest nodes, each class once: rows that repeat a doc_id may bring it twice."""
    ids, once = np.unique(members.field("cid").to_numpy(), return_index=True)
    sets = [np.frombuffer(members.field("tokens")[int(k)].as_py(), dtype=np.uint64) for k in once]
    bits = np.stack([bitmap_of(s) for s in sets])
    n = np.array([len(s) for s in sets], dtype=np.int64)
    return {"id": ids, "weight": members.field("weight").to_numpy()[once], "sets": sets, "bits": bits, "low": n, "high": n, "spare": n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)}


def low_bound(percent: int) -> int:
    """Hashes below this are low: counted over all documents, to put those of one document first among prefix tokens.

    The low tokens of a set are 5 / 3 of its prefix on average.
    """
    return min(1 << 63, (1 << 64) * (100 - percent) // 60)


def leading_tokens(value: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix length, number of low tokens, and number of tokens to look at, of each set of ascending hashes.

    Low tokens, those below low_bound, come first in the order of prefixes, so all of
    a set's are needed to know which of them no other set has; a set with too
    few of them takes its next tokens as well.
    """
    n = np.diff(first)
    low = np.concatenate([[0], np.cumsum(value < np.uint64(low_bound(percent)))])[first]
    low = np.diff(low)
    prefix = prefix_lengths(n, percent)
    return prefix, low, np.maximum(prefix, low)


def short_tokens(value: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the sets that a set of at most SHORT tokens may link with, as hashes of their own, how many each set has, and which sets only these speak for.

    Of two sets that link, either the smaller has at most SHORT tokens, and both are among
    these, or both have more. So each kind has an order of prefixes of its own.
    """
    n = np.diff(first)
    length = np.where(percent * n <= 100 * SHORT, n, 0)
    return mixed(_ragged(value, first[:-1], length) ^ np.uint64(0x9E3779B97F4A7C15)), length, n <= SHORT


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _sketched(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest and key of the word sequence, prefix, low, tokens, short; copies in one batch have tokens once.

    Keys are even, which leaves the lowest bit to tell a set's two orders apart.
    """

    def lists(value, length):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(value.view(np.int64)))

    def sketch(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            seen: set[bytes] = set()
            for a, b in steps(at):
                here = at[a : b + 1] - at[a]
                words = Words(data[at[a] : at[b]], here, NOT_SPACE)
                value, first = shingle_sets(words, b - a, size)
                prefix, low, length = leading_tokens(value, first, percent)
                digests = word_digests(words, here)
                again = np.zeros(b - a, dtype=bool)
                for i, d in enumerate(digests):
                    again[i] = d in seen
                    seen.add(d)
                short, n_short, only = short_tokens(value, first, percent)
                short = short[~np.repeat(again, n_short)]
                length[again | only], n_short[again] = 0, 0
                key = np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64) & -2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.array(digests, type=pa.binary()), pa.array(key), pa.array(prefix.astype(np.int64)), pa.array(low.astype(np.int64)), lists(_ragged(value, first[:-1], length), length), lists(short, n_short)],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "key", "prefix", "low", "tokens", "short"],
                )

    return _hashed(documents).mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, digest binary, key long, prefix long, low long, tokens array<long>, short array<long>")


def _meetings(first: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Edges (a, b) between keys of sets that meet in a prefix token, each token's to its least key.

    In the order of prefixes, low tokens that only one set has come first, then
    the other low tokens, the rarer before the more frequent, then the rest. The
    first kind meets nothing, so a set with a whole prefix of them is done; others
    need only the remainder, in which passages that many documents share come last.
    Short sets have an order in which all tokens are low. A set takes part under
    its key in the one order, and under the next odd number in the other.
    """
    odd, even = F.col("key").bitwiseOR(F.lit(1).cast("long")), lambda k: F.col(k).bitwiseAND(F.lit(-2).cast("long"))
    tokens = first.select("key", F.explode("tokens").alias("token")).union(first.select(odd, F.explode("short")))
    lengths = first.select("key", "prefix", "low").union(first.select(odd, "prefix", "n_shingles")).groupBy("key").agg(F.first("prefix").alias("prefix"), F.first("low").alias("low"))
    shared = scratch.table(tokens.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("token", "n"), "shared")
    high = (F.col("key") == even("key")) & ~F.col("token").between(0, low_bound(percent) - 1)
    mine = (
        tokens.join(shared.hint("merge"), "token")
        .groupBy("key").agg(F.sort_array(F.collect_set(F.struct(high.alias("high"), "n", "token"))).alias("have"))
        .join(lengths, "key")
    )
    own = F.col("low") - F.size(F.filter("have", lambda t: ~t["high"]))
    ahead = scratch.table(mine.withColumn("need", (F.col("prefix") - own).cast("int")).where("need > 0").select("key", F.explode(F.slice("have", F.lit(1), F.col("need"))).alias("t")).select("key", "t.token"), "ahead")
    scratch.drop(shared)
    least = scratch.table(ahead.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("token", "least"), "least")
    meets = scratch.table(ahead.join(least.hint("merge"), "token").where("key != least").select(even("key").alias("a"), even("least").alias("b")).distinct(), "meets")
    scratch.drop(ahead, least)
    return meets


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """cid, fam, weight, n, bucket hash and tokens of the texts whose word sequence has the digest of their class."""

    def collect(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for a, b in steps(at):
                here = at[a : b + 1] - at[a]
                words = Words(data[at[a] : at[b]], here, NOT_SPACE)
                value, first = shingle_sets(words, b - a, size)
                digests, wanted = word_digests(words, here), batch.column("digest").slice(a, b - a).to_pylist()
                own = [i for i in range(b - a) if digests[i] == wanted[i]]
                if own:
                    pick = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(a, b - a).take(pick) for c in ("cid", "fam", "weight")), pa.array(np.diff(first)[own].astype(np.int64)),
                         pa.array(value[first[:-1][own]].view(np.int64)), pa.array([value[first[i] : first[i + 1]].tobytes() for i in own], type=pa.binary())],
                        names=["cid", "fam", "weight", "n", "least", "tokens"],
                    )

    return texts.select("cid", "fam", "weight", "digest", "text").mapInArrow(collect, "cid long, fam long, weight long, n long, least long, tokens binary")


def shingle_join(documents: DataFrame, scratch: Scratch, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Link documents (doc_id, text) whose shingle sets reach ``percent`` Jaccard, and group what the links reach.

    Texts with one word sequence (A-Z lower-cased) become a class with a weight.
    Two sets that link share one of the first tokens of each in a fixed order
    (all but percent of them, plus one). That order puts tokens that no other
    set has first, as far as a quarter of the hash range is counted (all of it
    for short sets), so most sets are done at once. What the others' tokens connect is a family, found
    from the least class at each token, never from pairs. Each family is a signature
    tree: documents are its lowest nodes, leaves hold documents that share their
    least token, upper nodes hold leaves or nodes, level upon level up to one root, and
    every node has the OR of the token
    bitmaps below it and the range of their set sizes. Node pairs are traversed
    from the root and dropped when even the largest possible overlap is too small;
    in leaf pairs that remain the sets themselves are intersected. A leaf is
    bounded in tokens and rows, so a family of any size is many small
    comparisons, made a bounded number at a time. Each gives counts and a forest of links, not pairs. The result
    is exact but for collisions of 64-bit shingle hashes.

    Returns doc_id, n_shingles, component_id, n_links (other documents directly
    linked) for every row. Null, empty and wordless texts have 0 shingles, link
    with nothing and are their own component. Repeated rows link as copies. A
    component none of whose rows has a doc_id has a null id. An empty table gives
    an empty result; extra columns are ignored.
    """
    first = scratch.table(_sketched(documents, size, percent).withColumn("uid", F.monotonically_increasing_id()), "sketched")
    rows = scratch.table(first.select("uid", "doc_id", "text_hash", "n_shingles", "digest", "key"), "rows")
    meets = _meetings(first, scratch, percent)
    scratch.drop(first)
    families = connected_components(meets, scratch)
    scratch.drop(meets)
    classes = scratch.table(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.first("key").alias("key")), "classes")
    one = rows.select(F.col("uid").alias("cid"), F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"))
    wanted = scratch.table(families.select(F.col("node").alias("key"), F.col("comp").alias("fam")).join(classes, "key").join(one, "cid"), "wanted")
    texts = _hashed(documents)
    if not rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows repeat in id and text: one of each will do, and is found before the shuffle.
        texts = texts.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    # By id and text, so that an id on many rows doesn't gather their texts, nor meet more than its own.
    texts = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash")))
    sets = scratch.table(_sets(texts, size), "sets")
    leaves, heads = _plant(sets, scratch)
    scratch.drop(sets)
    links = _traverse(leaves, heads, scratch, percent)
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = connected_components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    named = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ids = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    result = scratch.table(named.join(ids, "comp").join(counts, "cid", "left").select("digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "result")
    has = F.col("n_shingles") > 0
    return rows.join(result, "digest", "left").select(
        "doc_id", "n_shingles", F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")
    )


def _plant(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Leaves (leaf, fam, node, alone, docs) and the heads of those that aren't alone (leaf, fam, node, bits, low, high, spare)."""
    parts = lambda: F.ceil(F.greatest(F.sum("n") / LEAF_TOKENS, F.count("*") / LEAF_ROWS))
    per_family = scratch.table(sets.groupBy("fam").agg(parts().alias("buckets")), "families")
    dealt = sets.join(per_family, "fam").withColumn("bucket", F.pmod(F.xxhash64("least"), F.col("buckets")))
    per_bucket = scratch.table(dealt.groupBy("fam", "bucket").agg(parts().alias("parts")), "buckets")
    total = per_bucket.groupBy("fam").agg(F.sum("parts").alias("leaves"), F.ceil(F.sum("parts") / NODE_LEAVES).alias("ups"))
    numbered = scratch.table(per_bucket.join(total, "fam"), "numbered")
    # Leaves of one bucket share their least token, so they go to a node sixteen at a time.
    up = F.pmod(F.xxhash64("bucket", F.floor(F.col("part") / 16)), F.col("ups"))
    leaves = scratch.table(
        dealt.join(numbered, ["fam", "bucket"])
        .groupBy("fam", "bucket", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("cid", "weight", "tokens")).alias("docs"), F.first("leaves").alias("leaves"), F.first("ups").alias("ups"))
        .select(F.monotonically_increasing_id().alias("leaf"), "fam", (F.col("leaves") == 1).alias("alone"), up.alias("up"), "ups", "docs"),
        "leaves",
    )

    def summarise(batches):
        for batch in batches:
            yield _heads(batch.column("leaf"), batch.column("fam"), batch.column("up"), batch.column("ups"), [merged(_leaf(docs.values)) for docs in batch.column("docs")])

    return leaves, scratch.table(leaves.where("not alone").mapInArrow(summarise, HEAD), "heads")


HEAD = "id long, fam long, up long, ups long, bits binary, low long, high long, spare long"


def _heads(ids: pa.Array, fam: pa.Array, up: pa.Array, ups: pa.Array, nodes: list[dict]) -> pa.RecordBatch:
    """Nodes as rows: their id and family, the number of their parent, how many parents the family has, and what is known of the sets below."""
    return pa.RecordBatch.from_arrays(
        [ids, fam, up, ups, pa.array([n["bits"].tobytes() for n in nodes], type=pa.binary()), *(pa.array([int(n[k][0]) for n in nodes], type=pa.int64()) for k in ("low", "high", "spare"))],
        names=["id", "fam", "up", "ups", "bits", "low", "high", "spare"],
    )


def _grow(heads: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels of all trees, from the nodes over the leaves (node, fam, up, ups, below) to the roots; a node has about NODE_LEAVES below it."""

    def summarise(batches):
        for batch in batches:
            number = lambda name: batch.column(name).to_numpy()
            up, ups = pa.array(number("up") // NODE_LEAVES), pa.array(-(-number("ups") // NODE_LEAVES))
            yield _heads(batch.column("node"), batch.column("fam"), up, ups, [merged(_nodes(below.values)) for below in batch.column("below")])

    levels = []
    while True:
        below = F.collect_list(F.struct("id", "bits", "low", "high", "spare"))
        level = scratch.table(heads.groupBy("fam", "up").agg(below.alias("below"), F.first("ups").alias("ups")).withColumn("node", F.monotonically_increasing_id()), f"level{len(levels)}")
        levels.append(level)
        if level.where("ups > 1").isEmpty():
            return levels
        heads = level.mapInArrow(summarise, HEAD)


def _traverse(leaves: DataFrame, heads: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """cid, n and root of all links, from the roots of the trees down, level by level.

    A pair of nodes is a row, joined with what is below each by the nodes' ids, so
    the pairs of one large family are spread over all tasks.
    """
    levels = _grow(heads, scratch)

    def descend(batches, names: tuple[str, str], least: bool):
        for batch in batches:
            for i in range(batch.num_rows):
                below = [batch.column(n)[i].values for n in names]
                a, b = map(_nodes, below)
                if not may_link(merged(a), merged(b), percent)[0, 0]:
                    continue
                ids_a, ids_b = (x.field("id").to_numpy() for x in below)
                close = may_link(a, b, percent)
                if len(ids_a) == len(ids_b) and (ids_a == ids_b).all():
                    # A node with itself: each pair once, and leaves with themselves are compared elsewhere.
                    close &= ids_a[:, None] < ids_b[None, :] if least else ids_a[:, None] <= ids_b[None, :]
                x, y = np.nonzero(close)
                yield pa.RecordBatch.from_arrays([pa.array(ids_a[x]), pa.array(ids_b[y])], names=["a", "b"])

    found = "a long, b long"
    pairs = scratch.table(levels[-1].select("below").mapInArrow(partial(descend, names=("below", "below"), least=len(levels) == 1), found), "pairs")
    for k in reversed(range(len(levels) - 1)):
        sides = [levels[k].select(F.col("node").alias(s), F.col("below").alias(f"below_{s}")) for s in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("below_a", "below_b")
        pairs = scratch.table(both.mapInArrow(partial(descend, names=("below_a", "below_b"), least=k == 0), found), "pairs")
    scratch.drop(*levels)
    crowded = leaves.where("not alone")
    # Every pair takes its two leaves along, and the pairs of a family grow with its square: so many at a time.
    rounds = -(-pairs.count() // max(PAIRS, PAIRS_A_LEAF * heads.count()))

    def sided(k: int) -> DataFrame:
        now = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        return now.join(crowded.select(F.col("leaf").alias("a"), F.col("docs").alias("docs_a")), "a").join(crowded.select(F.col("leaf").alias("b"), F.col("docs").alias("docs_b")), "b").select("docs_a", "docs_b")

    found = "cid long, n long, root long"

    def batch_of(r):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in r], names=["cid", "n", "root"])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if (r := compare_leaves(*(_leaf(batch.column(f"docs_{s}")[i].values) for s in "ab"), False, percent)) is not None:
                    yield batch_of(r)

    def compare_within(batches):
        for batch in batches:
            for docs in batch.column("docs"):
                leaf = _leaf(docs.values)
                if (r := compare_leaves(leaf, leaf, True, percent)) is not None:
                    yield batch_of(r)

    links = scratch.table(leaves.select("docs").mapInArrow(compare_within, found), "within")
    for k in range(rounds):
        links = links.union(scratch.table(sided(k).mapInArrow(compare, found), "across"))
    return links
