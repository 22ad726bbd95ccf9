"""Mixing sources to target weights by hash-random keys and prefix sums of token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.plans.scratch import Scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1:"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 50_000
LEAST_BLOCKS = 256


def word_count(text):
    """Number of WORD runs: with every run of spaces made one, there is a space between any two words."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for (source, source_size): weight shares of all words, none above max_epochs times its source.

    Resharing the excess until none is above settles at one level: every source
    gets least(cap, level * weight). Walking the sources by cap per weight, the
    level is the first that does not exceed that source's own ratio. The table
    has a row per source, so its two global windows see names and sums only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ring = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size", ring.alias("w"), (F.col("source_size") * float(max_epochs)).alias("cap"))
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    walked = caps.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("w"))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(all_rows)["level"]
    return walked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * found).alias("target"))


def _split_hot(dealt: DataFrame, scratch: Scratch, rows_per_block: int) -> DataFrame:
    """A column part within blocks: '' but for rows of a key with more than rows_per_block rows, which come in parts after the others."""
    crowded = dealt.groupBy("source_key", "block").agg(F.count("*").alias("n")).where(F.col("n") > 4 * rows_per_block).select("source_key", "block")
    crowded = scratch.table(crowded, "crowded")
    if crowded.isEmpty():
        return dealt.withColumn("part", F.lit(""))
    # Partial counts keep a key's rows apart until they are numbers; few keys are hot, as each has rows_per_block rows.
    keys = dealt.join(crowded, ["source_key", "block"], "left_semi").groupBy("source_key", "block", "key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_block)
    hot = scratch.table(keys.select("source_key", "block", "key", F.ceil(F.col("n") / rows_per_block).alias("parts")), "hot")
    part = F.concat("key", F.lit(":"), F.lpad(F.pmod(F.xxhash64("place"), F.col("parts")).cast("string"), 12, "0"))
    return dealt.join(hot, ["source_key", "block", "key"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit("")).otherwise(part)).drop("parts")


def mix_sources(documents: DataFrame, scratch: Scratch, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, whole: bool = False, carry=(), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """How many words a mix of all documents (doc_id, text, source) takes from each.

    Every document gets a hash-random key, made of its id and its text. Within a source, documents are dealt
    by ranges of that key into blocks, blocks are summed, and a prefix over the
    blocks plus one inside each block gives every document's place among the
    words of its source. Whole epochs are taken first; the last, partial epoch
    is cut at the source's exact budget, in the middle of a document if it falls
    there. ``whole`` takes that document if at least half of it fits, else not.
    A source with a third of all rows is spread over as many blocks as any.

    Returns doc_id, size, source_size, target, taken, last_epoch (words of the
    partial epoch) and the columns in ``carry``. Null text has size 0 and null
    source is a source of its own, last. Repeated rows share a key; where a key
    has more rows than a block should, they are dealt by their place in the
    table, as any of them may stand for another. Without words every target is 0. An empty table
    gives an empty result. All functions are Spark's own, so reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))))
    place = F.monotonically_increasing_id()
    sized = scratch.table(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), place.alias("place"), *[F.col(c).alias(f"carried_{c}") for c in carry]), "sized"
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = per_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    targets = scratch.table(source_targets(per_source.drop("n"), weights, max_epochs), "targets")
    blocks = max(LEAST_BLOCKS, rows // rows_per_block)
    block = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * blocks).cast("long")
    dealt = sized.withColumn("block", block).withColumn("source_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    dealt = _split_hot(dealt, scratch, rows_per_block)
    sums = dealt.groupBy("source_key", "block", "part").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source_key").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    ahead = scratch.table(sums.select("source_key", "block", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")), "ahead")
    named = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key"), "source_size", "target")
    starts = scratch.table(ahead.join(named, "source_key"), "starts")
    inside = W.partitionBy("source_key", "block", "part").orderBy("key", "place").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_key", "block", "part"])
        .withColumn("start", F.col("ahead") + F.col("inside"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    )
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    last = F.when(cut * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")) if whole else cut
    return placed.withColumn("last_epoch", last).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("last_epoch")).alias("taken"), "last_epoch", "epochs", *[F.col(f"carried_{c}").alias(c) for c in carry]
    )
