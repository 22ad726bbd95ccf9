"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.scratch import Scratch

FIRST_BYTES = 128
GROWTH = 4

#: Runs of these are one space in the normalised text.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(documents: DataFrame, scratch: Scratch, first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Group documents (doc_id, text) whose normalised texts are identical.

    A digit is a run of successive bytes: the first ``first_bytes``, then
    ``growth`` times as many at each level. A level splits every open group by
    its next digit; members that are alone, and groups whose text has ended,
    leave. Only members of groups that are still shared go on, with the bytes
    not yet compared, so most text is read once. Groups are told apart by the
    bytes themselves; the digest in the result plays no part in it.

    Counting uses partial sums, so a group of copies of any size costs one row
    per task; the join that hands out group numbers can be split by AQE.

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row.
    Null text counts as empty, empty texts are equal to each other. Of repeated
    rows with one doc_id all report that id as keep_id, and exactly those with
    doc_id = keep_id are kept. Null doc_ids sort last: they are kept only where
    a whole group has none. An empty table gives an empty result; extra columns
    are ignored.
    """
    norm = normalised(F.col("text"))
    open_ = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(norm, 256).alias("text_sha256"), F.lit(0).cast("long").alias("grp"), norm.cast("binary").alias("rest")
    )
    width, level, ended = first_bytes, 0, []
    while True:
        cut = open_.select(
            "doc_id", "text_sha256", "grp", F.expr(f"substring(rest, 1, {width})").alias("digit"), (F.length("rest") <= width).alias("last"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        key = ["grp", "digit", "last"]
        shared = scratch.table(
            cut.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1").withColumn("next", F.monotonically_increasing_id()),
            f"shared{level}",
        )
        # Sorted and merged at every size: the shared groups grow with the documents.
        split = cut.join(shared.hint("merge"), key, "left")
        left = F.col("last") | F.col("next").isNull()
        step = scratch.table(
            split.select(
                "doc_id", "text_sha256", F.col("next").alias("grp"), F.when(~left, F.col("rest")).alias("rest"), left.alias("left"),
                F.coalesce("keep_id", F.when(F.col("next").isNull(), F.col("doc_id"))).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
            ),
            f"level{level}",
        )
        scratch.drop(shared)
        ended.append(step.where("left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
        open_ = step.where("not left").select("doc_id", "text_sha256", "grp", "rest")
        if open_.isEmpty():
            break
        width, level = width * growth, level + 1
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out
