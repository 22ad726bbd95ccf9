"""A corpus pipeline: five of the corpus operators, each working on what the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shingle_join import shingle_join
from tidemark.plans.scratch import Scratch
from tidemark.plans.tables import read_table

#: Columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from the labels that aren't held out."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, carry=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def _one_of_each(docs: DataFrame, scratch: Scratch, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each group: that with the smallest doc_id, of equal ones any; null ids come last.

    Rows are numbered and told apart by that number, as a doc_id may be null or
    repeat. ``grouped`` gets rows with the number as doc_id and returns doc_id and
    the group of each. The result is a table of its own, so that nothing else on
    disk outlives the stage.
    """
    rows = scratch.table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = grouped(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "group")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = groups.join(rows.select("row", "doc_id").hint("merge"), "row").groupBy("group").agg(F.min(order).alias("least")).select(F.col("least.row").alias("row"))
    kept = scratch.table(kept, "kept")
    return scratch.leave(scratch.table(rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS), "one-of-each"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest doc_id."""
    scratch = Scratch(spark, "pipeline-copies")
    return _one_of_each(docs, scratch, lambda rows: exact_dedup(rows, scratch).withColumn("group", F.col("keep_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links connect: that with the smallest doc_id."""
    scratch = Scratch(spark, "pipeline-near")
    return _one_of_each(docs, scratch, lambda rows: shingle_join(rows, scratch, size=5, percent=80).withColumn("group", F.col("component_id")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one that its source's budget cuts stays whole if half of it fits."""
    mixed = mix_sources(docs, Scratch(spark, "pipeline-mix"), whole=True, carry=("text", "lang", "source", "n_chars"))
    times = F.col("epochs") + (F.col("last_epoch") > 0).cast("long")
    return mixed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document in the mix, with the count, the ids' crc and whether they decode to the text."""
    pieces = encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), carry=("doc_id", "source", "text"))
    return pieces.select("doc_id", "source", "n_tokens", "ids_crc32", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the classifier or the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.leave(scratch.table(docs, f"stage{k}"))
    return docs
