"""Queries that apply each corpus operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.embedding_dedup import near_duplicate_vectors
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.kd_sharding import kd_shards
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.quality import fit_quality, held_out, score_quality
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.shingle_join import shingle_join
from tidemark.llm.token_files import round_trip
from tidemark.plans.scratch import Scratch
from tidemark.plans.tables import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, folder, "embeddings"), Scratch(spark, "op1"))


def op2_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards(read_table(spark, folder, "documents"), Scratch(spark, "op2"))


def op3_token_range_coder(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read_table(spark, folder, "documents"), Scratch(spark, "op3"), tokenizer_path("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join(read_table(spark, folder, "documents"), Scratch(spark, "op4"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read_table(spark, folder, "documents"), Scratch(spark, "op5")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Besides the ids' count and crc: does the decoded text equal the text?"""
    pieces = encode_pieces(read_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), carry=("doc_id", "text"))
    return pieces.select("doc_id", "n_tokens", "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    model = fit_quality(documents, read_table(spark, folder, "labels"))
    return score_quality(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_table(spark, folder, "documents"), Scratch(spark, "op8"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(read_table(spark, folder, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_kd_sharding, op3_token_range_coder, op4_ngram_jaccard_join, op5_source_mixing, op6_sentencepiece, op7_quality_classifier, op8_exact_dedup, op9_license_scan, op10_secret_scan)}

ORACLE_SQL = {
    "op5_source_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
        walked AS (
            SELECT *, cap / w AS ratio,
                   ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER ahead, 0.0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER ahead, 0.0)) AS level
            FROM w WINDOW ahead AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM walked WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM walked),
        p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
                   CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * epochs + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - start)) AS BIGINT) AS taken
        FROM p""",
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
