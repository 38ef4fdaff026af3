"""The corpus operators as registered queries: thin wrappers that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, decontamination, embeddings, katz, minhash, packing, quality, sharding, toxicity
from .common import fold_bucket, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_pivot_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_scores(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.pages_through_warc(table(spark, sf_dir, "pages"))


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_scores(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op10_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_pivot_embedding_dedup,
        op3_snapshot_collapse,
        op4_hilbert_sharding,
        op5_containment_decontamination,
        op6_katz_backoff,
        op7_quality_classifier,
        op8_arc_to_warc,
        op9_lexicon_toxicity,
        op10_min_bin_slack_packing,
    )
}

ORACLES: dict[str, str] = {
    "op3_snapshot_collapse": chat.ORACLE,
    "op5_containment_decontamination": decontamination.ORACLE,
}
