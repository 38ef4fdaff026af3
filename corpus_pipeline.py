"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import decontamination, minhash, packing, quality, toxicity
from veilwright.llm.common import cut, fresh_name, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones. Rows are judged one by one: null and repeated ids, empty texts and
    columns of any name stay as they are."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.good_ones(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't find toxic. Rows are judged one by one, as by the classifier."""
    lexicon = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.harmless_ones(docs, lexicon)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: similarity of 0.8 or more of their shingles of five words.

    Rows without doc_id and texts without words link with nothing and stay. Of rows that repeat doc_id and text one
    stays, whichever of them; different texts under the doc_id that stays all stay.
    """
    md5 = fresh_name(docs.columns, "text_md5")
    pair = ["doc_id", md5]
    marked = docs.withColumn(md5, F.md5("text"))
    found = cut(minhash.near_duplicates(marked.select("doc_id", "text", md5), width=5, percent=80, carry=(md5,)), "groups")
    kept = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0")
    repeated = kept.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").select(*pair)
    out = marked.join(found.where("NOT kept").select(*pair).unionByName(repeated).distinct(), pair, "left_anti")
    once = marked.join(repeated, pair, "left_semi").dropDuplicates(pair)
    return out.unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without doc_id and without text stay; all rows of an id go if one goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document; rows without doc_id and repeated rows are packed as documents of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No SQL: stages learn models, find components and pack bins. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
