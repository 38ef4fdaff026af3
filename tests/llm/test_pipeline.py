import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from veilwright.llm import common, packing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= kept and now, name
        kept = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == kept
    texts, encode = {r.doc_id: r.text for r in docs.collect()}, packing.Encoder(packing.default_vocabulary())
    r = rows[0]
    ids = [*encode(texts[r.doc_id]), 0][r.start : r.start + r.length]
    assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == r.ids_crc32


def test_near_dedup_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (None, None), (1, a), (2, a), (3, b), (4, c), (4, c), (5, c), (6, None), (6, None), (7, ""), (4, None), (8, b + " more"), (9, "x y"), (9, "p q")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    expected = [(None, a), (None, a), (None, None), (1, a), (3, b), (4, c), (6, None), (6, None), (7, ""), (4, None), (9, "x y"), (9, "p q")]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_cut_bounds_what_a_task_holds(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.xxhash64("id").alias("k"), F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 512) for i in range(32)]).alias("x"))
    with common.settings(spark, spark__sql__shuffle__partitions="64"):
        found = common.cut(rows.groupBy("k").agg(F.max("x").alias("x")), "held")
    assert found.count() == 20_000
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found.inputFiles()]
    assert len(files) > 7  # 80 MB, once in 4 parts
    one = common.cut(rows.coalesce(1), "held")
    (groups,) = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in one.inputFiles()]
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 2 * common.ROW_GROUP_BYTES
