from pyspark.sql import functions as F

from veilwright.streaming import scan


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "手机：13800000001"), (2, "nothing"), (3, None)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    query = scan.write_scans(scan.scan_stream(scan.read_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    out = {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out/redacted")).collect()}
    assert out == {1: "手机：[手机号]", 2: "nothing", 3: ""}
    assert spark.read.parquet(str(tmp_path / "out/reports")).agg(F.count_if("passed")).first()[0] == 3
