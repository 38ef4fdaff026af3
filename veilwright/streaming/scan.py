"""Streams of documents through the same stateless detection, and the state of each task as a running fold of its events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import Policy
from ..operators.redact import redact_and_verify
from ..operators.sinks import exportable, reports


def read_documents(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """New Parquet files of documents (doc_id, text, ...) under path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def scan_stream(documents: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Detection, redaction and check have no state, so a stream needs neither watermark nor shuffle."""
    return redact_and_verify(documents, policy or Policy())


def write_scans(scanned: DataFrame, path: str, checkpoint: str, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch goes to two folders: what passed, and reports. A batch that is run again replaces its own files.
    Stopping the query cancels the scan; it goes on where it stopped."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        exportable(batch).select("doc_id", "redacted").write.mode("overwrite").parquet(f"{path}/redacted/batch={number}")
        reports(batch).write.mode("overwrite").parquet(f"{path}/reports/batch={number}")
        if progress:
            progress(number, batch.count())
        batch.unpersist()

    return scanned.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events (id, ts, event) of a stream: how often each event came per task and hour; late ones are waited for."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "id", "event").agg(F.count("*").alias("n"))
