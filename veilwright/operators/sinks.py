"""Writing results: redacted texts behind their check, drafts and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .redact import exportable


def with_bom(text: Column, has_bom: Column) -> Column:
    """UTF-8 bytes, with the byte order mark that the source had."""
    return F.when(has_bom, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).otherwise(text.cast("binary"))


def source_unchanged(tasks: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """tasks (key, sha256) with unchanged: whether sources (key, text) still have that hash."""
    now = sources.select(key, F.sha2(F.col("text").cast("binary"), 256).alias("now"))
    return tasks.join(now, key, "left").withColumn("unchanged", F.coalesce(F.col("sha256") == F.col("now"), F.lit(False))).drop("now")


def rendered(verified: DataFrame) -> DataFrame:
    """Outputs that passed, for showing or copying, without a file."""
    return exportable(verified).select("doc_id", "redacted")


def export_gate(verified: DataFrame, sources: DataFrame, taken: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """verified (key, text, ...) with export_error, null where the output may be written: SOURCE_CHANGED (sources (key, text) have
    another text now, or none), OUTPUT_EXISTS (keys of taken), UNREVIEWED_FINDINGS, the error of redaction, RESIDUALS_REMAIN. The first counts."""
    checked = source_unchanged(verified.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), sources, key).drop("sha256")
    there = (taken.select(key).distinct() if taken is not None else verified.select(key).limit(0)).withColumn("there", F.lit(True))
    error = (
        F.when(~F.col("unchanged"), "SOURCE_CHANGED")
        .when(F.col("there"), "OUTPUT_EXISTS")
        .when(F.col("unreviewed_findings") > 0, "UNREVIEWED_FINDINGS")
        .when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("residual_count") > 0, "RESIDUALS_REMAIN")
    )
    return checked.join(there, key, "left").withColumn("export_error", error).drop("unchanged", "there")


def export_batch(gated: DataFrame, path: str) -> DataFrame:
    """Writes what the gate lets through into a new folder; a document that fails stops no other. The outcome of each: doc_id, exported, export_error."""
    gated.where("export_error IS NULL").select("doc_id", "redacted", "output_sha256").write.mode("errorifexists").json(f"{path}/redacted")
    return gated.select("doc_id", F.col("export_error").isNull().alias("exported"), "export_error")


def copy_back(gated: DataFrame) -> DataFrame:
    """Texts that may go to a clipboard: those that the gate lets through."""
    return gated.where("export_error IS NULL").select("doc_id", "redacted")


def export_texts(verified: DataFrame, path: str) -> None:
    """Writes what passed into a new folder; one that exists is an error. What didn't pass goes beside it with its reasons, without text."""
    exportable(verified).select("doc_id", "redacted", "output_sha256").write.mode("errorifexists").json(f"{path}/redacted")
    reports(verified).where("NOT passed OR error_code IS NOT NULL").write.mode("errorifexists").json(f"{path}/held_back")


def reports(verified: DataFrame) -> DataFrame:
    """Reports hold places, kinds and counts; never a matched value."""
    return verified.select("doc_id", "passed", "complete", "error_code", "selected_findings", "unreviewed_findings", "target_residual_count", "residual_count", "residuals", "output_sha256")


def drafts(scanned: DataFrame, policy_id: str) -> DataFrame:
    """One JSON draft per document. Drafts hold sensitive text and say so."""
    draft = F.to_json(F.struct(F.lit(3).alias("schema_version"), F.concat(F.lit("task-"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12)).alias("task_id"), F.lit(policy_id).alias("policy_id"), "text", "findings", F.lit(True).alias("contains_sensitive_plaintext")))
    return scanned.select("doc_id", draft.alias("draft"))


def write_lines(rows: DataFrame, path: str) -> None:
    """A column of JSON or Markdown lines as text files."""
    rows.write.mode("errorifexists").text(path)
