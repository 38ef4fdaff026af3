"""Redaction, the independent check of its result, and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detect, resolve
from .detect import core_findings, exact_findings, fences, settled
from .policy import Policy, apply_policy, filter_findings
from .rules import RULES_DETECTOR, TERMS_DETECTOR

RESIDUAL = "struct<start:int,end:int,entity_type:string,detector:string,explanation_code:string>"


def run_detection(text: Column, policy: Policy, models: list[tuple[str, Column]] = (), kind: Column | None = None) -> Column:
    """Rules, exact terms, filter, models by priority, filter again, in order. models: (detector id, findings) that answered."""
    ranges = F.when(kind == "markdown", fences(text)).otherwise(F.array().cast("array<struct<open:int,close:int>>")) if kind is not None else None
    found = core_findings(text, ranges, policy.scan_markdown_code)
    if policy.exact_terms:
        found = resolve.merge_exact(found, exact_findings(text, policy.exact_terms, ranges, policy.scan_markdown_code))
    found = filter_findings(found, policy)
    order = sorted((d for d in policy.detectors if d.enabled), key=lambda d: -d.priority)
    answers = dict(models)
    for d in order:
        if d.id in answers:
            found = resolve.merge_model(found, _sure(answers[d.id], d.min_confidence))
    return detect.in_order(filter_findings(found, policy) if models else found)


def _sure(findings: Column, least: float) -> Column:
    return F.filter(findings, lambda f: f["confidence"] >= F.lit(least).cast("float"))


def checked_detectors(policy: Policy, answered: list[str] = ()) -> list[str]:
    return sorted([RULES_DETECTOR, *([TERMS_DETECTOR] if policy.exact_terms else []), *answered])


def scan(parts: DataFrame, policy: Policy, kind: str | None = None) -> DataFrame:
    """parts (doc_id, text) with findings as the policy decides on them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = run_detection(text, policy, kind=F.col(kind) if kind else None)
    return settled(settled(parts, "findings", found), "findings", apply_policy(F.col("findings"), policy))


def _chosen(findings: Column) -> Column:
    return detect.in_order(F.filter(findings, lambda f: f["selected"]))


def span_error(text: Column, findings: Column) -> Column:
    """Null, or why the selected findings can't be applied: OVERLAPPING_FINDINGS, INVALID_SPAN or TEXT_MISMATCH."""

    def step(state: Column, f: Column) -> Column:
        bad = (f["start"] < 0) | (f["start"] >= f["end"]) | (f["end"] > F.length(text))
        differs = F.substring(text, f["start"] + 1, f["end"] - f["start"]) != f["matched_text"]
        error = F.when(bad, "INVALID_SPAN").when(differs, "TEXT_MISMATCH").when(f["start"] < state["at"], "OVERLAPPING_FINDINGS")
        return F.struct(F.greatest(state["at"], f["end"]).alias("at"), F.coalesce(state["error"], error).alias("error"))

    return F.aggregate(_chosen(findings), F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("error")), step, lambda s: s["error"])


def redacted(text: Column, findings: Column) -> Column:
    """text with each selected span replaced."""

    def step(state: Column, f: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(f["start"] - state["at"], F.lit(0)))
        return F.struct(f["end"].alias("at"), F.concat(state["out"], kept, f["replacement"]).alias("out"))

    end = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(_chosen(findings), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)


def redact(parts: DataFrame) -> DataFrame:
    """parts (text, findings) with error_code and redacted (null where there is an error)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    checked = settled(parts, "error_code", span_error(text, F.col("findings")))
    return settled(checked, "redacted", F.when(F.col("error_code").isNull(), redacted(text, F.col("findings"))))


def occurrences(text: Column, value: Column) -> Column:
    """Starts of non-overlapping occurrences of value, left to right."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, quoted, -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))

    def step(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n + F.length(value)).alias("at"), F.array_append(state["found"], state["at"] + n).alias("found"))

    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step, lambda s: s["found"])


def target_residuals(output: Column, findings: Column) -> Column:
    """Selected values that the output still holds, every occurrence once."""

    def left(f: Column) -> Column:
        starts = F.when(F.contains(output, f["matched_text"]), occurrences(output, f["matched_text"])).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.length(f["matched_text"])).alias("end"), f["entity_type"].alias("entity_type"), F.lit("target_value_check").alias("detector"), F.lit("SELECTED_VALUE_REMAINS").alias("explanation_code")))

    return F.array_distinct(F.flatten(F.transform(F.filter(findings, lambda f: f["selected"]), left)))


def residuals(output: Column, findings: Column, again: Column) -> Column:
    """Target residuals, then what scanning the output again finds, but for values that a reviewer kept."""
    kept = F.transform(F.filter(findings, lambda f: f["reviewed"] & ~f["selected"]), lambda f: F.struct(f["entity_type"], f["matched_text"]))
    fresh = F.filter(again, lambda f: ~F.array_contains(kept, F.struct(f["entity_type"], f["matched_text"])))
    rows = F.transform(fresh, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["entity_type"].alias("entity_type"), f["detector"].alias("detector"), f["explanation_code"].alias("explanation_code")))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"])
    every = F.concat(target_residuals(output, findings), rows)
    return F.aggregate(every, F.array().cast(f"array<{RESIDUAL}>"), lambda out, r: F.when(F.exists(out, lambda o: same(o, r)), out).otherwise(F.array_append(out, r)))


def verify(parts: DataFrame, policy: Policy, output: str = "redacted", kind: str | None = None) -> DataFrame:
    """parts (findings, output) with residuals and the report: no column of it holds a matched value."""
    text = F.coalesce(F.col(output), F.lit(""))
    again = settled(parts, "again", run_detection(text, policy, kind=F.col(kind) if kind else None))
    left = settled(again, "residuals", residuals(text, F.col("findings"), F.col("again"))).drop("again")
    count = lambda keep: F.size(F.filter("findings", keep))
    report = {
        "selected_findings": count(lambda f: f["selected"]),
        "unreviewed_findings": count(lambda f: ~f["reviewed"]),
        "target_residual_count": F.size(F.filter("residuals", lambda r: r["detector"] == "target_value_check")),
        "residual_count": F.size("residuals"),
        "passed": (count(lambda f: ~f["reviewed"]) == 0) & (F.size("residuals") == 0),
        "complete": F.lit(all(d.id in checked_detectors(policy) for d in policy.detectors if d.enabled)),
        "output_sha256": F.sha2(text.cast("binary"), 256),
    }
    return left.withColumns(report)


def redact_and_verify(parts: DataFrame, policy: Policy, kind: str | None = None) -> DataFrame:
    """Scan, redact, check: one narrow stage over the parts."""
    return verify(redact(scan(parts, policy, kind)), policy, kind=kind)


def exportable(verified: DataFrame) -> DataFrame:
    """What may be written: reviewed, without error, without residuals."""
    return verified.where(F.col("passed") & F.col("error_code").isNull())


def review(findings: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("doc_id", "finding_id")) -> DataFrame:
    """findings as rows with decisions (keys, selected, replacement or null): a decision counts as a review.
    Decisions whose replacement is longer than 256 signs change nothing."""
    usable = decisions.where(F.col("replacement").isNull() | (F.length("replacement") <= 256))
    d = usable.select(*keys, F.col("selected").alias("d_selected"), F.col("replacement").alias("d_replacement"), F.lit(True).alias("decided"))
    joined = findings.join(d, list(keys), "left")
    new = joined.withColumn("selected", F.coalesce("d_selected", "selected")).withColumn("replacement", F.coalesce("d_replacement", "replacement")).withColumn("reviewed", F.coalesce("decided", "reviewed"))
    return new.select(*findings.columns)


def review_groups(findings: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("page_id", "group_id")) -> DataFrame:
    """A decision on a group holds for all its boxes."""
    d = decisions.select(*keys, F.col("selected").alias("d_selected"), F.lit(True).alias("decided"))
    joined = findings.join(d, list(keys), "left")
    return joined.withColumn("selected", F.coalesce("d_selected", "selected")).withColumn("reviewed", F.coalesce("decided", "reviewed")).select(*findings.columns)


def review_cells(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spreadsheets: a decision on a formula or its cached value holds for every such finding of the cell; names of
    sheets may only be kept. decisions (doc_id, finding_id, selected, replacement)."""
    cell = F.regexp_replace("locator", r"(/formula|/cache)\z", "")
    formula = F.col("kind").isin("formula", "formula_cache")
    placed = findings.withColumn("cell", F.when(formula, cell).otherwise(F.concat_ws("#", "locator", "finding_id")))
    chosen = decisions.join(placed.select("doc_id", "finding_id", "cell", "kind"), ["doc_id", "finding_id"]).where(~((F.col("kind") == "sheet_name") & F.col("selected")))
    per_cell = chosen.groupBy("doc_id", "cell").agg(F.max_by(F.struct("selected", "replacement"), "finding_id").alias("d"))
    joined = placed.join(per_cell, ["doc_id", "cell"], "left")
    new = joined.withColumn("reviewed", F.col("reviewed") | F.col("d").isNotNull()).withColumn("replacement", F.coalesce("d.replacement", "replacement")).withColumn("selected", F.coalesce("d.selected", "selected"))
    return new.select(*findings.columns)


def held_kinds(findings: DataFrame) -> DataFrame:
    """Formulas, their cached values and sheet names start without a decision."""
    held = F.col("kind").isin("formula", "formula_cache", "sheet_name")
    return findings.withColumn("selected", F.col("selected") & ~held).withColumn("reviewed", F.col("reviewed") & ~held)


def task_errors(parts: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, finding_id, code) of what makes a task invalid: DUPLICATE_ID, MISSING_PART, INVALID_SPAN, TEXT_MISMATCH, OVERLAPPING_FINDINGS."""
    joined = findings.join(parts.select(*keys, F.col("text").alias("part_text")), list(keys), "left")
    same = Window.partitionBy(*keys, "finding_id")
    order = Window.partitionBy(*keys).orderBy("start", "end", "finding_id")
    chosen = F.when(F.col("selected"), F.col("end"))
    before = F.max(chosen).over(order.rowsBetween(Window.unboundedPreceding, -1))
    code = (
        F.when(F.count("*").over(same) > 1, "DUPLICATE_ID")
        .when(F.col("part_text").isNull(), "MISSING_PART")
        .when((F.col("start") >= F.col("end")) | (F.col("end") > F.length("part_text")), "INVALID_SPAN")
        .when(F.expr("substring(part_text, start + 1, end - start)") != F.col("matched_text"), "TEXT_MISMATCH")
        .when(F.col("selected") & (F.col("start") < before), "OVERLAPPING_FINDINGS")
    )
    return joined.withColumn("code", code).where("code IS NOT NULL").select(*keys, "finding_id", "code")
