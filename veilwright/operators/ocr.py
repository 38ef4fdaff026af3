"""Recognised lines of page images: validation, one text per page, masks for findings, the check of a masked page.

ocr_lines: page_id, line_index, text, score (float), bbox (struct x0..y1), polygon (array of array of int).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import detect
from .policy import Policy, apply_policy
from .redact import run_detection, settled

LINES = "page_id long, line_index int, text string, score float, bbox struct<x0:int,y0:int,x1:int,y1:int>, polygon array<array<int>>"
#: Limits of a page and of its lines.
MOST_LINES, MOST_SIGNS, MOST_SIDE, MOST_PIXELS = 10_000, 4096, 20_000, 100_000_000


def line_errors(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, code) of responses to reject as a whole. pages: page_id, width, height."""
    count = lines.groupBy("page_id").agg(F.count("*").alias("n"))
    joined = pages.join(count, "page_id", "left")
    w, h = F.col("width"), F.col("height")
    size = (w <= 0) | (h <= 0) | (w > MOST_SIDE) | (h > MOST_SIDE) | (w.cast("long") * h > MOST_PIXELS)
    whole = joined.select("page_id", F.when(size, "INVALID_IMAGE_DIMENSIONS").when(F.col("n") > MOST_LINES, "INVALID_OCR_LINE").alias("code"))
    at = lines.join(pages, "page_id")
    outside = F.exists("polygon", lambda p: (F.get(p, F.lit(0)) > w) | (F.get(p, F.lit(1)) > h))
    bad = (
        (F.length("text") == 0)
        | (F.length("text") > MOST_SIGNS)
        | F.regexp_like("text", F.lit(r"[\r\n\x00]"))
        | F.isnan("score")
        | ~F.col("score").between(0.0, 1.0)
        | ~geometry.valid_box(F.col("bbox"), w, h)
        | ~F.size("polygon").between(4, 32)
        | outside
    )
    return whole.unionByName(at.select("page_id", F.when(bad, "INVALID_OCR_LINE").alias("code"))).where("code IS NOT NULL").distinct()


def layout(lines: DataFrame) -> DataFrame:
    """Lines with start and end in the page's text, where they are joined by line breaks."""
    order = Window.partitionBy("page_id").orderBy("line_index")
    before = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))
    return placed.withColumn("end", F.col("start") + F.length("text"))


def page_texts(lines: DataFrame) -> DataFrame:
    """page_id, text. A page has at most MOST_LINES lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def line_at(offsets: DataFrame, placed: DataFrame) -> DataFrame:
    """offsets (page_id, offset) with the first line that holds the offset, null in a line break."""
    joined = offsets.join(placed.select("page_id", "line_index", "start", "end"), "page_id", "left").where("start <= offset AND offset < end")
    found = joined.groupBy("page_id", "offset").agg(F.min_by("line_index", "start").alias("line_index"))
    return offsets.join(found, ["page_id", "offset"], "left")


def image_findings(findings: DataFrame, placed: DataFrame, pages: DataFrame, policy: Policy) -> DataFrame:
    """One row per finding and line it touches, with the box to mask. findings: page_id, finding_ord and the finding's fields."""
    margin, least = policy.image_mask.safety_margin_px, F.lit(policy.image_mask.auto_apply_min_ocr_confidence).cast("float")
    lines = placed.select("page_id", "line_index", F.col("text").alias("line"), "score", "bbox", "polygon", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    both = findings.join(lines, "page_id").where("start < l_end AND l_start < end").join(pages, "page_id")
    both = both.withColumn("text_start", F.greatest("start", "l_start") - F.col("l_start")).withColumn("text_end", F.least("end", "l_end") - F.col("l_start"))
    sure = F.col("score") >= least
    part = geometry.span_box(F.col("bbox"), F.col("polygon"), F.col("line"), F.col("text_start"), F.col("text_end"))
    order = Window.partitionBy("page_id").orderBy("line_index", detect.entity_order(F.col("entity_type")), "finding_ord")
    return both.withColumn("part", part).select(
        "page_id",
        F.format_string("image-group-%04d", F.col("finding_ord") + 1).alias("group_id"),
        F.format_string("image-finding-%04d", F.row_number().over(order)).alias("finding_id"),
        "line_index",
        "text_start",
        "text_end",
        "entity_type",
        F.expr("substring(line, text_start + 1, text_end - text_start)").alias("line_fragment"),
        F.least("confidence", "score").alias("confidence"),
        F.col("bbox").alias("ocr_rect"),
        geometry.mask_box(F.col("part"), F.col("bbox"), margin, F.col("width"), F.col("height")).alias("mask_rect"),
        (F.col("selected") & sure).alias("selected"),
        (F.col("reviewed") & sure).alias("reviewed"),
        "matched_text",
    )


def scan_pages(lines: DataFrame, pages: DataFrame, policy: Policy) -> DataFrame:
    """From lines to masks."""
    texts = page_texts(lines)
    found = settled(texts, "findings", run_detection(F.col("text"), policy))
    found = settled(found, "findings", apply_policy(F.col("findings"), policy))
    return image_findings(detect.exploded(found, keys=("page_id",)), layout(lines), pages, policy)


def group_states(findings: DataFrame) -> DataFrame:
    """Per page: groups, those selected somewhere, and those reviewed everywhere."""
    groups = findings.groupBy("page_id", "group_id").agg(F.bool_or("selected").alias("selected"), F.bool_and("reviewed").alias("reviewed"))
    return groups.groupBy("page_id").agg(F.count("*").alias("groups"), F.count_if("selected").alias("selected_groups"), F.count_if("reviewed").alias("reviewed_groups"))


def page_residuals(findings: DataFrame, after: DataFrame, policy: Policy) -> DataFrame:
    """What lines recognised on masked pages (after) still hold: selected values, at their first place each, then what
    detection finds again but for values kept by review; one row per page, line, entity and box."""
    texts, placed = page_texts(after), layout(after)
    chosen = findings.where("selected").select("page_id", "entity_type", "matched_text").distinct()
    kept = findings.where("reviewed AND NOT selected").select("page_id", "entity_type", "matched_text").distinct()
    targets = chosen.join(texts, "page_id").where(F.contains("text", F.col("matched_text")))
    targets = targets.select("page_id", "entity_type", (F.expr("instr(text, matched_text)") - 1).alias("offset"), F.lit("target_value_check").alias("detector"), F.lit("SELECTED_VALUE_REMAINS").alias("explanation_code"), F.lit(0).alias("source"))
    again = detect.exploded(settled(texts, "findings", run_detection(F.col("text"), policy)), keys=("page_id",))
    fresh = again.join(kept, ["page_id", "entity_type", "matched_text"], "left_anti")
    fresh = fresh.select("page_id", "entity_type", F.col("start").alias("offset"), "detector", "explanation_code", F.lit(1).alias("source"))
    every = targets.unionByName(fresh)
    lines = placed.select("page_id", "line_index", "bbox", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    at = every.join(lines, "page_id").where("l_start <= offset AND offset < l_end")
    first = F.row_number().over(Window.partitionBy("page_id", "line_index", "entity_type", "bbox").orderBy("source", "offset"))
    return at.withColumn("n", first).where("n = 1").select("page_id", "line_index", "entity_type", "detector", "explanation_code", F.col("bbox").alias("ocr_rect"))


def with_manual_masks(findings: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds boxes that a reviewer drew (page_id, group_id, mask_rect): business metrics, selected and reviewed, without text."""
    m = masks.select("page_id", "group_id", F.concat("group_id", F.lit("-manual")).alias("finding_id"), F.lit("BUSINESS_METRIC").alias("entity_type"), F.lit("user").alias("detector"), "mask_rect", F.lit(True).alias("selected"), F.lit(True).alias("reviewed"), F.lit(True).alias("manual"))
    return findings.withColumn("detector", F.lit(detect.rules.RULES_DETECTOR)).withColumn("manual", F.lit(False)).unionByName(m, allowMissingColumns=True)


def without_manual_group(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Takes back manual groups; others stay."""
    return findings.join(groups.withColumn("manual", F.lit(True)), ["page_id", "group_id", "manual"], "left_anti")


def move_mask(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (page_id, finding_id, new_rect): the box moves, its whole group becomes selected and reviewed."""
    groups = findings.join(edits, ["page_id", "finding_id"]).select("page_id", "group_id").distinct().withColumn("edited", F.lit(True))
    joined = findings.join(edits, ["page_id", "finding_id"], "left").join(groups, ["page_id", "group_id"], "left")
    edited = F.coalesce("edited", F.lit(False))
    return joined.withColumns({"mask_rect": F.coalesce("new_rect", "mask_rect"), "selected": F.col("selected") | edited, "reviewed": F.col("reviewed") | edited}).select(*findings.columns)


def mask_projection(findings: DataFrame) -> DataFrame:
    """What a mask editor gets: geometry and state, no recognised text."""
    return findings.select("page_id", "group_id", "finding_id", "entity_type", "ocr_rect", "mask_rect", "selected", "reviewed")
