"""Projections and state of a batch of files: labels of parts, what reviewers see, status, names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels.
DOCX_SECTIONS = {"body": "正文", "header": "页眉", "footer": "页脚", "footnote": "脚注", "endnote": "尾注", "comment": "批注", "glossary": "术语库", "chart": "图表", "diagram": "图示"}
CELL_VALUES = {"number": "数值", "formula": "公式", "formula_cache": "公式缓存", "cell": "文本"}
SLIDE_SECTIONS = {"slide_master": ("ppt/slideMasters/slideMaster", "幻灯片母版"), "slide_layout": ("ppt/slideLayouts/slideLayout", "幻灯片版式"), "notes_master": ("ppt/notesMasters/notesMaster", "备注母版"), "handout_master": ("ppt/handoutMasters/handoutMaster", "讲义母版")}
AROUND = 80


def _lookup(column: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column), F.lit(default))


def locator_ordinal(locator: Column, prefix: str) -> Column:
    """Digits after prefix at the start of a locator."""
    return F.nullif(F.regexp_extract(locator, rf"\A{prefix}([0-9]+)", 1), F.lit("")).try_cast("long")


def marker_ordinal(locator: Column, marker: str) -> Column:
    """Digits after the first marker."""
    return F.nullif(F.regexp_extract(locator, rf"\A.*?{marker}([0-9]+)", 1), F.lit("")).try_cast("long")


def locator_reference(locator: Column, marker: str) -> Column:
    """What stands between marker and the next number sign, if it is a safe reference of a cell."""
    value = F.substring_index(F.get(F.split(locator, marker, 2), F.lit(1)), "#", 1)
    return F.when(F.regexp_like(value, F.lit(r"\A[A-Za-z0-9$]{1,20}\z")), value)


def with_part_number(parts: DataFrame) -> DataFrame:
    """part_number: place of a part among those of its kind."""
    return parts.withColumn("part_number", F.count("*").over(Window.partitionBy("doc_id", "kind").orderBy("part_ord")))


def docx_labels(parts: DataFrame) -> DataFrame:
    numbered = with_part_number(parts)
    label = _lookup(F.col("kind"), DOCX_SECTIONS, "文档内容")
    return numbered.withColumn("label", F.format_string("%s · 内容 %d", label, "part_number"))


def xlsx_labels(parts: DataFrame) -> DataFrame:
    """label, can_apply: names of sheets may only be kept."""
    p, at, kind = with_part_number(parts), F.col("locator"), F.col("kind")
    number = F.col("part_number").cast("string")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    sheet, cell, value = locator_ordinal(at, "xl/worksheets/sheet"), locator_reference(at, "#cell="), _lookup(kind, CELL_VALUES, "文本")
    note, ref = locator_ordinal(at, "xl/comments"), locator_reference(at, "#comment=")
    area = F.when(F.contains(at, F.lit("Footer")), "页脚").otherwise("页眉")
    drawing, tab, name = locator_ordinal(at, "xl/drawings/drawing"), marker_ordinal(at, "#sheet="), marker_ordinal(at, "#definedName=")
    label = (
        F.when(kind.isin(*CELL_VALUES), F.coalesce(text("工作表 ", sheet, " · 单元格 ", cell, " · ", value), text("单元格 ", cell, " · ", value), text(value, " · 内容 ", number)))
        .when(kind == "comment", F.coalesce(text("批注 ", note, " · 单元格 ", ref), text("批注 · 内容 ", number)))
        .when(kind == "header_footer", F.coalesce(text("工作表 ", sheet, " · ", area), text(area, " · 内容 ", number)))
        .when(kind == "drawing_text", F.coalesce(text("绘图 ", drawing, " · 文字 ", number), text("绘图文字 · 内容 ", number)))
        .when(kind == "sheet_name", F.coalesce(text("工作表 ", tab, " · 名称"), text("工作表名称 · 内容 ", number)))
        .when(kind == "defined_name", F.coalesce(text("定义名称 ", name), text("定义名称 · 内容 ", number)))
        .otherwise(text("工作簿内容 · 内容 ", number))
    )
    return p.withColumn("label", label).withColumn("can_apply", kind != "sheet_name")


def pptx_labels(parts: DataFrame) -> DataFrame:
    p, at, kind = with_part_number(parts), F.col("locator"), F.col("kind")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    place = F.coalesce(text("段落 ", marker_ordinal(at, "#p")), text("文本 ", marker_ordinal(at, "#t")), text("内容 ", F.col("part_number")))
    slide, notes = locator_ordinal(at, "ppt/slides/slide"), locator_ordinal(at, "ppt/notesSlides/notesSlide")
    comment = F.coalesce(locator_ordinal(at, "ppt/comments/comment"), locator_ordinal(at, "ppt/comments/comments"))
    label = (
        F.when(kind == "slide", F.coalesce(text("幻灯片 ", slide, " · ", place), text("幻灯片 · ", place)))
        .when(kind == "notes", F.coalesce(text("幻灯片 ", notes, " · 备注 · ", place), text("演讲者备注 · ", place)))
        .when(kind == "comment", F.coalesce(text("批注 ", comment, " · ", place), text("批注 · ", place)))
    )
    for name, (prefix, title) in SLIDE_SECTIONS.items():
        label = label.when(kind == name, F.coalesce(text(f"{title} ", locator_ordinal(at, prefix), " · ", place), text(f"{title} · ", place)))
    return p.withColumn("label", label.when(kind == "diagram", text("关系图 · ", place)).otherwise(text("演示文稿内容 · ", place)))


def review_projection(findings: DataFrame, parts: DataFrame) -> DataFrame:
    """What a reviewer gets of a finding: up to 80 signs on each side, no path and no locator."""
    both = findings.join(parts.select("doc_id", F.col("text").alias("t")), "doc_id")
    return both.select("doc_id", "finding_ord", "entity_type", "matched_text", F.expr(f"substring(t, greatest(start - {AROUND}, 0) + 1, start - greatest(start - {AROUND}, 0))").alias("before"), F.expr(f"substring(t, end + 1, {AROUND})").alias("after"), "selected", "reviewed")


def scan_states(tasks: DataFrame) -> DataFrame:
    """tasks (id, event, unreviewed, error_code): the status after the last event of each: queued, scanned, failed,
    cancelled, exporting, exported or export_failed."""
    e = F.col("event")
    status = (
        F.when(e == "queued", "queued")
        .when(e == "failed", "blocked")
        .when(e == "cancelled", "cancelled")
        .when((e == "scanned") & (F.col("unreviewed") > 0), "review_required")
        .when(e == "scanned", "ready_to_export")
        .when(e == "exporting", "exporting")
        .when(e == "exported", "complete")
        .when(e == "export_failed", "export_failed")
    )
    return tasks.withColumn("status", status)


def eligible(files: DataFrame) -> DataFrame:
    """What may be scanned: ready and supported, and new or else blocked or cancelled before."""
    return files.where(F.col("ready") & F.col("scan_supported") & (F.col("status").isNull() | F.col("status").isin("blocked", "cancelled")))


def output_names(files: DataFrame, taken: DataFrame, most: int = 10_000) -> DataFrame:
    """files (id, stem, extension) with output_name: stem_redacted.ext, then _2, _3 and so on past names that are taken.
    The k-th file of a name gets the k-th free number; beyond most, null."""
    wanted = files.withColumn("k", F.row_number().over(Window.partitionBy("stem", "extension").orderBy("id")))
    number = F.when(F.col("rest") == "", 1).otherwise(F.regexp_extract("rest", r"\A_([0-9]+)\z", 1).try_cast("int"))
    names = taken.select(F.regexp_extract("name", r"\A(.*)_redacted((?:_[0-9]+)?)\.([^.]+)\z", 1).alias("stem"), F.regexp_extract("name", r"\A(.*)_redacted((?:_[0-9]+)?)\.([^.]+)\z", 2).alias("rest"), F.regexp_extract("name", r"\A(.*)_redacted((?:_[0-9]+)?)\.([^.]+)\z", 3).alias("extension"))
    used = names.where("stem <> ''").withColumn("number", number).where("number IS NOT NULL").select("stem", "extension", "number").distinct()
    # the j-th taken number leaves number - j free ones before it
    gaps = used.withColumn("free", F.col("number") - F.row_number().over(Window.partitionBy("stem", "extension").orderBy("number")))
    passed = wanted.join(gaps, ["stem", "extension"], "left").groupBy("id", "stem", "extension", "k").agg(F.count_if(F.col("free") < F.col("k")).alias("passed"))
    n = F.col("k") + F.col("passed")
    name = F.when(n == 1, F.concat("stem", F.lit("_redacted."), "extension")).when(n <= most, F.concat("stem", F.lit("_redacted_"), n.cast("string"), F.lit("."), "extension"))
    return passed.select("id", name.alias("output_name"))


def export_summary(tasks: DataFrame) -> DataFrame:
    """tasks (status, exported, complete): counts only, no names."""
    wanted = F.col("status").isin("ready_to_export", "export_failed", "complete")
    return tasks.agg(
        F.count_if(wanted).alias("attempted"),
        F.count_if(wanted & F.col("exported")).alias("succeeded"),
        F.count_if(wanted & ~F.col("exported")).alias("failed"),
        F.count_if(~wanted).alias("skipped"),
        F.count_if(wanted & F.col("exported") & F.col("complete")).alias("complete_verifications"),
        F.count_if(wanted & F.col("exported") & ~F.col("complete")).alias("basic_verifications"),
    )
