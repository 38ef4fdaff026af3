"""Synthetic cases: texts put together from pieces, with the spans of the labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from . import detect

ENTITY = "struct<start:int,end:int,label:string,text:string>"


def piece(text: Column, label: str | None = None) -> Column:
    return F.struct(text.alias("text"), F.lit(label).cast("string").alias("label"))


def compose(pieces: Column) -> Column:
    """pieces: array of (text, label or null). A struct of the joined text and its entities."""

    def step(state: Column, p: Column) -> Column:
        start = F.length(state["text"])
        entity = F.struct(start.alias("start"), (start + F.length(p["text"])).alias("end"), p["label"].alias("label"), p["text"].alias("text"))
        return F.struct(F.concat(state["text"], p["text"]).alias("text"), F.when(p["label"].isNotNull(), F.array_append(state["entities"], entity)).otherwise(state["entities"]).alias("entities"))

    return F.aggregate(pieces, F.struct(F.lit("").alias("text"), F.array().cast(f"array<{ENTITY}>").alias("entities")), step)


#: Pages of a manifest: size, place of the first line, signs in a line by size of the letters.
PAGE_WIDTH, PAGE_HEIGHT, LEFT, TOP = 1280, 720, 64, 54


def page_manifest(cases: DataFrame, font_size: int = 30, style: str = "plain") -> DataFrame:
    """Evaluation pages of cases (id, text, entities, tags): geometry only, letters as wide as their weight.

    line_regions has the box of each line, sensitive_regions that of each part of an entity on a line; lines are 28 signs
    long from a size of 30 on, else 34.
    """
    gap, signs = max(10, font_size // 3), 28 if font_size >= 30 else 34
    wide = lambda text: F.round(geometry.text_weight(text) * font_size / 2).cast("int")
    part = lambda start, end: F.substring(F.col("text"), start + 1, end - start)
    lines = F.transform(scalars.wrapped(F.col("text"), signs), lambda w, i: F.struct(w["line"].alias("text"), w["start"].alias("start"), (w["start"] + F.length(w["line"])).alias("end"), (TOP + i * (font_size + gap)).cast("int").alias("y")))

    def boxed(text: Column, start: Column, end: Column, x: Column, y: Column, **more: Column) -> Column:
        box = geometry.box(x, y, x + wide(text), y + font_size)
        return F.struct(text.alias("text"), *[c.alias(n) for n, c in more.items()], start.alias("start"), end.alias("end"), box.alias("bbox"))

    def fragments(line: Column) -> Column:
        inside = F.filter("entities", lambda e: (e["start"] < line["end"]) & (line["start"] < e["end"]))

        def one(e: Column) -> Column:
            a, b = F.greatest(e["start"], line["start"]), F.least(e["end"], line["end"])
            return boxed(part(a, b), a, b, LEFT + wide(part(line["start"], a)), line["y"], label=e["label"])

        return F.transform(inside, one)

    placed = detect.settled(cases, "lines", lines)
    return placed.select(
        F.concat(F.lit("ocr-"), "id").alias("id"),
        F.col("id").alias("source_id"),
        "text",
        scalars.without_space(F.col("text")).alias("normalized_text"),
        F.lit(style).alias("style"),
        F.lit(font_size).alias("font_size"),
        F.lit(PAGE_WIDTH).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height"),
        F.transform("lines", lambda x: boxed(x["text"], x["start"], x["end"], F.lit(LEFT), x["y"])).alias("line_regions"),
        F.flatten(F.transform("lines", fragments)).alias("sensitive_regions"),
        F.concat("tags", F.array(F.lit("synthetic_ocr"), F.lit(style))).alias("tags"),
    )
