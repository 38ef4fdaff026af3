"""Boxes (struct x0, y0, x1, y1) of lines and masks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def area(b: Column) -> Column:
    return (F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))).cast("long")


def shared_area(a: Column, b: Column) -> Column:
    across = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return (F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))).cast("long")


def intersection_over_union(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    return F.coalesce(F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double")), F.lit(0.0))


def covered_fraction(expected: Column, predicted: Column) -> Column:
    return F.coalesce(F.try_divide(shared_area(expected, predicted).cast("double"), area(expected).cast("double")), F.lit(0.0))


def valid_box(b: Column, width: Column, height: Column) -> Column:
    return (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & (b["x1"] <= width) & (b["y1"] <= height)


def text_weight(text: Column) -> Column:
    """Estimated width: ASCII punctuation 0.75, other ASCII 1, all else 1.5."""
    points = F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))
    ascii_ = F.regexp_count(text, F.lit(r"[\x00-\x7F]"))
    return points * 0.75 + (ascii_ - points) * 1.0 + (F.length(text) - ascii_) * 1.5


def span_box(line: Column, polygon: Column, text: Column, start: Column, end: Column) -> Column:
    """The part of a line's box that signs start to end take, by their weights; the whole box where the line is slanted,
    not clearly horizontal or vertical, or has no four corners."""
    width, height = line["x1"] - line["x0"], line["y1"] - line["y0"]
    point = lambda i, k: F.get(F.get(polygon, F.lit(i)), F.lit(k))
    top, side = F.abs(point(0, 1) - point(1, 1)), F.abs(point(0, 0) - point(3, 0))
    straight = lambda size: (top <= F.greatest(F.floor(size / 4), F.lit(4))) & (side <= F.greatest(F.floor(size / 4), F.lit(4)))
    across = (width >= height * 2) & straight(height)
    down = (height >= width * 2) & straight(width)
    total = text_weight(text)
    before, through = text_weight(F.substring(text, F.lit(1), start)), text_weight(F.substring(text, F.lit(1), end))
    fits = (start < end) & (end <= F.length(text)) & (F.length(text) > 1) & (F.size(polygon) == 4) & (total > 0)
    x0, x1 = line["x0"] + F.floor(width * before / total), line["x0"] + F.ceil(width * through / total)
    y0, y1 = line["y0"] + F.floor(height * before / total), line["y0"] + F.ceil(height * through / total)
    return (
        F.when(fits & across, box(x0, line["y0"], F.least(F.greatest(x1, x0 + 1), line["x1"]), line["y1"]))
        .when(fits & down, box(line["x0"], y0, line["x1"], F.least(F.greatest(y1, y0 + 1), line["y1"])))
        .otherwise(box(line["x0"], line["y0"], line["x1"], line["y1"]))
    )


def mask_box(part: Column, line: Column, margin: int, width: Column, height: Column) -> Column:
    """part widened by the margin, and by half a line's height along the writing, inside the image."""
    across, down = line["x1"] - line["x0"], line["y1"] - line["y0"]
    half = lambda size: F.floor((size + 1) / 2)
    x = F.when(across >= down, margin + half(down)).otherwise(F.lit(margin))
    y = F.when(across >= down, F.lit(margin)).otherwise(margin + half(across))
    return box(F.greatest(part["x0"] - x, F.lit(0)), F.greatest(part["y0"] - y, F.lit(0)), F.least(part["x1"] + x, width), F.least(part["y1"] + y, height))


def mapped_box(b: Column, matrix: list[list[float]], width: int, height: int) -> Column:
    """Bounding box of the four corners under a 3 x 3 homography, rounded outwards, inside the image."""

    def place(x: Column, y: Column) -> tuple[Column, Column]:
        (a, c, e), (d, f, g), (h, i, j) = matrix
        w = x * h + y * i + j
        return (x * a + y * c + e) / w, (x * d + y * f + g) / w

    points = [place(b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    low = [F.greatest(F.floor(F.least(*v)), F.lit(0)) for v in (xs, ys)]
    return box(*low, F.least(F.ceil(F.greatest(*xs)), F.lit(width)), F.least(F.ceil(F.greatest(*ys)), F.lit(height)))
