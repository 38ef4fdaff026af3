"""Checksums, windows of context and small conversions, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the resident identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _id_check(body: Column) -> Column:
    total = sum((F.try_element_at(F.split(body, ""), F.lit(i + 1)).try_cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    return F.substring(F.lit(ID_CHECKS), F.pmod(total, F.lit(11)) + 1, F.lit(1))


def valid_cn_id(value: Column) -> Column:
    """18 digits, the last of which may be X, whose check sign is right; other signs are left out first."""
    plain = only(value, "0-9Xx")
    shaped = F.regexp_like(plain, F.lit(r"\A[0-9]{17}[0-9Xx]\z"))
    return F.coalesce(F.when(shaped, F.upper(F.substring(plain, 18, 1)) == _id_check(plain)).otherwise(F.lit(False)), F.lit(False))


def cn_id_check_digit(body: Column) -> Column:
    """Check sign of the first 17 digits."""
    return _id_check(body)


def _luhn_sum(digits: Column, parity: Column) -> Column:
    n = F.length(digits)
    number = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(F.pmod(i, F.lit(2)) == parity, doubled(number(i))).otherwise(number(i)))


def valid_luhn(value: Column) -> Column:
    """12 to 19 digits, other signs left out, whose Luhn sum is a multiple of ten."""
    digits = only(value, "0-9")
    fits = F.length(digits).between(12, 19)
    return F.coalesce(F.when(fits, F.pmod(_luhn_sum(digits, F.pmod(F.length(digits), F.lit(2))), F.lit(10)) == 0).otherwise(F.lit(False)), F.lit(False))


def luhn_check_digit(body: Column) -> Column:
    """The digit that makes body + digit valid."""
    total = _luhn_sum(body, F.pmod(F.length(body) + 1, F.lit(2)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def valid_cn_id_date(value: Column) -> Column:
    """Digits 7 to 14 are a date and the number doesn't begin with 00 or 62."""
    date = F.try_to_timestamp(F.substring(value, 7, 8), F.lit("yyyyMMdd"))
    return F.coalesce(date.isNotNull() & ~F.substring(value, 1, 2).isin("00", "62"), F.lit(False))


def window(text: Column, start: Column, end: Column, left: int, right: int) -> Column:
    """Up to left signs before start, the span, and up to right signs after end."""
    begin = F.greatest(start - left, F.lit(0))
    return F.substring(text, begin + 1, end + right - begin)


def context(text: Column, start: Column, end: Column) -> Column:
    """The context of the core rules: 25 signs to the left, 24 to the right."""
    return window(text, start, end, 25, 24)


def before(text: Column, start: Column, signs: int) -> Column:
    begin = F.greatest(start - signs, F.lit(0))
    return F.substring(text, begin + 1, start - begin)


def has_any(text: Column, cues: Sequence[str]) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def splice(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), replacement, F.substring(text, end + 1, F.length(text)))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def line_ending(text: Column) -> Column:
    """none, lf, cr_lf, cr or mixed."""
    pairs = F.regexp_count(text, F.lit("\r\n"))
    rest = F.replace(text, F.lit("\r\n"), F.lit(""))
    lf, cr = F.regexp_count(rest, F.lit("\n")), F.regexp_count(rest, F.lit("\r"))
    kinds = (pairs > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(pairs > 0, "cr_lf").when(lf > 0, "lf").otherwise("cr")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def task_id(text: Column) -> Column:
    return F.concat(F.lit("task-"), F.substring(sha256_hex(text), 1, 12))


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.2f%%", ratio * 100)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def leading_number(text: Column, prefix: str) -> Column:
    """The digits that follow prefix, null if there are none."""
    return F.nullif(F.regexp_extract(text, rf"\A{prefix}(\d+)", 1), F.lit("")).try_cast("long")


def safe_marker(text: Column, prefix: str) -> Column:
    """1 to 20 letters, digits or dollar signs after prefix, as far as they go; else null."""
    value = F.regexp_extract(text, rf"\A{prefix}([A-Za-z0-9$]+)\z", 1)
    return F.when(F.length(value).between(1, 20), value)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width signs: array of (line, start), line breaks not part of lines; empty lines are left out."""
    lines = F.split(text, "\n")
    starts = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y) + 1).alias("start")))
    cuts = lambda x: F.transform(
        F.when(F.length(x["line"]) > 0, F.sequence(F.lit(0), F.length(x["line"]) - 1, F.lit(width))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.substring(x["line"], k + 1, F.lit(width)).alias("line"), (x["start"] + k).cast("int").alias("start")),
    )
    return F.flatten(F.transform(starts, cuts))
