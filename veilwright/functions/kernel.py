"""Spans of a pattern in a text, as one column expression.

Spark returns the values of all matches but only the first position, so values are marked in the text by one replacement,
which is split at the marks. Positions count code points, from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is found once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _marks(pattern: str) -> tuple[str, str, str]:
    """Private-use signs that the pattern doesn't name: before a value, behind it, and one that stands for both in a text."""
    free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in pattern)
    return next(free), next(free), next(free)


def spans(text: Column, value: str, left: str = "", right: str = "", prefilter: Column | None = None) -> Column:
    """Leftmost matches, one after another, of left + value + right (Java patterns without capturing groups); the span is value's.

    What right consumes is not available to the next match. prefilter is implied by the pattern and cheaper. Values are
    marked in one pass over the text, and the lengths of the pieces between marks add up to positions.
    """
    opened, closed, other = _marks(left + value + right)
    plain = F.when(F.contains(text, F.lit(opened)) | F.contains(text, F.lit(closed)), F.translate(text, opened + closed, other * 2)).otherwise(text)
    marked = F.regexp_replace(plain, F.lit(rf"(?s)({left})({value})({right})"), F.lit(f"$1{opened}$2{closed}$3"))

    def found(pieces: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            end = state["at"] + F.instr(piece, closed) - 1
            span = F.struct(state["at"].alias("start"), end.alias("end"), F.substring(text, state["at"] + 1, end - state["at"]).alias("value"))
            return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.array_append(state["found"], span).alias("found"))

        start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), no_spans().alias("found"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda s: s["found"])

    run = let(F.split(marked, opened, -1), lambda pieces: F.when(F.size(pieces) > 1, found(pieces)).otherwise(no_spans()))
    return F.when(prefilter, run).otherwise(no_spans()) if prefilter is not None else run


def literal_spans(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal, left to right; none of an empty one."""
    if not term:
        return no_spans()
    return spans(text, quoted(term), prefilter=F.contains(text, F.lit(term)))


def quoted(term: str) -> str:
    """A Java pattern for exactly this text, whatever it holds."""
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in term)


def spans_sql(text: str, value: str, left: str = "", right: str = "") -> str:
    """The same in DuckDB: a list of structs (s, e, v). Its patterns continue where the last match ended by themselves."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    pattern = q(f"(?s)(.*?{left})({value}){right}")
    w, p, v = (f"regexp_extract_all({text}, {pattern}, {i})" for i in (0, 1, 2))
    start = f"(coalesce(list_sum(list_transform({w}[1:n - 1], lambda x: length(x))), 0) + length({p}[n]))::INTEGER"
    return f"list_transform(range(1, len({v}) + 1), lambda n: struct_pack(s := {start}, e := ({start} + length({v}[n]))::INTEGER, v := {v}[n]))"
