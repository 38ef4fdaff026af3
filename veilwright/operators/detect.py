"""Detection: findings of a text as one array column, so that a scan of the parts is the only stage.

A finding is a struct: start, end, entity_type, matched_text, detector, confidence (float), explanation_code,
selected, reviewed, replacement, rule_ord.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel, scalars
from . import rules
from .rules import BASELINE, CONTEXT, CORE, Rule

FINDING = (
    "struct<start:int,end:int,entity_type:string,matched_text:string,detector:string,confidence:float,"
    "explanation_code:string,selected:boolean,reviewed:boolean,replacement:string,rule_ord:int>"
)
FIELDS = ("start", "end", "entity_type", "matched_text", "detector", "confidence", "explanation_code", "selected", "reviewed", "replacement", "rule_ord")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as column name, found once: the generator keeps the optimizer from copying value into its uses."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def none_found() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def placeholder(entity: Column) -> Column:
    pairs = [F.lit(x) for pair in rules.PLACEHOLDERS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), entity)


def entity_order(entity: Column) -> Column:
    pairs = [F.lit(x) for pair in rules.ENTITY_ORDER.items() for x in pair]
    return F.element_at(F.create_map(*pairs), entity)


def finding(span: Column, entity: Column, code: str, order: int, detector: str = rules.RULES_DETECTOR) -> Column:
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        entity.alias("entity_type"),
        span["value"].alias("matched_text"),
        F.lit(detector).alias("detector"),
        F.lit(1.0).cast("float").alias("confidence"),
        F.lit(code).alias("explanation_code"),
        F.lit(True).alias("selected"),
        F.lit(False).alias("reviewed"),
        placeholder(entity).alias("replacement"),
        F.lit(order).alias("rule_ord"),
    )


def _as_findings(spans: Column, entity: str, code: str, order: int, detector: str = rules.RULES_DETECTOR) -> Column:
    return F.transform(spans, lambda s: finding(s, F.lit(entity), code, order, detector))


def rule_spans(text: Column, rule: Rule) -> Column:
    prefilter = scalars.has_any(text, rule.needs) if rule.needs else F.regexp_like(text, F.lit(rule.probe)) if rule.probe else None
    value, left, right = rule.java()
    return kernel.spans(text, value, left, right, prefilter)


def explicitly_public(text: Column, start: Column) -> Column:
    return scalars.has_any(scalars.before(text, start, 13), rules.PUBLIC_CUES)


def amount_label(around: Column) -> Column:
    found = F.lit(None).cast("string")
    for label, cues in reversed(rules.AMOUNT_LABELS):
        found = F.when(scalars.has_any(around, cues), label).otherwise(found)
    return found


def _labelled_amounts(text: Column, spans: Column, window, order: int, code: str, detector: str, keep=None) -> Column:
    found = F.transform(spans, lambda s: finding(s, amount_label(window(s)), code, order, detector))
    return F.filter(found, lambda f: f["entity_type"].isNotNull() & (keep(f) if keep else F.lit(True)))


def core_rule(text: Column, name: str) -> Column:
    """Findings of one of the product's rules, guards applied."""
    rule, order = CORE[name], list(CORE).index(name)
    spans = rule_spans(text, rule)
    around = lambda s: scalars.context(text, s["start"], s["end"])
    if name == "amount":
        return _labelled_amounts(text, spans, around, order, rule.code, rules.RULES_DETECTOR)
    keep = {
        "email": lambda s: ~explicitly_public(text, s["start"]),
        "cn_mobile": lambda s: ~explicitly_public(text, s["start"]),
        "cn_id": lambda s: scalars.valid_cn_id(s["value"]),
        "bank_card": lambda s: scalars.valid_luhn(s["value"]) & ~scalars.has_any(around(s), rules.NOT_A_CARD),
        "percent": lambda s: scalars.has_any(around(s), rules.PERCENT_CUES),
        "address": lambda s: scalars.has_any(s["value"], rules.ADDRESS_CUES),
    }.get(name)
    return _as_findings(F.filter(spans, keep) if keep else spans, rule.entity, rule.code, order)


def unlike(findings: Column, others: Column) -> Column:
    """findings whose span isn't the span of one of the others."""
    return F.filter(findings, lambda f: ~F.exists(others, lambda o: (o["start"] == f["start"]) & (o["end"] == f["end"])))


def ordered_of(findings: Column, key) -> Column:
    return F.array_sort(findings, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def first_of_each(findings: Column) -> Column:
    """Without later findings of the same span and entity, and without card numbers that are an identity number; by span.

    Sorted so that each finding follows those that rule it out, so a look at the one before decides.
    """
    place = lambda f: F.when(f["entity_type"] == "CN_ID_NUMBER", " ").when(f["entity_type"] == "BANK_CARD_NUMBER", "!").otherwise(f["entity_type"])
    key = lambda f: F.struct(f["start"], f["end"], place(f), f["rule_ord"])

    def clash(o: Column, f: Column) -> Column:
        other = (o["entity_type"] == "CN_ID_NUMBER") & (f["entity_type"] == "BANK_CARD_NUMBER")
        return (o["start"] == f["start"]) & (o["end"] == f["end"]) & ((o["entity_type"] == f["entity_type"]) | other)

    def firsts(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast(FINDING)), F.slice(ordered, 1, F.size(ordered) - 1))
        pairs = F.zip_with(ordered, before, lambda f, o: F.struct(f.alias("f"), F.coalesce(clash(o, f), F.lit(False)).alias("late")))
        return F.transform(F.filter(pairs, lambda p: ~p["late"]), lambda p: p["f"])

    return kernel.let(findings, lambda every: F.when(F.size(every) < 2, every).otherwise(kernel.let(ordered_of(every, key), firsts)))


def in_order(findings: Column) -> Column:
    """By start, end and rule."""
    key = lambda f: F.struct(f["start"], f["end"], f["rule_ord"])
    compare = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    return F.array_sort(findings, compare)


def fences(text: Column) -> Column:
    """Fenced ranges of a Markdown text: array of (open, close), an unclosed one to the end."""
    starts = kernel.spans(text, rf"(?U:[\s&&[^\n]]*)(?:```|~~~)[^\n]*(?:\n|\z)", r"(?:\A|(?<=\n))", prefilter=F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~")))
    pairs = F.filter(F.transform(starts, lambda s, i: F.struct(s["start"].alias("open"), F.coalesce(F.get(starts, i + 1)["end"], F.length(text)).alias("close"), i.alias("i"))), lambda r: r["i"] % 2 == 0)
    return F.transform(pairs, lambda r: F.struct(r["open"].alias("open"), r["close"].alias("close")))


def inside(f: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (f["start"] < r["close"]) & (r["open"] < f["end"]))


def with_fields(f: Column, **new: Column) -> Column:
    for name, value in new.items():
        f = f.withField(name, value)
    return f


def fenced(findings: Column, ranges: Column, scan_code: bool) -> Column:
    """Findings inside code are left out, or else only proposed for review."""
    if not scan_code:
        return F.filter(findings, lambda f: ~inside(f, ranges))
    held = lambda f: with_fields(
        f,
        selected=F.lit(False),
        confidence=F.least(f["confidence"], F.lit(0.75).cast("float")),
        explanation_code=F.concat(f["explanation_code"], F.lit("_MARKDOWN_CODE_REVIEW")),
    )
    return F.transform(findings, lambda f: F.when(inside(f, ranges), held(f)).otherwise(f))


def core_findings(text: Column, ranges: Column | None = None, scan_code: bool = True) -> Column:
    """All of the product's rules over a text, in order."""
    found = {name: core_rule(text, name) for name in CORE}
    every = first_of_each(F.concat(*found.values()))
    return in_order(fenced(every, ranges, scan_code) if ranges is not None else every)


def exact_findings(text: Column, terms: Sequence[tuple[str, str]], ranges: Column | None = None, scan_code: bool = True) -> Column:
    """Occurrences of (term, entity) pairs, each term by itself; at equal spans in the order of terms."""
    found = [_as_findings(kernel.literal_spans(text, term), entity, "USER_EXACT_TERM", i, rules.TERMS_DETECTOR) for i, (term, entity) in enumerate(terms)]
    every = first_of_each(F.concat(*found)) if found else none_found()
    return in_order(fenced(every, ranges, scan_code) if ranges is not None else every)


def _eval_base(text: Column) -> dict[str, Column]:
    plain = lambda s: F.regexp_replace(s["value"], "[ -]", "")
    keep = {"cn_id": lambda s: scalars.valid_cn_id(plain(s)), "bank_card": lambda s: scalars.valid_luhn(plain(s))}
    found = {}
    for i, (name, rule) in enumerate(BASELINE.items()):
        spans = rule_spans(text, rule)
        spans = F.filter(spans, keep[name]) if name in keep else spans
        found[name] = _as_findings(spans, rule.entity, rule.code, i, "rules-v1")
    return found


def by_label(findings: Column) -> Column:
    key = lambda f: F.struct(f["start"], f["end"], f["entity_type"])
    return F.array_sort(findings, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def baseline_findings(text: Column) -> Column:
    """The evaluation's format rules."""
    return by_label(F.concat(*_eval_base(text).values()))


def context_findings(text: Column) -> Column:
    """The evaluation's rules with context on both sides of a value."""
    around = lambda f, r: scalars.window(text, f["start"], f["end"], r, r)
    public = lambda f: scalars.has_any(around(f, 28), rules.PUBLIC_CUES)
    invalid = lambda f: scalars.has_any(around(f, 24), rules.INVALID_CUES)
    base = _eval_base(text)
    base["email"] = F.filter(base["email"], lambda f: ~public(f))
    base["cn_mobile"] = F.filter(base["cn_mobile"], lambda f: ~public(f))
    base["cn_id"] = F.filter(base["cn_id"], lambda f: scalars.valid_cn_id_date(f["matched_text"]) & ~invalid(f))
    base["bank_card"] = F.filter(base["bank_card"], lambda f: ~invalid(f))
    found = [F.transform(x, lambda f: with_fields(f, detector=F.lit("context-rules-v1"))) for x in base.values()]
    for i, (name, rule) in enumerate(CONTEXT.items(), len(BASELINE)):
        spans = rule_spans(text, rule)
        if name == "amount":
            found.append(_labelled_amounts(text, spans, lambda s: around(s, 32), i, rule.code, "context-rules-v1", lambda f: ~public(f)))
            continue
        if name == "percent":
            spans = F.filter(spans, lambda s: scalars.has_any(around(s, 28), rules.PERCENT_CUES))
        if name == "address":
            spans = F.filter(spans, lambda s: scalars.has_any(s["value"], rules.ADDRESS_CUES))
        found.append(_as_findings(spans, rule.entity, rule.code, i, "context-rules-v1"))
    return by_label(first_of_each(F.concat(*found)))


def exploded(parts: DataFrame, findings: str = "findings", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per finding, with its place in the array as finding_ord (from 0)."""
    return parts.select(*keys, F.posexplode(findings).alias("finding_ord", "f")).select(*keys, "finding_ord", "f.*")


def finding_ids(findings: DataFrame, prefix: str = "finding", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Numbers findings of a document by start and end, ties in the order of rules."""
    order = Window.partitionBy(*keys).orderBy("start", "end", "rule_ord")
    return findings.withColumn("finding_id", F.format_string(f"{prefix}-%04d", F.row_number().over(order)))


def detect_rules(parts: DataFrame, pack: str = "core", scan_code: bool = True, text: str = "text", kind: str | None = None) -> DataFrame:
    """parts with a column findings. kind names a column whose value 'markdown' marks texts with fenced code."""
    column = F.coalesce(F.col(text), F.lit(""))
    if pack == "core":
        ranges = F.when(F.col(kind) == "markdown", fences(column)).otherwise(F.array().cast("array<struct<open:int,close:int>>")) if kind else None
        found = core_findings(column, ranges, scan_code)
    else:
        found = {"baseline": baseline_findings, "context": context_findings}[pack](column)
    return settled(parts, "findings", found)
