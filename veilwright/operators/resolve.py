"""Conflicts between findings: which of overlapping ones stays. Order matters, so these are folds over one text's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import none_found
from .rules import TERMS_DETECTOR


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _sorted(findings: Column, *keys) -> Column:
    """Stable order by keys (ascending columns of a finding)."""
    placed = F.transform(findings, lambda f, i: F.struct(*[k(f).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(placed), lambda p: p["f"])


def merge_exact(findings: Column, exact: Column) -> Column:
    """Exact terms, longest first, push out what they overlap, but not each other."""

    def take(kept: Column, term: Column) -> Column:
        held = F.exists(kept, lambda o: (o["detector"] == TERMS_DETECTOR) & overlap(o, term))
        return F.when(held, kept).otherwise(F.array_append(F.filter(kept, lambda o: ~overlap(o, term)), term))

    return F.aggregate(_sorted(exact, lambda f: f["start"] - f["end"]), findings, take)


def merge_model(findings: Column, incoming: Column) -> Column:
    """A model's findings, surest first, then longest, where nothing is yet."""

    def take(kept: Column, f: Column) -> Column:
        return F.when(F.exists(kept, lambda o: overlap(o, f)), kept).otherwise(F.array_append(kept, f))

    return F.aggregate(_sorted(incoming, lambda f: -f["confidence"], lambda f: f["start"] - f["end"]), findings, take)


def merge_evaluation(rules: Column, model: Column) -> Column:
    """The evaluation's merge: customers push out organisations that no rule found; otherwise first come, first kept."""

    def take(kept: Column, f: Column) -> Column:
        weak = lambda o: overlap(f, o) & (o["entity_type"] == "ORG_NAME") & ~o["detector"].isin("rules-v1", "context-rules-v1")
        left = F.when(f["entity_type"] == "CUSTOMER_NAME", F.filter(kept, lambda o: ~weak(o))).otherwise(kept)
        return F.when(F.exists(left, lambda o: overlap(f, o)), left).otherwise(F.array_append(left, f))

    merged = F.aggregate(model, rules, take)
    key = lambda f: F.struct(f["start"], f["end"], f["entity_type"])
    return F.array_sort(merged, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def collected(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of findings as one array per part. Parts are paragraphs, cells or pages, so their findings are few."""
    names = [f for f in findings.columns if f not in keys]
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("findings"))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans of the same part that overlap: an equi join on keys with the range as a residual."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    return a.join(b, keys).where("l_start < r_end AND r_start < l_end")


def without_overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that overlap none of right."""
    other = right.select(*keys, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    condition = [left[k] == other[k] for k in keys] + [left["start"] < other["o_end"], other["o_start"] < left["end"]]
    return left.join(other, condition, "left_anti")


def same_span_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose exact span right doesn't have."""
    return left.join(right.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


def matched_greedily(gold: Column, predicted: Column) -> Column:
    """How many of gold get a predicted span of their label, each used once, both in order."""

    def step(state: Column, g: Column) -> Column:
        fits = lambda p, i: (p["label"] == g["label"]) & (p["start"] < g["end"]) & (g["start"] < p["end"]) & ~F.array_contains(state["used"], i)
        numbered = F.transform(predicted, lambda p, i: F.when(fits(p, i), i))
        first = F.get(F.filter(numbered, lambda i: i.isNotNull()), F.lit(0))
        used = F.when(first.isNotNull(), F.array_append(state["used"], first)).otherwise(state["used"])
        return F.struct(used.alias("used"))

    return F.aggregate(gold, F.struct(F.array().cast("array<int>").alias("used")), step, lambda s: F.size(s["used"]))


def empty_findings() -> Column:
    return none_found()
