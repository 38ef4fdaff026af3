"""Evaluation: predicted spans and recognised text against gold, as plain aggregations.

gold: id, text, difficulty, tags, entities (array of start, end, label, text); predictions: id, entities,
runtime_ms, structured_output_valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from . import resolve

ENTITY = "struct<start:int,end:int,label:string,text:string>"
CASE_SCHEMA = f"id string, split string, language string, text string, entities array<{ENTITY}>, tags array<string>, difficulty string, policy string"
PREDICTION_SCHEMA = "id string, entities array<struct<start:int,end:int,label:string,text:string,confidence:double,detector:string>>, runtime_ms double, structured_output_valid boolean, error string"
COUNTS = ("tp", "fp", "fn")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, anything else that isn't a case fails."""
    return spark.read.schema(CASE_SCHEMA).option("mode", "FAILFAST").json(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).option("mode", "FAILFAST").json(path)


def spans_of(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("id", *keep, F.explode("entities").alias("e")).select("id", *keep, "e.label", "e.start", "e.end")


def unknown_ids(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids of predictions that gold doesn't have: any is an error."""
    return predictions.select("id").exceptAll(gold.select("id")).distinct()


def joined(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold with its prediction; without one, no entities and missing = true."""
    p = predictions.select("id", F.col("entities").alias("predicted"), "runtime_ms", "structured_output_valid", F.lit(False).alias("missing"))
    none = F.array().cast(predictions.schema["entities"].dataType)
    return gold.join(p, "id", "left").withColumn("predicted", F.coalesce("predicted", none)).withColumn("missing", F.coalesce("missing", F.lit(True)))


def span_errors(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, code) of predicted spans that are out of bounds or whose text isn't the record's."""
    p = joined(gold, predictions).select("id", F.col("text").alias("record"), F.explode("predicted").alias("e"))
    bad = ~((F.col("e.start") >= 0) & (F.col("e.start") < F.col("e.end")) & (F.col("e.end") <= F.length("record")))
    code = F.when(bad, "SPAN_OUT_OF_BOUNDS").when(F.expr("substring(record, e.start + 1, e.end - e.start)") != F.col("e.text"), "TEXT_MISMATCH")
    return p.select("id", code.alias("code")).where("code IS NOT NULL")


def measures(counts: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and f1; 0 where a denominator is 0."""
    p, r = scalars.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scalars.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", scalars.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def exact_counts(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per id and label: spans that agree exactly, as multisets."""
    known = predictions.join(gold.select("id"), "id", "left_semi")
    g = spans_of(gold).withColumn("g", F.lit(1)).withColumn("p", F.lit(0))
    q = spans_of(known).withColumn("g", F.lit(0)).withColumn("p", F.lit(1))
    keyed = g.unionByName(q).groupBy("id", "label", "start", "end").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    both = F.least("g", "p")
    return keyed.groupBy("id", "label").agg(F.sum(both).alias("tp"), F.sum(F.col("p") - both).alias("fp"), F.sum(F.col("g") - both).alias("fn"))


def total(counts: DataFrame) -> DataFrame:
    return measures(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]))


def overlap_counts(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per id: gold spans that some predicted span of the label overlaps, one to one, in order."""
    both = joined(gold, predictions)
    tp = resolve.matched_greedily(F.col("entities"), F.col("predicted"))
    return both.select("id", tp.cast("long").alias("tp"), F.size("predicted").cast("long").alias("np"), F.size("entities").cast("long").alias("ng")).select("id", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def character_counts(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per id: labelled positions, as sets."""
    known = predictions.join(gold.select("id"), "id", "left_semi")
    positions = lambda d, n: spans_of(d).where("start < end").select("id", "label", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct().withColumn(n, F.lit(1))
    each = positions(gold, "g").join(positions(known, "p"), ["id", "label", "at"], "full")
    g, p = F.coalesce("g", F.lit(0)), F.coalesce("p", F.lit(0))
    return each.groupBy("id").agg(F.sum(g * p).alias("tp"), F.sum(p * (1 - g)).alias("fp"), F.sum(g * (1 - p)).alias("fn"))


def grouped(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(dimension, value) with exact counts: the total, by label, difficulty and tag, in one pass of grouping sets.
    A record counts once for each of its tags."""
    counts = exact_counts(gold, predictions)
    labels = counts.select(F.lit("label").alias("dimension"), F.col("label").alias("value"), *COUNTS)
    records = counts.groupBy("id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    group = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    groups = F.concat(F.array(group("micro", F.lit("all")), group("difficulty", F.col("difficulty"))), F.transform("tags", lambda t: group("tag", t)))
    about = gold.select("id", F.explode(groups).alias("d"))
    others = about.join(records, "id", "left").select("d.dimension", "d.value", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    return measures(labels.unionByName(others).groupBy("dimension", "value").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def percentile_by_index(values: Column) -> Column:
    """The value at place int(n * 0.95) of the sorted ones, the last at most."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * 0.95).cast("int")))


def runtimes(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Over present runtimes. The place of the 95th percentile is found by ranking, not by gathering values."""
    present = joined(gold, predictions).where("runtime_ms IS NOT NULL").select("runtime_ms")
    summary = present.agg(F.avg("runtime_ms").alias("mean_ms"), F.median("runtime_ms").alias("median_ms"), F.sum("runtime_ms").alias("total_ms"), F.count("*").alias("n"))
    counted = present.groupBy("runtime_ms").agg(F.count("*").alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(Window.orderBy("runtime_ms")))  # distinct values only
    at = upto.crossJoin(F.broadcast(summary.select("n"))).where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))
    return summary.crossJoin(at.agg(F.min("runtime_ms").alias("p95_ms"))).select("mean_ms", "median_ms", "p95_ms", "total_ms")


def rates(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Shares of the whole dataset: valid structured outputs and missing predictions."""
    both = joined(gold, predictions)
    valid = F.count_if(F.coalesce("structured_output_valid", F.lit(False)))
    return both.agg(F.count("*").alias("records"), F.count_if("missing").alias("missing_predictions"), scalars.ratio(valid, F.count("*")).alias("structured_output_valid_rate"))


def labels_histogram(gold: DataFrame) -> DataFrame:
    return spans_of(gold).groupBy("label").agg(F.count("*").alias("n"))


def dataset_errors(cases: DataFrame) -> DataFrame:
    """(id, code) of all that is wrong with evaluation cases; place orders records for duplicates (the later one is wrong)."""
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("place"))
    numbered = cases.withColumn("place", F.col("id")).withColumns({"id_no": by("id"), "text_no": by("text")})
    e = "entities"
    spans_ok = F.forall(e, lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text")))
    same = F.forall(e, lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) == x["text"])
    keys = F.transform(e, lambda x: F.struct(x["start"], x["end"]))
    codes = {
        "DUPLICATE_ID": F.col("id_no") > 1,
        "DUPLICATE_TEXT": F.col("text_no") > 1,
        "INVALID_SPLIT": ~F.col("split").isin("dev", "test"),
        "INVALID_DIFFICULTY": ~F.col("difficulty").isin("easy", "normal", "hard"),
        "INVALID_LANGUAGE": ~F.col("language").isin("zh-CN", "zh-TW", "mixed"),
        "EMPTY_TEXT": F.coalesce(F.length("text"), F.lit(0)) == 0,
        "INVALID_SPAN": ~spans_ok,
        "TEXT_MISMATCH": spans_ok & ~same,
        "UNSORTED_ENTITIES": keys != F.array_sort(keys),
    }
    found = F.array_compact(F.array(*[F.when(wrong, code) for code, wrong in codes.items()]))
    return numbered.select("id", F.explode(found).alias("code"))


def score_ocr(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per style and in all (style null): accuracy of signs, exact recall and coverage of sensitive regions, recall of lines.

    manifest: id, style, text, line_regions, sensitive_regions (arrays of struct text, bbox); predictions: id,
    recognized_text, boxes (array of bbox structs).
    """
    p = predictions.select("id", scalars.without_space(F.col("recognized_text")).alias("recognized"), "boxes")
    none = F.array().cast(predictions.schema["boxes"].dataType)
    both = manifest.join(p, "id", "left").withColumns({"recognized": F.coalesce("recognized", F.lit("")), "boxes": F.coalesce("boxes", none), "expected": scalars.without_space(F.col("text"))})

    def hit(region: Column, measure, least: float) -> Column:
        return F.exists("boxes", lambda b: measure(region["bbox"], b) >= least)

    value = lambda r: scalars.without_space(r["text"])
    exact = lambda r: (value(r) != "") & F.contains(F.col("recognized"), value(r))
    rows = both.select(
        "style",
        F.length("expected").alias("chars"),
        F.levenshtein("expected", "recognized").alias("distance"),
        F.size("sensitive_regions").alias("sensitive"),
        F.size(F.filter("sensitive_regions", exact)).alias("sensitive_exact"),
        F.size(F.filter("sensitive_regions", lambda r: hit(r, geometry.covered_fraction, 0.8))).alias("sensitive_covered"),
        F.size("line_regions").alias("lines"),
        F.size(F.filter("line_regions", lambda r: hit(r, geometry.intersection_over_union, 0.5))).alias("lines_detected"),
    )
    s = rows.rollup("style").agg(F.count("*").alias("records"), *[F.sum(c).cast("long").alias(c) for c in rows.columns if c != "style"])
    accuracy = F.when(F.col("chars") > 0, 1 - scalars.ratio(F.col("distance"), F.col("chars"))).otherwise(F.lit(0.0))
    return s.select(
        "style",
        "records",
        accuracy.alias("character_accuracy"),
        scalars.ratio(F.col("sensitive_exact"), F.col("sensitive")).alias("sensitive_exact_recall"),
        scalars.ratio(F.col("sensitive_covered"), F.col("sensitive")).alias("sensitive_coverage_recall"),
        scalars.ratio(F.col("lines_detected"), F.col("lines")).alias("line_recall"),
    )


def report_markdown(metrics: DataFrame) -> DataFrame:
    """One line of Markdown per row of grouped(): place and line."""
    head = metrics.sparkSession.createDataFrame([(0, "| dimension | value | precision | recall | F1 |"), (1, "| --- | --- | ---: | ---: | ---: |")], "place int, line string")
    order = Window.orderBy("dimension", "value")  # a report has few lines
    cells = F.concat_ws(" | ", "dimension", "value", *[scalars.percent_text(F.col(c)) for c in ("precision", "recall", "f1")])
    return head.unionByName(metrics.select((F.row_number().over(order) + 1).alias("place"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))
