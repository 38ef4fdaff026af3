"""Model detectors as plug-ins: a function over batches of texts whose answers are checked before they count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import scalars
from .detect import FINDING, finding, placeholder
from .rules import CUSTOMER_CUES, PLACEHOLDERS

ANSWER = "struct<protocol_version:int,request_id:string,findings:array<struct<start:int,end:int,entity_type:string,matched_text:string,confidence:float,reason_code:string>>,warnings:array<string>>"
PROTOCOL = 1
#: Warnings that say a model's confidence isn't calibrated.
UNCALIBRATED = ("SIAMESE_UIE_CONFIDENCE_IS_NOT_CALIBRATED", "QWEN_CONFIDENCE_IS_NOT_CALIBRATED")


def dictionary_model(terms: dict[str, str], confidence: float = 0.85) -> Callable[[str], list[dict]]:
    """A stand-in for a model: the first place of each term it knows."""

    def answer(text: str) -> list[dict]:
        found = [(text.find(t), t, e) for t, e in terms.items() if t in text]
        return [{"start": s, "end": s + len(t), "entity_type": e, "matched_text": t, "confidence": confidence, "reason_code": "DICTIONARY"} for s, t, e in sorted(found)]

    return answer


def ask(parts: DataFrame, detector: str, load: Callable[[], Callable[[str], list[dict]]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """parts with a column answer. load runs once per worker and returns the model; texts come in Arrow batches."""

    @pandas_udf(ANSWER)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for ids, texts in batches:
            rows = []
            for number, value in zip(ids, texts, strict=True):
                try:
                    rows.append((PROTOCOL, f"{number}-{detector}", model(value or ""), []))
                except Exception as e:  # a model that fails is a diagnostic of this text, not of the job
                    rows.append((PROTOCOL, f"{number}-{detector}", [{"start": -1, "end": -1, "entity_type": "ORG_NAME", "matched_text": "", "confidence": float("nan"), "reason_code": type(e).__name__}], []))
            yield pd.DataFrame(rows, columns=["protocol_version", "request_id", "findings", "warnings"])

    return parts.withColumn("answer", run(F.col(key).cast("string"), F.col(text)))


def answer_error(text: Column, request_id: Column, answer: Column) -> Column:
    """Null, or the first reason to reject an answer as a whole."""

    def wrong(f: Column) -> Column:
        bad = F.isnan(f["confidence"]) | ~f["confidence"].between(0.0, 1.0)
        span = (f["start"] < 0) | (f["start"] >= f["end"]) | (f["end"] > F.length(text))
        return F.when(F.coalesce(bad, F.lit(True)), "INVALID_CONFIDENCE").when(F.coalesce(span, F.lit(True)), "INVALID_SPAN").when(F.substring(text, f["start"] + 1, f["end"] - f["start"]) != f["matched_text"], "TEXT_MISMATCH")

    first = F.get(F.filter(F.transform(answer["findings"], wrong), lambda x: x.isNotNull()), F.lit(0))
    return F.when(answer["protocol_version"] != PROTOCOL, "PROTOCOL_MISMATCH").when(answer["request_id"] != request_id, "REQUEST_MISMATCH").otherwise(first)


def answer_findings(answer: Column, detector: str, least: float) -> Column:
    """An accepted answer as findings, those less sure than least left out."""
    sure = F.filter(answer["findings"], lambda f: f["confidence"] >= F.lit(least).cast("float"))

    def build(f: Column) -> Column:
        base = finding(F.struct(f["start"].alias("start"), f["end"].alias("end"), f["matched_text"].alias("value")), f["entity_type"], "", 1000, detector)
        return base.withField("confidence", f["confidence"]).withField("explanation_code", f["reason_code"]).withField("replacement", placeholder(f["entity_type"]))

    return F.transform(sure, build)


def model_findings(asked: DataFrame, detector: str, least: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """asked (from ask) with findings of the model and diagnostic (a code or null); a rejected answer gives no findings."""
    error = answer_error(F.col(text), F.concat(F.col(key).cast("string"), F.lit(f"-{detector}")), F.col("answer"))
    found = F.when(error.isNull(), answer_findings(F.col("answer"), detector, least)).otherwise(F.array().cast(f"array<{FINDING}>"))
    return asked.withColumn("model_error", error).withColumn("model_findings", found).withColumn("diagnostic", F.when(F.col("model_error").isNotNull(), "MODEL_RUNTIME_FAILED"))


def warning_code(warning: Column) -> Column:
    return F.when(warning.isin(*UNCALIBRATED), "MODEL_CONFIDENCE_UNCALIBRATED").otherwise("MODEL_RUNTIME_WARNING")


def warning_diagnostics(warnings: DataFrame, most: int = 16) -> DataFrame:
    """warnings (doc_id, detector_id, place, warning): coded, without their text, the first most of each answer."""
    return warnings.where(F.col("place") < most).select("doc_id", "detector_id", F.lit("warning").alias("severity"), warning_code(F.col("warning")).alias("code")).distinct()


def aligned_values(texts: DataFrame, values: DataFrame, confidence: float = 0.80) -> DataFrame:
    """Values that a model named without places (doc_id, value, entity_type): every exact occurrence; others are dropped."""
    from .redact import occurrences

    known = values.where(F.col("entity_type").isin(*PLACEHOLDERS) & (F.length("value") > 0)).distinct()
    both = known.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("value")))
    at = both.select("doc_id", "entity_type", "value", F.explode(occurrences(F.col("text"), F.col("value"))).alias("start"))
    return at.select("doc_id", "start", (F.col("start") + F.length("value")).alias("end"), "entity_type", F.col("value").alias("matched_text"), F.lit(confidence).cast("float").alias("confidence"))


def relabelled(entity: Column, text: Column) -> Column:
    """Organisations of a text that speaks of customers are customers."""
    return F.when((entity == "ORG_NAME") & scalars.has_any(text, CUSTOMER_CUES), "CUSTOMER_NAME").otherwise(entity)


def token_windows(tokens: DataFrame, size: int = 384, step: int = 352) -> DataFrame:
    """tokens (doc_id, place, token): rows (doc_id, window, place, token) of overlapping windows that cover all places."""
    n = tokens.groupBy("doc_id").agg((F.max("place") + 1).alias("n"))
    last = F.greatest(F.ceil((F.col("n") - size) / F.lit(step)), F.lit(0)).cast("int")
    both = tokens.join(n, "doc_id").withColumn("last", last)
    low = F.greatest(F.ceil((F.col("place") - size + 1) / F.lit(step)), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("place") / F.lit(step)).cast("int"), F.col("last"))
    return both.select("doc_id", F.explode(F.sequence(low, high)).alias("window"), "place", "token")


def merged_logits(logits: DataFrame) -> DataFrame:
    """logits (doc_id, window, place, value): one value per place, the mean of what came before and each next window in turn."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("window", "value"))), lambda x: x["value"])
    folded = F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), F.get(ordered, F.lit(0)), lambda s, v: (s + v) / 2)
    return logits.groupBy("doc_id", "place").agg(folded.alias("value"))  # a place is in few windows


def decoded_spans(heads: DataFrame, least: float = 0.5) -> DataFrame:
    """heads (doc_id, place, head, tail) probabilities: from each head above least to the first tail at or after it."""
    from pyspark.sql import Window

    later = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tail = F.first(F.when(F.col("tail") > least, F.col("place")), ignorenulls=True).over(later)
    return heads.withColumn("until", tail).where((F.col("head") > least) & F.col("until").isNotNull()).select("doc_id", F.col("place").alias("start"), (F.col("until") + 1).alias("end"))


def first_json_object(text: str | None) -> str | None:
    """The first balanced object of a model's output; braces inside strings don't count."""
    start = depth = 0
    quoted = escaped = False
    for i, c in enumerate(text or ""):
        if not depth:
            if c == "{":
                start, depth, quoted = i, 1, False
            continue
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted, escaped = True, False
        else:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[start : i + 1]
    return None


@pandas_udf(StringType())
def json_object(outputs: pd.Series) -> pd.Series:
    return outputs.map(first_json_object)
