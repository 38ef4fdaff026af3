import random
import re

import pytest
from pyspark.sql import functions as F

from veilwright.functions import kernel, scalars
from veilwright.operators import detect, redact
from veilwright.operators.policy import Policy, parse_policy, violations


def found(spark, text, pack="core", **options):
    parts = spark.createDataFrame([(1, text, options.pop("kind", "text"))], "doc_id long, text string, kind string")
    rows = detect.exploded(detect.detect_rules(parts, pack, kind="kind" if pack == "core" else None, **options)).collect()
    return [(r.start, r.end, r.entity_type, r.matched_text) for r in rows], rows


@pytest.mark.parametrize(
    "text, expected",
    [
        ("联系人邮箱case@example.com，手机13800000001；内部预算人民币12,000.00元。", {"EMAIL", "PHONE_NUMBER", "FINANCIAL_AMOUNT"}),
        ("私有邮箱：case@example.com；旧手机号：13900000002，当前公开版本。", {"EMAIL", "PHONE_NUMBER"}),
        ("银行卡号6222020000000001\n63。", {"BANK_CARD_NUMBER"}),
        ("", set()),
    ],
)
def test_core_rules(spark, text, expected):
    spans, _ = found(spark, text)
    assert {s[2] for s in spans} == expected
    assert all(text[s:e] == v for s, e, _, v in spans)


def test_consuming_guards_miss_the_second_value(spark):
    text = "13800000001,13900000002"
    assert [s[3] for s in found(spark, text)[0]] == ["13800000001"]
    assert [s[3] for s in found(spark, text, "baseline")[0]] == ["13800000001", "13900000002"]


def test_public_addresses_are_left_alone(spark):
    assert found(spark, "组织公共邮箱support@example.com用于售后服务。", "context")[0] == []


def test_fenced_code(spark):
    text = "a\n```\n手机13800000002\n```\n手机13800000001\n"
    spans, rows = found(spark, text, kind="markdown")
    assert [(r.selected, r.explanation_code.endswith("_MARKDOWN_CODE_REVIEW")) for r in rows] == [(False, True), (True, False)]
    assert [s[3] for s in found(spark, text, kind="markdown", scan_code=False)[0]] == ["13800000001"]


def test_kernel_agrees_with_finditer(spark):
    rng = random.Random(7)
    pieces = ["13800000001", "🙂", "，", "\n", "\r\n", "a@b.com", " ", "x", "12", "公开", "."]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(300)]
    for value, left, right in ((r"1[3-9]\d{9}", r"(?:\A|\D)", r"(?:\z|\D)"), (r"[a-z]+@[a-z.]+", "", "")):
        df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", kernel.spans(F.col("t"), value, left, right).alias("s"))
        got = {r.i: [(x.start, x.end, x.value) for x in r.s] for r in df.collect()}
        pattern = re.compile(f"{left}({value}){right}".replace(r"\z", r"\Z"), re.ASCII | re.S)
        assert got == {i: [(*m.span(1), m[1]) for m in pattern.finditer(t)] for i, t in enumerate(texts)}


def test_literal_terms_are_quoted(spark):
    for term in (".", "$", "\\", "[", "\\E", "a+"):
        df = spark.createDataFrame([(f"x{term}y{term}{term}",)], "t string")
        row = df.select(kernel.literal_spans(F.col("t"), term).alias("s"), redact.occurrences(F.col("t"), F.lit(term)).alias("o")).first()
        n = len(term)
        assert [x.start for x in row.s] == list(row.o) == [1, 2 + n, 2 + 2 * n]


def test_checksums(spark):
    df = spark.createDataFrame([("110105198003150020", "622202000000000163"), ("110105198003150021", "622202000000000164"), ("", "12")], "a string, b string")
    rows = df.select(scalars.valid_cn_id(F.col("a")), scalars.valid_luhn(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False)]


def verdict(spark, text, policy=Policy()):
    parts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return redact.redact_and_verify(parts, policy).first()


def test_redaction_passes_its_check(spark):
    row = verdict(spark, "手机：13800000001")
    assert (row.redacted, row.passed, row.residual_count) == ("手机：[手机号]", True, 0)


def test_a_sensitive_replacement_is_caught(spark):
    entities = Policy().entities | {"PHONE_NUMBER": type(Policy().entities["EMAIL"])(replacement="13900000002")}
    row = verdict(spark, "手机：13800000001", Policy(entities=entities))
    assert not row.passed and row.residual_count == 1


def test_overlapping_findings_are_an_error_row(spark):
    row = verdict(spark, "地址：上海市浦东新区13800000007号")
    assert row.error_code == "OVERLAPPING_FINDINGS" and row.redacted is None


def test_exact_terms_and_allowlist(spark):
    policy = Policy(exact_terms=(("星海计划", "PROJECT_CODE"),), allowlist=("case@example.com",))
    row = verdict(spark, "公开邮箱case@example.com，内部代号星海计划", policy)
    assert [f.matched_text for f in row.findings] == ["星海计划"] and row.redacted.endswith("[项目代号]")


def test_policy_files():
    text = Policy().to_json()
    assert parse_policy(text) == Policy() and violations(Policy()) == []
    with pytest.raises(ValueError, match="detectors"):
        parse_policy(text.replace('"detectors"', '"other"'))
    bad = Policy(schema_version=2, exact_terms=(("a", "EMAIL"), ("a", "EMAIL")), allowlist=("",))
    assert [c for c, _ in violations(bad)] == ["UNSUPPORTED_SCHEMA", "DUPLICATE_EXACT_TERM", "INVALID_ALLOWLIST_VALUE"]
