"""Inputs of the registered queries, as SQL that Spark and DuckDB both read, and the SQL of the rules in DuckDB.

Table names stand in braces: Spark gets Parquet paths for them, DuckDB its views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernel import spans_sql
from ..functions.scalars import ID_CHECKS, ID_WEIGHTS
from ..operators import rules
from ..operators.rules import CORE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def digit(number: str, place: int) -> str:
    return f"(cast(floor({number} / {10**place}) AS bigint) % 10)"


def card_sql(number: str) -> str:
    """A 16-digit card number from a number below 10**9: 622202, the number, its check digit."""
    total = []
    for i in range(15):
        d = str("622202"[i]) if i < 6 else digit(number, 14 - i)
        total.append(f"(CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END)" if i % 2 == 0 else d)
    return f"concat('622202', lpad(cast({number} AS string), 9, '0'), cast((10 - ({' + '.join(total)}) % 10) % 10 AS string))"


def cn_id_sql(number: str) -> str:
    """A resident number from a number below 1000."""
    body = "11010519900307"
    fixed = sum(int(d) * w for d, w in zip(body, ID_WEIGHTS, strict=False))
    total = f"({fixed} + {digit(number, 2)} * {ID_WEIGHTS[14]} + {digit(number, 1)} * {ID_WEIGHTS[15]} + {digit(number, 0)} * {ID_WEIGHTS[16]})"
    return f"concat('{body}', lpad(cast({number} AS string), 3, '0'), substring('{ID_CHECKS}', cast({total} % 11 AS int) + 1, 1))"


_K = "c_custkey"
_PHONE = f"concat('138', lpad(cast({_K} AS string), 8, '0'))"
_AMOUNT = f"concat('人民币', cast({_K} % 900 + 100 AS string), ',', lpad(cast({_K} * 7 % 1000 AS string), 3, '0'), '.00元')"
#: Phrases around synthetic values, hard negatives among them.
_CASES = (
    f"concat('联系人🙂手机：', {_PHONE}, '，私有邮箱：user', cast({_K} AS string), '@example.com；当前公开版本。')",
    f"concat('身份证', {cn_id_sql(f'{_K} % 1000')}, '，银行卡号', {card_sql(_K)}, '。')",
    f"concat('未公开预算草案', {_AMOUNT}, '，税前工资', {_AMOUNT}, '；毛利率', cast({_K} % 90 AS string), '.5%。')",
    f"concat('办公地址：北京市海淀区中关村路', cast({_K} AS string), '号，保密项目代号：星海计划', cast({_K} AS string), '。')",
    f"concat('项目蓝图-2026-A', cast({_K} AS string), '由团队负责；合同编号：HT-2026-', lpad(cast({_K} AS string), 5, '0'), '。')",
    f"concat('公开客服电话', {_PHONE}, '，官网公共邮箱support@example.com用于售后服务。')",
    f"concat('版本构建号', {card_sql(_K)}, '不是银行卡；底价', {_AMOUNT}, '，公开售价', {_AMOUNT}, '，增长12.5%。')",
    f"concat({_PHONE}, ',', {_PHONE}, chr(13), chr(10), '地址：上海市浦东新区', {_PHONE}, '号', chr(10), '公开', chr(10))",
)
ZH = f"SELECT cast({_K} AS bigint) + 1000000000 AS doc_id, CASE {_K} % {len(_CASES)} {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_CASES))} END AS text FROM {{customer}}"
PARTS = f"SELECT doc_id, text FROM {{documents}} UNION ALL ({ZH})"
#: Markdown: a fence around the second of three lines; every third one is not closed.
MARKDOWN = f"""SELECT doc_id, concat('手机13900000001', chr(10), '```', chr(10), text, chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('  ```', chr(10)) END, '合同编号：AB-', cast(doc_id AS string), chr(10)) AS text FROM ({ZH}) z"""
#: Spans: what two detectors say of the same text, from order lines.
SPANS = "SELECT l_orderkey AS doc_id, l_linenumber AS n, cast(l_partkey % 200 AS int) AS start, cast(l_partkey % 200 + 1 + l_suppkey % 40 AS int) AS stop, CASE l_suppkey % 3 WHEN 0 THEN 'ORG_NAME' WHEN 1 THEN 'PERSON_NAME' ELSE 'CUSTOMER_NAME' END AS label, cast(l_partkey % 11 / 10.0 AS float) AS confidence, l_returnflag AS side FROM {lineitem}"


#: Order lines, one for each order and number, with a text and a mode made from their keys.
LINES_OF = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    CASE WHEN l_partkey % 6 = 0 THEN 'run' ELSE concat('run-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-abcdefghij') END AS l_comment, concat('M', cast(l_suppkey % 3 AS string)) AS l_shipmode
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
        FROM {0} GROUP BY l_orderkey, l_linenumber) one)"""


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(sql.format(**names | {"lineitem": LINES_OF.format(names["lineitem"])}))


def duck(sql: str) -> str:
    """The same SQL for DuckDB."""
    return sql.format(**{t: t for t in TABLES} | {"lineitem": LINES_OF.format("lineitem")})


def window_sql(start: str, end: str, left: int, right: int, text: str = "text") -> str:
    return f"substr({text}, greatest({start} - {left}, 0) + 1, {end} + {right} - greatest({start} - {left}, 0))"


def has_any_sql(text: str, cues) -> str:
    return "(" + " OR ".join(f"contains({text}, '{c}')" for c in cues) + ")"


def valid_cn_id_sql(value: str) -> str:
    plain = f"regexp_replace({value}, '[^0-9Xx]', '', 'g')"
    total = " + ".join(f"CAST(substr({plain}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(ID_WEIGHTS))
    return f"(CASE WHEN regexp_full_match({plain}, '[0-9]{{17}}[0-9Xx]') THEN upper(substr({plain}, 18, 1)) = substr('{ID_CHECKS}', ({total}) % 11 + 1, 1) ELSE false END)"


def luhn_sum_sql(digits: str, parity: str) -> str:
    d = f"CAST(substr({digits}, i + 1, 1) AS INT)"
    return f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = {parity} THEN CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END ELSE {d} END))"


def valid_luhn_sql(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn_sum_sql(digits, f'(length({digits}) % 2)')} % 10 = 0 ELSE false END)"


def _rule_sql(name: str, source: str) -> str:
    rule, order = CORE[name], list(CORE).index(name)
    value, left, right = rule.re2()
    probe = f"WHERE {has_any_sql('text', rule.needs)}" if rule.needs else "WHERE regexp_matches(text, '(?:[0-9][ \\t\\r\\n-]?){10}[0-9]')" if rule.probe else ""
    spans = f"SELECT doc_id, text, unnest({spans_sql('text', value, left, right)}) AS x FROM {source} {probe}"
    around = window_sql("x.s", "x.e", 25, 24)
    label = f"'{rule.entity}'"
    keep = "true"
    if name in ("email", "cn_mobile"):
        keep = f"NOT {has_any_sql(window_sql('x.s', 'x.s', 13, 0), rules.PUBLIC_CUES)}"
    elif name == "cn_id":
        keep = valid_cn_id_sql("x.v")
    elif name == "bank_card":
        keep = f"{valid_luhn_sql('x.v')} AND NOT {has_any_sql(around, rules.NOT_A_CARD)}"
    elif name == "amount":
        label = "CASE " + " ".join(f"WHEN {has_any_sql(around, cues)} THEN '{entity}'" for entity, cues in rules.AMOUNT_LABELS) + " END"
        keep = f"{label} IS NOT NULL"
    elif name == "percent":
        keep = has_any_sql(around, rules.PERCENT_CUES)
    elif name == "address":
        keep = has_any_sql("x.v", rules.ADDRESS_CUES)
    return f"SELECT doc_id, x.s AS s, x.e AS e, {label} AS entity_type, x.v AS v, '{rule.code}' AS code, {order} AS rule_ord FROM ({spans}) WHERE {keep}"


def core_sql(source: str, names=tuple(CORE)) -> str:
    """Rows (doc_id, s, e, entity_type, v, code, rule_ord) of the product's rules over source (doc_id, text)."""
    every = " UNION ALL ".join(f"({_rule_sql(n, source)})" for n in names)
    return f"""SELECT doc_id, s, e, entity_type, v, code, rule_ord FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, entity_type ORDER BY rule_ord) AS first_one,
            count(*) FILTER (entity_type = 'CN_ID_NUMBER') OVER (PARTITION BY doc_id, s, e) AS ids
        FROM ({every})) WHERE first_one = 1 AND NOT (entity_type = 'BANK_CARD_NUMBER' AND ids > 0)"""


def placeholder_sql(entity: str) -> str:
    return f"CASE {entity} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PLACEHOLDERS.items()) + " END"


def order_sql(entity: str) -> str:
    return f"CASE {entity} " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in rules.ENTITY_ORDER.items()) + " END"
