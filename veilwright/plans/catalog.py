"""Registered queries: each operator over whole driver tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, kernel, scalars
from ..operators import detect, models, ocr, policy, redact, resolve, rules, scoring
from ..operators.policy import Policy
from ..sources import files
from . import inputs
from .inputs import LINES_OF, MARKDOWN, PARTS, SPANS, ZH, core_sql, duck, order_sql, placeholder_sql, spark_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = re.sub(r"\b(FROM|JOIN) lineitem\b(?! GROUP BY l_orderkey, l_linenumber)", lambda m: f"{m[1]} {LINES_OF.format('lineitem')}", oracle)
        return f

    return register


def parts(spark: SparkSession, sf_dir: str, sql: str = PARTS) -> DataFrame:
    return spark_table(spark, sf_dir, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "lineitem":
        return spark_table(spark, sf_dir, "SELECT * FROM {lineitem}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(sql: str, source: str = PARTS, name: str = "p") -> str:
    return f"WITH {name} AS ({duck(source)}) {sql}"


FOUND = ("doc_id", "start", "end", "entity_type", "matched_text", "explanation_code")
_FOUND_SQL = 'doc_id, s AS start, e AS "end", entity_type, v AS matched_text, code AS explanation_code'


# Detectors


def _detector(key: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.settled(parts(spark, sf_dir), "findings", detect.core_rule(F.col("text"), name))
        return detect.exploded(found).select(*FOUND)

    run.__name__ = key
    run.__doc__ = f"Findings of the rule {name}, before rules meet."
    query(_with(f"SELECT {_FOUND_SQL} FROM ({inputs._rule_sql(name, 'p')})"))(run)


for _key, _name in (
    ("d01_email", "email"),
    ("d02_cn_mobile", "cn_mobile"),
    ("d03_cn_id", "cn_id"),
    ("d04_bank_card", "bank_card"),
    ("d05_contextual_amount", "amount"),
    ("d06_contextual_percent", "percent"),
    ("d07_address_field", "address"),
    ("d08_project_code_field", "project_field"),
    ("d09_project_code_inline", "project_inline"),
    ("d10_contract_id", "contract"),
):
    _detector(_key, _name)

#: Terms for exact matching: words of all languages of the documents, and some of the synthetic texts.
TERMS = (("星海计划", "PROJECT_CODE"), ("海淀区", "ADDRESS"), ("the", "ORG_NAME"), ("example.com", "CUSTOMER_NAME"), (".00", "BUSINESS_METRIC"))


def _terms_sql(source: str = "p") -> str:
    from ..functions.kernel import spans_sql

    rows = []
    for i, (term, entity) in enumerate(TERMS):
        pattern = term.replace(".", "\\.")
        rows.append(f"SELECT doc_id, unnest({spans_sql('text', pattern)}) AS x, '{entity}' AS entity_type, {i} AS rule_ord FROM {source} WHERE contains(text, '{term}')")
    return f"SELECT doc_id, x.s AS s, x.e AS e, entity_type, x.v AS v, 'USER_EXACT_TERM' AS code, rule_ord FROM ({' UNION ALL '.join(rows)})"


@query(_with(f"SELECT {_FOUND_SQL} FROM ({_terms_sql()})"))
def d11_exact_terms(spark, sf_dir):
    found = detect.settled(parts(spark, sf_dir), "findings", detect.exact_findings(F.col("text"), TERMS))
    return detect.exploded(found).select(*FOUND)


@query(_with(f"SELECT {_FOUND_SQL}, rule_ord FROM ({core_sql('p')})"))
def d12_core_findings(spark, sf_dir):
    """All rules together: later findings of a span and entity go, and cards that are resident numbers."""
    return detect.exploded(detect.detect_rules(parts(spark, sf_dir))).select(*FOUND, "rule_ord")


_FENCES = """SELECT doc_id, text, list_transform(range(0, (len(m) + 1) // 2), lambda i: struct_pack(o := m[2 * i + 1].s, c := CASE WHEN len(m) >= 2 * i + 2 THEN m[2 * i + 2].e ELSE length(text) END)) AS ranges
    FROM (SELECT doc_id, text, list_filter(list_transform(range(1, len(lines) + 1), lambda i: struct_pack(s := coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0)::INT,
        e := least(coalesce(list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)), 0), length(text))::INT, v := regexp_matches(lines[i], '^\\s*(```|~~~)'))), lambda x: x.v) AS m
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM p))"""


@query(_with(f"""SELECT doc_id, s AS start, e AS "end", entity_type, CASE WHEN inside THEN code || '_MARKDOWN_CODE_REVIEW' ELSE code END AS explanation_code, NOT inside AS selected
    FROM (SELECT c.*, len(list_filter(f.ranges, lambda r: c.s < r.c AND r.o < c.e)) > 0 AS inside FROM ({core_sql('p')}) c JOIN ({_FENCES}) f USING (doc_id))""", MARKDOWN))
def d13_markdown_fences(spark, sf_dir):
    found = detect.detect_rules(parts(spark, sf_dir, MARKDOWN).withColumn("kind", F.lit("markdown")), kind="kind")
    return detect.exploded(found).select("doc_id", "start", "end", "entity_type", "explanation_code", "selected")


@query(_with(f"""SELECT doc_id, printf('finding-%04d', row_number() OVER (PARTITION BY doc_id ORDER BY s, e, rule_ord)) AS finding_id, s AS start, e AS "end", entity_type FROM ({core_sql('p')})"""))
def d14_finding_ids(spark, sf_dir):
    return detect.finding_ids(detect.exploded(detect.detect_rules(parts(spark, sf_dir)))).select("doc_id", "finding_id", "start", "end", "entity_type")


@query(_with(f"""SELECT doc_id, strpos(text, t.term)::INT - 1 AS start, strpos(text, t.term)::INT - 1 + length(t.term)::INT AS "end", CASE WHEN t.entity = 'ORG_NAME' AND {inputs.has_any_sql("text", rules.CUSTOMER_CUES)} THEN 'CUSTOMER_NAME' ELSE t.entity END AS entity_type,
    t.term AS matched_text, 0.85::FLOAT::DOUBLE AS confidence FROM p, (VALUES ('海淀区', 'ADDRESS'), ('团队', 'ORG_NAME'), ('星海计划', 'PROJECT_CODE')) AS t(term, entity) WHERE contains(text, t.term)""", ZH))
def d15_dictionary_model(spark, sf_dir):
    """A model's whole path: asked in Arrow batches, its answers checked, organisations of customers' texts relabelled."""
    known = {"海淀区": "ADDRESS", "团队": "ORG_NAME", "星海计划": "PROJECT_CODE"}
    asked = models.ask(parts(spark, sf_dir, ZH), "siamese_uie", lambda: models.dictionary_model(known))
    found = models.model_findings(asked, "siamese_uie", 0.65)
    rows = detect.exploded(found, "model_findings", ("doc_id", "text"))
    return rows.select("doc_id", "start", "end", models.relabelled(F.col("entity_type"), F.col("text")).alias("entity_type"), "matched_text", F.col("confidence").cast("double").alias("confidence"))


@query(_with("""SELECT doc_id, CASE WHEN label = 'ORG_NAME' AND (contains(text, '重点客户') OR contains(text, '客户名单') OR contains(text, '客户名称') OR contains(text, '客户：') OR contains(text, '客户:')) THEN 'CUSTOMER_NAME' ELSE label END AS entity_type
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('客户：', text) ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'ORG_NAME' ELSE 'PERSON_NAME' END AS label FROM p)"""))
def d15_customer_relabel(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("客户："), "text")).otherwise(F.col("text")))
    label = F.when(F.col("doc_id") % 3 == 0, "ORG_NAME").otherwise("PERSON_NAME")
    return p.select("doc_id", models.relabelled(label, F.col("text")).alias("entity_type"))


@query(_with(f"""SELECT doc_id, x.s AS start, x.e AS "end", 'PROJECT_CODE' AS entity_type, x.v AS matched_text FROM (SELECT doc_id, unnest({kernel.spans_sql('text', '人民币')}) AS x FROM p WHERE contains(text, '人民币'))""", ZH))
def d16_aligned_values(spark, sf_dir):
    p = parts(spark, sf_dir, ZH)
    values = p.select("doc_id", F.explode(F.array(F.lit("人民币"), F.lit("absent"))).alias("value"), F.lit("PROJECT_CODE").alias("entity_type"))
    return models.aligned_values(p, values).select("doc_id", "start", "end", "entity_type", "matched_text")


_TOKENS = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place, l_partkey AS token FROM {lineitem}"


@query(_with("""SELECT t.doc_id, w AS "window", place, token FROM p t JOIN (SELECT doc_id, unnest(range(0, greatest(ceil((max(place) + 1 - 4) / 2.0)::BIGINT, 0) + 1)) AS w FROM p GROUP BY doc_id) x ON t.doc_id = x.doc_id AND place >= w * 2 AND place < w * 2 + 4""", _TOKENS))
def d17_token_windows(spark, sf_dir):
    t = spark_table(spark, sf_dir, _TOKENS).withColumn("place", F.col("place").cast("int"))
    return models.token_windows(t, 4, 2)


@query(_with("""SELECT doc_id, place, list_reduce(list(v ORDER BY w), lambda a, b: (a + b) / 2) AS value FROM (SELECT l_orderkey % 1000 AS doc_id, l_linenumber AS place, l_orderkey AS w, l_quantity AS v FROM p) GROUP BY doc_id, place""", "SELECT * FROM {lineitem}"))
def d17_merged_logits(spark, sf_dir):
    """Logits of all order lines, merged over windows."""
    l = table(spark, sf_dir, "lineitem")
    return models.merged_logits(l.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("window"), F.col("l_quantity").alias("value")))


_HEADS = "SELECT l_orderkey AS doc_id, l_linenumber AS place, l_partkey % 10 / 8.0 AS head, l_suppkey % 10 / 10.0 AS tail FROM {lineitem}"


@query(_with("""SELECT doc_id, place AS start, until + 1 AS "end" FROM (SELECT *, min(CASE WHEN tail > 0.5 THEN place END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS until FROM p) WHERE head > 0.5 AND until IS NOT NULL""", _HEADS))
def d17_decoded_spans(spark, sf_dir):
    return models.decoded_spans(spark_table(spark, sf_dir, _HEADS))


def _pack_query(key: str, pack: str, oracle: str | None = None):
    def run(spark, sf_dir):
        found = detect.detect_rules(parts(spark, sf_dir), pack)
        return detect.exploded(found).select("doc_id", "start", "end", F.col("entity_type").alias("label"), F.col("matched_text").alias("text"), "detector")

    run.__name__ = key
    query(oracle)(run)


_pack_query("d18_baseline_rules", "baseline")
_pack_query("d19_context_rules", "context")


# Sources


@query("SELECT doc_id, 'stdin://clipboard' AS path, sha256(text) AS sha256, 'task-' || substr(sha256(text), 1, 12) AS task_id, strlen(text) AS size_bytes, 'clipboard' AS file_kind, length(text)::INT AS char_len FROM documents")
def s02_documents_from_text(spark, sf_dir):
    found = files.documents_from_text(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "path", "sha256", "task_id", "size_bytes", "file_kind", "char_len")


_ENDINGS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) WHEN 1 THEN replace(text, chr(10), chr(13)) WHEN 2 THEN concat(text, chr(13), chr(10), 'x', chr(10)) ELSE text END AS text FROM {documents}"


@query(_with("""SELECT doc_id, CASE WHEN k = 0 THEN 'none' WHEN k > 1 THEN 'mixed' WHEN p > 0 THEN 'cr_lf' WHEN lf > 0 THEN 'lf' ELSE 'cr' END AS line_ending
    FROM (SELECT doc_id, p, lf, (p > 0)::INT + (lf > 0)::INT + (cr > 0)::INT AS k FROM (SELECT doc_id, len(string_split(text, chr(13) || chr(10))) - 1 AS p, len(string_split(r, chr(10))) - 1 AS lf, len(string_split(r, chr(13))) - 1 AS cr FROM (SELECT *, replace(text, chr(13) || chr(10), '') AS r FROM p)))""", _ENDINGS))
def s03_line_ending(spark, sf_dir):
    return parts(spark, sf_dir, _ENDINGS).select("doc_id", scalars.line_ending(F.col("text")).alias("line_ending"))


@query("SELECT page_id, sha256(html) AS sha256, 'task-' || substr(sha256(html), 1, 12) AS task_id FROM pages")
def s04_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.sha256_hex(F.col("html")).alias("sha256"), scalars.task_id(F.col("html")).alias("task_id"))


@query("SELECT doc_id, strlen(text) AS size_bytes FROM documents WHERE strlen(text) <= 2097152")
def s05_within_stdin_limit(spark, sf_dir):
    return files.within_stdin_limit(table(spark, sf_dir, "documents")).select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"))


_ENTRIES = """SELECT l_orderkey AS doc_id, CASE l_orderkey % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'pptx' END AS format, l_linenumber AS entry_no, cast(40000000 AS bigint) + l_orderkey % 100 * 1000000 AS package_bytes,
    CASE l_linenumber WHEN 1 THEN '[Content_Types].xml' WHEN 2 THEN '_rels/.rels' WHEN 3 THEN CASE l_orderkey % 3 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'xl/workbook.xml' ELSE 'ppt/presentation.xml' END
        WHEN 4 THEN CASE l_partkey % 4 WHEN 0 THEN 'word/media/image1.PNG' WHEN 1 THEN 'xl/charts/chart1.xml' WHEN 2 THEN 'ppt/embeddings/ole.bin' ELSE 'word/vbaProject.bin' END
        WHEN 5 THEN CASE l_partkey % 9 WHEN 0 THEN '../evil.xml' WHEN 1 THEN '_rels/.rels' ELSE concat('ppt/media/video', cast(l_partkey AS string), '.gif') END ELSE concat('custom/item', cast(l_linenumber AS string), '.xml') END AS name,
    cast(l_partkey * 60011 AS bigint) AS size, cast(l_partkey * 23 AS bigint) AS compressed_size, CASE WHEN l_partkey % 50 = 0 THEN 12 ELSE 8 END AS method, l_suppkey % 60 = 0 AS encrypted, false AS is_dir FROM {lineitem}"""


@query(_with("""SELECT doc_id, format, entries, total_size, largest, CASE WHEN bytes > 104857600 THEN 'PACKAGE_TOO_LARGE' WHEN unsafe OR names < entries THEN 'UNSAFE_ENTRY_NAME' WHEN encrypted THEN 'ENCRYPTED_ENTRY' WHEN method THEN 'UNSUPPORTED_COMPRESSION'
      WHEN large THEN 'ENTRY_TOO_LARGE' WHEN total_size > 524288000 THEN 'PACKAGE_TOO_LARGE' WHEN bomb THEN 'SUSPICIOUS_COMPRESSION' WHEN required < 3 THEN 'MISSING_REQUIRED_ENTRY' END AS error_code
    FROM (SELECT doc_id, format, max(package_bytes) AS bytes, count(*) AS entries, count(DISTINCT name) AS names, sum(size)::BIGINT AS total_size, max(size) AS largest, bool_or(starts_with(name, '../')) AS unsafe, bool_or(encrypted) AS encrypted,
      bool_or(method NOT IN (0, 8)) AS method, bool_or(size > 104857600 OR (name LIKE '%.xml' AND size > 20971520)) AS large, bool_or(size > 10485760 AND size > compressed_size * 1000) AS bomb,
      count(*) FILTER (name IN ('[Content_Types].xml', '_rels/.rels') OR name = CASE format WHEN 'docx' THEN 'word/document.xml' WHEN 'xlsx' THEN 'xl/workbook.xml' ELSE 'ppt/presentation.xml' END) AS required FROM p GROUP BY doc_id, format)""", _ENTRIES))
def s13_package_preflight(spark, sf_dir):
    from ..sources import packages

    return packages.preflight(spark_table(spark, sf_dir, _ENTRIES))


@query(_with("""SELECT doc_id, entry_no, CASE WHEN regexp_full_match(n, '.*vbaproject\\.bin|' || r || '/(activex|ctrlprops)/.*') THEN 'active' WHEN u THEN 'unsupported' WHEN m AND regexp_matches(n, '\\.(png|jpg|jpeg)$') THEN 'image' WHEN m THEN 'unsupported_image' END AS payload
    FROM (SELECT *, starts_with(name, r || '/media/') AS m, CASE format WHEN 'docx' THEN n LIKE 'word/embeddings/%' WHEN 'xlsx' THEN n LIKE 'xl/embeddings/%' OR n LIKE 'xl/charts/%' ELSE n LIKE 'ppt/embeddings/%' OR n LIKE 'ppt/charts/%' END AS u
      FROM (SELECT *, lower(name) AS n, CASE format WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'xl' ELSE 'ppt' END AS r FROM p))""", _ENTRIES))
def s14_payload_classes(spark, sf_dir):
    from ..sources import packages

    return packages.classified(spark_table(spark, sf_dir, _ENTRIES)).select("doc_id", "entry_no", "payload")


_IMPORTS = "SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, concat('/in/f', cast(o_custkey % 120 AS string), CASE o_orderkey % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' WHEN 2 THEN '.md' WHEN 3 THEN '.exe' WHEN 4 THEN '.png' ELSE '.pdf' END) AS path, cast(o_orderkey * 90001 % 110000000 AS bigint) AS size_bytes FROM {orders}"


@query(_with("""SELECT seq, path, kind, size_bytes, duplicate, CASE WHEN duplicate THEN 'ALREADY_IMPORTED' WHEN kind = 'unknown' THEN 'UNSUPPORTED_EXTENSION' WHEN size_bytes > lim THEN 'FILE_TOO_LARGE' ELSE 'READY' END AS reason_code, (NOT duplicate AND kind <> 'unknown' AND size_bytes <= lim) AS ready
    FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) > 1 AS duplicate, CASE x WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'docx' THEN 'word' WHEN 'png' THEN 'image' WHEN 'pdf' THEN 'pdf' ELSE 'unknown' END AS kind, CASE x WHEN 'txt' THEN 2 WHEN 'md' THEN 2 WHEN 'png' THEN 50 ELSE 100 END * 1048576 AS lim FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM p WHERE seq <= 200))""", _IMPORTS))
def s18_registered_files(spark, sf_dir):
    return files.registered(spark_table(spark, sf_dir, _IMPORTS))


# Scalar functions


_NUMBERS = f"SELECT c_custkey AS k, {inputs.cn_id_sql('c_custkey % 1000')} AS cn_id, {inputs.card_sql('c_custkey')} AS card, concat('1101051990', lpad(cast(c_custkey % 20 AS string), 2, '0'), lpad(cast(c_custkey % 40 AS string), 2, '0'), '0010') AS dated FROM {{customer}}"


@query(_with(f"SELECT k, {inputs.valid_cn_id_sql('cn_id')} AS right_one, {inputs.valid_cn_id_sql('dated')} AS other, {inputs.valid_cn_id_sql('card')} AS card FROM p", _NUMBERS))
def f01_valid_cn_id(spark, sf_dir):
    t = spark_table(spark, sf_dir, _NUMBERS)
    return t.select("k", scalars.valid_cn_id(F.col("cn_id")).alias("right_one"), scalars.valid_cn_id(F.col("dated")).alias("other"), scalars.valid_cn_id(F.col("card")).alias("card"))


@query(_with(f"SELECT k, {inputs.valid_luhn_sql('card')} AS card, {inputs.valid_luhn_sql('cn_id')} AS cn_id, {inputs.valid_luhn_sql('dated')} AS dated FROM p", _NUMBERS))
def f02_valid_luhn(spark, sf_dir):
    t = spark_table(spark, sf_dir, _NUMBERS)
    return t.select("k", *[scalars.valid_luhn(F.col(c)).alias(c) for c in ("card", "cn_id", "dated")])


@query(_with("SELECT k, substr(card, 16, 1) AS luhn, substr(cn_id, 18, 1) AS cn_id FROM p", _NUMBERS))
def f03_check_digits(spark, sf_dir):
    t = spark_table(spark, sf_dir, _NUMBERS)
    return t.select("k", scalars.luhn_check_digit(F.substring("card", 1, 15)).alias("luhn"), scalars.cn_id_check_digit(F.substring("cn_id", 1, 17)).alias("cn_id"))


@query(_with(f"SELECT doc_id, {inputs.window_sql('30', '35', 25, 24)} AS core, {inputs.window_sql('30', '35', 28, 28)} AS wide, {inputs.window_sql('5', '5', 13, 0)} AS before FROM p"))
def f04_context_windows(spark, sf_dir):
    t, i = F.col("text"), F.lit
    return parts(spark, sf_dir).select("doc_id", scalars.context(t, i(30), i(35)).alias("core"), scalars.window(t, i(30), i(35), 28, 28).alias("wide"), scalars.before(t, i(5), 13).alias("before"))


@query(_with(f"SELECT doc_id, {inputs.has_any_sql('text', rules.PUBLIC_CUES)} AS public, {inputs.has_any_sql('text', rules.INVALID_CUES)} AS invalid, {inputs.has_any_sql('text', rules.ADDRESS_CUES)} AS address FROM p"))
def f05_cue_predicates(spark, sf_dir):
    t = F.col("text")
    return parts(spark, sf_dir).select("doc_id", scalars.has_any(t, rules.PUBLIC_CUES).alias("public"), scalars.has_any(t, rules.INVALID_CUES).alias("invalid"), scalars.has_any(t, rules.ADDRESS_CUES).alias("address"))


@query(_with("SELECT doc_id, strlen(substr(text, 1, 7)) AS byte_index, length(text) AS signs, substr(text, 4, 5) AS slice FROM p"))
def f06_code_point_indexes(spark, sf_dir):
    return parts(spark, sf_dir).select("doc_id", F.octet_length(F.substring("text", 1, 7)).alias("byte_index"), F.length("text").alias("signs"), F.substring("text", 4, 5).alias("slice"))


@query(_with("SELECT doc_id, substr(text, 1, 3) || '[X]' || substr(text, 9) AS spliced FROM p WHERE length(text) >= 8"))
def f07_splice(spark, sf_dir):
    return parts(spark, sf_dir).where("length(text) >= 8").select("doc_id", scalars.splice(F.col("text"), F.lit(3), F.lit(8), F.lit("[X]")).alias("spliced"))


@query(_with(f"SELECT n, label, {placeholder_sql('label')} AS placeholder, {order_sql('label')} AS entity_ord FROM (SELECT DISTINCT label, n FROM p)", SPANS))
def f08_placeholders(spark, sf_dir):
    t = spark_table(spark, sf_dir, SPANS).select("label", "n").distinct()
    return t.select("n", "label", detect.placeholder(F.col("label")).alias("placeholder"), detect.entity_order(F.col("label")).alias("entity_ord"))


@query(_with("SELECT doc_id, regexp_replace(text, '[\\s\\x{0B}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}]', '', 'g') AS dense FROM p"))
def f09_without_space(spark, sf_dir):
    return parts(spark, sf_dir).select("doc_id", scalars.without_space(F.col("text")).alias("dense"))


@query("SELECT c_custkey, levenshtein(c_name, reverse(c_name)) AS distance, levenshtein(c_name, c_mktsegment) AS other FROM customer")
def f10_edit_distance(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.levenshtein("c_name", F.reverse("c_name")).cast("long").alias("distance"), F.levenshtein("c_name", "c_mktsegment").cast("long").alias("other"))


_BOXES = "SELECT l_orderkey AS k, l_linenumber AS n, cast(l_partkey % 50 AS int) AS a0, cast(l_suppkey % 40 AS int) AS b0, cast(l_partkey % 50 + l_suppkey % 45 + 1 AS int) AS a1, cast(l_suppkey % 40 + l_linenumber * 3 AS int) AS b1, cast(l_orderkey % 60 AS int) AS c0, cast(l_linenumber * 5 AS int) AS d0, cast(l_orderkey % 60 + 30 AS int) AS c1, cast(l_linenumber * 5 + 20 AS int) AS d1 FROM {lineitem}"
_SHARED = "(greatest(least(a1, c1) - greatest(a0, c0), 0) * greatest(least(b1, d1) - greatest(b0, d0), 0))::DOUBLE"
_AREA = "(greatest({0}1 - {0}0, 0) * greatest({1}1 - {1}0, 0))"


def _boxes(spark, sf_dir):
    t = spark_table(spark, sf_dir, _BOXES)
    b = lambda x, y: geometry.box(*[F.col(c) for c in (f"{x}0", f"{y}0", f"{x}1", f"{y}1")])
    return t, b("a", "b"), b("c", "d")


@query(_with(f"SELECT k, n, coalesce({_SHARED} / nullif({_AREA.format('a', 'b')} + {_AREA.format('c', 'd')} - {_SHARED}, 0), 0) AS iou FROM p", _BOXES))
def f11_intersection_over_union(spark, sf_dir):
    t, a, b = _boxes(spark, sf_dir)
    return t.select("k", "n", geometry.intersection_over_union(a, b).alias("iou"))


@query(_with(f"SELECT k, n, coalesce({_SHARED} / nullif({_AREA.format('a', 'b')}, 0), 0) AS covered FROM p", _BOXES))
def f12_covered_fraction(spark, sf_dir):
    t, a, b = _boxes(spark, sf_dir)
    return t.select("k", "n", geometry.covered_fraction(a, b).alias("covered"))


def weight_sql(text: str) -> str:
    points = f"length(regexp_replace({text}, '[^!-/:-@\\[-`{{-~]', '', 'g'))"
    plain = f"length(regexp_replace({text}, '[^\\x00-\\x7F]', '', 'g'))"
    return f"({points} * 0.75 + ({plain} - {points}) + (length({text}) - {plain}) * 1.5)::DOUBLE"


@query(_with(f"SELECT doc_id, {weight_sql('text')} AS weight FROM p"))
def f13_text_weight(spark, sf_dir):
    return parts(spark, sf_dir).select("doc_id", geometry.text_weight(F.col("text")).cast("double").alias("weight"))


#: One line per synthetic text; every fourth is upright, every fifth slanted.
LINES = f"""SELECT doc_id - 1000000000 AS page_id, 0 AS line_index, text, cast(0.80 + (doc_id % 20) / 100.0 AS float) AS score, x0, y0, x1, y1, CASE WHEN doc_id % 5 = 0 THEN 30 ELSE 0 END AS slant FROM (
    SELECT doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text, cast(doc_id % 30 + 5 AS int) AS x0, cast(20 AS int) AS y0, cast(CASE WHEN doc_id % 4 = 0 THEN doc_id % 30 + 35 ELSE doc_id % 30 + 505 END AS int) AS x1, cast(CASE WHEN doc_id % 4 = 0 THEN 620 ELSE 50 END AS int) AS y1 FROM ({ZH}) z) z2"""


def _lines(spark, sf_dir):
    t = spark_table(spark, sf_dir, LINES)
    x = {c: F.col(c) for c in ("x0", "y0", "x1", "y1", "slant")}
    polygon = F.array(F.array(x["x0"], x["y0"]), F.array(x["x1"], x["y0"] + x["slant"]), F.array(x["x1"], x["y1"]), F.array(x["x0"], x["y1"]))
    return t.select("page_id", "line_index", "text", "score", geometry.box(*[x[c] for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), polygon.alias("polygon"))


_PART_SQL = f"""SELECT *, CASE WHEN across THEN x0 + floor(w * b / t)::INT WHEN down THEN x0 ELSE x0 END AS px0, CASE WHEN across THEN least(greatest(x0 + ceil(w * a / t)::INT, x0 + floor(w * b / t)::INT + 1), x1) ELSE x1 END AS px1,
      CASE WHEN down AND NOT across THEN y0 + floor(h * b / t)::INT ELSE y0 END AS py0, CASE WHEN down AND NOT across THEN least(greatest(y0 + ceil(h * a / t)::INT, y0 + floor(h * b / t)::INT + 1), y1) ELSE y1 END AS py1
    FROM (SELECT *, fits AND w >= h * 2 AND slant <= greatest(h // 4, 4) AS across, fits AND h >= w * 2 AND slant <= greatest(w // 4, 4) AS down FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, {weight_sql('text')} AS t, {weight_sql('substr(text, 1, 4)')} AS b, {weight_sql('substr(text, 1, 12)')} AS a, length(text) >= 12 AS fits FROM p))"""


@query(_with(f"SELECT page_id, px0 AS x0, py0 AS y0, px1 AS x1, py1 AS y1 FROM ({_PART_SQL})", LINES))
def f14_span_box(spark, sf_dir):
    part = geometry.span_box(F.col("bbox"), F.col("polygon"), F.col("text"), F.lit(4), F.lit(12))
    return _lines(spark, sf_dir).select("page_id", part.alias("b")).select("page_id", "b.*")


@query(_with(f"""SELECT page_id, greatest(px0 - mx, 0) AS x0, greatest(py0 - my, 0) AS y0, least(px1 + mx, 600) AS x1, least(py1 + my, 700) AS y1
    FROM (SELECT *, CASE WHEN w >= h THEN 4 + (h + 1) // 2 ELSE 4 END AS mx, CASE WHEN w >= h THEN 4 ELSE 4 + (w + 1) // 2 END AS my FROM ({_PART_SQL}))""", LINES))
def f15_mask_box(spark, sf_dir):
    part = geometry.span_box(F.col("bbox"), F.col("polygon"), F.col("text"), F.lit(4), F.lit(12))
    mask = geometry.mask_box(F.col("part"), F.col("bbox"), 4, F.lit(600), F.lit(700))
    return _lines(spark, sf_dir).withColumn("part", part).select("page_id", mask.alias("b")).select("page_id", "b.*")


@query(_with("SELECT k, n, a0 < a1 AND b0 < b1 AND a1 <= 60 AND b1 <= 45 AS valid FROM p", _BOXES))
def f16_valid_box(spark, sf_dir):
    t, a, _ = _boxes(spark, sf_dir)
    return t.select("k", "n", geometry.valid_box(a, F.lit(60), F.lit(45)).alias("valid"))


_MATRIX = [[1.5, 0.25, 10.0], [0.125, 1.25, -5.0], [0.0, 0.0, 1.0]]


@query(_with("""SELECT k, n, greatest(floor(least(p00, p01, p10, p11)), 0)::INT AS x0, greatest(floor(least(q00, q01, q10, q11)), 0)::INT AS y0, least(ceil(greatest(p00, p01, p10, p11)), 128)::INT AS x1, least(ceil(greatest(q00, q01, q10, q11)), 72)::INT AS y1
    FROM (SELECT k, n, a0 * 1.5 + b0 * 0.25 + 10 AS p00, a0 * 1.5 + b1 * 0.25 + 10 AS p01, a1 * 1.5 + b0 * 0.25 + 10 AS p10, a1 * 1.5 + b1 * 0.25 + 10 AS p11, a0 * 0.125 + b0 * 1.25 - 5 AS q00, a0 * 0.125 + b1 * 1.25 - 5 AS q01, a1 * 0.125 + b0 * 1.25 - 5 AS q10, a1 * 0.125 + b1 * 1.25 - 5 AS q11 FROM p)""", _BOXES))
def f17_mapped_box(spark, sf_dir):
    t, a, _ = _boxes(spark, sf_dir)
    return t.select("k", "n", geometry.mapped_box(a, _MATRIX, 128, 72).alias("b")).select("k", "n", "b.*")


_LOCATORS = "SELECT l_orderkey AS doc_id, l_linenumber AS part_ord, CASE l_linenumber % 4 WHEN 0 THEN 'cell' WHEN 1 THEN 'formula' WHEN 2 THEN 'comment' ELSE 'sheet_name' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN concat('xl/worksheets/sheet', cast(l_suppkey AS string), '.xml#cell=B', cast(l_partkey AS string)) WHEN 1 THEN concat('xl/worksheets/sheet', cast(l_suppkey AS string), '.xml#cell=C', cast(l_partkey AS string), '#formula') WHEN 2 THEN concat('xl/comments', cast(l_suppkey AS string), '.xml#comment=A_', cast(l_partkey AS string)) ELSE 'xl/workbook.xml#sheet=000003' END AS locator FROM {lineitem}"


@query(_with("""SELECT doc_id, part_ord, TRY_CAST(nullif(regexp_extract(locator, '^xl/worksheets/sheet(\\d+)', 1), '') AS BIGINT) AS sheet, TRY_CAST(nullif(regexp_extract(locator, '#sheet=(\\d+)', 1), '') AS BIGINT) AS marker,
    CASE WHEN regexp_matches(split_part(split_part(locator, '#cell=', 2), '#', 1), '^[A-Za-z0-9$]{1,20}$') THEN split_part(split_part(locator, '#cell=', 2), '#', 1) END AS cell FROM p""", _LOCATORS))
def f18_safe_locators(spark, sf_dir):
    t, at = spark_table(spark, sf_dir, _LOCATORS), F.col("locator")
    from ..operators import desktop

    return t.select("doc_id", "part_ord", desktop.locator_ordinal(at, "xl/worksheets/sheet").alias("sheet"), desktop.marker_ordinal(at, "#sheet=").alias("marker"), desktop.locator_reference(at, "#cell=").alias("cell"))


@query(_with("""SELECT doc_id, part_ord, CASE kind WHEN 'cell' THEN '工作表 ' || regexp_extract(locator, '^xl/worksheets/sheet(\\d+)', 1) || ' · 单元格 ' || split_part(locator, '#cell=', 2) || ' · 文本' WHEN 'formula' THEN '工作表 ' || regexp_extract(locator, '^xl/worksheets/sheet(\\d+)', 1) || ' · 单元格 ' || split_part(split_part(locator, '#cell=', 2), '#', 1) || ' · 公式'
    WHEN 'comment' THEN '批注 · 内容 ' || count(*) OVER (PARTITION BY doc_id, kind ORDER BY part_ord) ELSE '工作表 3 · 名称' END AS label FROM p""", _LOCATORS))
def f19_section_labels(spark, sf_dir):
    from ..operators import desktop

    return desktop.xlsx_labels(spark_table(spark, sf_dir, _LOCATORS)).select("doc_id", "part_ord", "label")


@query("SELECT doc_id, concat('{\"a\": \"}', doc_id, '\", \"b\": {\"c\": 1}}') AS object FROM documents")
def f21_first_json_object(spark, sf_dir):
    wrapped = F.concat(F.lit("note {"), F.lit('"a": "}'), F.col("doc_id").cast("string"), F.lit('", "b": {"c": 1}} rest {}'))
    return table(spark, sf_dir, "documents").select("doc_id", models.json_object(wrapped).alias("object"))


@query("SELECT user_id, unnest(flatten(list([event_type, [upper(event_type)][1]] ORDER BY event_id))) AS item FROM events GROUP BY user_id")
def f22_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.explode(F.flatten(F.array(F.array("event_type"), F.array(F.upper("event_type"))))).alias("item"))
    return e


@query("SELECT c_custkey, c_custkey || ' pages' AS pages, c_name AS title FROM customer")
def f23_pdfinfo(spark, sf_dir):
    output = F.concat(F.lit("Title:   "), F.col("c_name"), F.lit("\nPages:\t"), F.col("c_custkey").cast("string"), F.lit(" pages\nPages: other\nno colon\n"))
    info = files.parse_pdfinfo(output)
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(info, "Pages").alias("pages"), F.element_at(info, "Title").alias("title"))


@query(_with("SELECT k, try_strptime(substr(dated, 7, 8), '%Y%m%d') IS NOT NULL AND substr(dated, 1, 2) NOT IN ('00', '62') AS dated, try_strptime(substr(card, 7, 8), '%Y%m%d') IS NOT NULL AND substr(card, 1, 2) NOT IN ('00', '62') AS card FROM p", _NUMBERS))
def f24_valid_cn_id_date(spark, sf_dir):
    return spark_table(spark, sf_dir, _NUMBERS).select("k", *[scalars.valid_cn_id_date(F.col(c)).alias(c) for c in ("dated", "card")])


@query("SELECT o_orderkey, printf('%.2f%%', (o_custkey % 997) / 1000.0 * 100) AS percent FROM orders")
def f25_percent_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.percent_text((F.col("o_custkey") % 997) / 1000.0).alias("percent"))


@query("""SELECT doc_id, unnest(flatten(list_transform(range(1, len(lines) + 1), lambda i: list_transform(range(0, (length(lines[i]) + 39) // 40), lambda k: struct_pack(start := (coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0) + k * 40)::INT, line := substr(lines[i], k * 40 + 1, 40)))))).start AS start
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def f27_wrapped_lines(spark, sf_dir):
    w = scalars.wrapped(F.col("text"), 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(w).alias("w")).select("doc_id", "w.start")


# Policy


POLICY = Policy(allowlist=("support@example.com", "13900000001"), exact_terms=TERMS)
#: Everything but resident numbers; e-mails are held for review.
HELD = Policy(entities={k: policy.Entity(k != "CN_ID_NUMBER", k != "EMAIL", v) for k, v in rules.PLACEHOLDERS.items()}, allowlist=("user8@example.com",))
_HELD_SQL = f"SELECT * FROM ({core_sql('p')}) WHERE entity_type <> 'CN_ID_NUMBER' AND v NOT IN ('user8@example.com')"


@query(_with(f"SELECT {_FOUND_SQL} FROM ({_HELD_SQL})"))
def p01_filter_findings(spark, sf_dir):
    found = detect.detect_rules(parts(spark, sf_dir))
    return detect.exploded(found.withColumn("findings", policy.filter_findings(F.col("findings"), HELD))).select(*FOUND)


@query(_with(f"""SELECT doc_id, s AS start, e AS "end", entity_type, {placeholder_sql('entity_type')} AS replacement, entity_type <> 'EMAIL' AS selected, entity_type <> 'EMAIL' AS reviewed FROM ({_HELD_SQL})"""))
def p02_apply_policy(spark, sf_dir):
    found = detect.detect_rules(parts(spark, sf_dir))
    applied = found.withColumn("findings", policy.apply_policy(F.col("findings"), HELD))
    return detect.exploded(applied).select("doc_id", "start", "end", "entity_type", "replacement", "selected", "reviewed")


@query(_with('SELECT doc_id, n, start, stop AS "end", label, confidence::DOUBLE AS confidence FROM p WHERE confidence >= 0.7::FLOAT', SPANS))
def p03_min_confidence(spark, sf_dir):
    s = spark_table(spark, sf_dir, SPANS).where(F.col("confidence") >= F.lit(0.7).cast("float"))
    return s.select("doc_id", "n", "start", F.col("stop").alias("end"), "label", F.col("confidence").cast("double").alias("confidence"))


_ANSWERS = "SELECT l_orderkey AS doc_id, l_linenumber AS n, concat('0123456789', cast(l_orderkey AS string), 'abcdefghij') AS text, cast(l_partkey % 12 AS int) AS start, cast(l_partkey % 12 + l_suppkey % 4 AS int) AS stop, CASE WHEN l_partkey % 17 = 0 THEN 'zz' ELSE NULL END AS other, CASE WHEN l_suppkey % 23 = 0 THEN 1.5 ELSE 0.5 END AS confidence FROM {lineitem}"


@query(_with("""SELECT doc_id, CASE WHEN bool_or(confidence > 1) THEN CASE WHEN first_bad = 1 THEN 'INVALID_CONFIDENCE' ELSE CASE WHEN first_bad = 2 THEN 'INVALID_SPAN' ELSE 'TEXT_MISMATCH' END END WHEN first_bad = 2 THEN 'INVALID_SPAN' WHEN first_bad = 3 THEN 'TEXT_MISMATCH' END AS error_code
    FROM (SELECT *, min_by(bad, n) FILTER (bad IS NOT NULL) OVER (PARTITION BY doc_id) AS first_bad FROM (SELECT *, CASE WHEN confidence > 1 THEN 1 WHEN start >= stop OR stop > length(text) THEN 2 WHEN other IS NOT NULL AND other <> substr(text, start + 1, stop - start) THEN 3 END AS bad FROM p)) GROUP BY doc_id, first_bad""", _ANSWERS))
def p04_answer_validation(spark, sf_dir):
    """One bad span rejects the whole answer; the first one says why."""
    t = spark_table(spark, sf_dir, _ANSWERS)
    value = F.coalesce("other", F.expr("substring(text, start + 1, stop - start)"))
    f = F.struct("n", "start", F.col("stop").alias("end"), F.lit("ORG_NAME").alias("entity_type"), value.alias("matched_text"), F.col("confidence").cast("float").alias("confidence"), F.lit("X").alias("reason_code"))
    rows = t.groupBy("doc_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(f)).alias("findings"))
    answer = F.struct(F.lit(1).alias("protocol_version"), F.lit("r").alias("request_id"), "findings")
    return rows.select("doc_id", models.answer_error(F.col("text"), F.lit("r"), answer).alias("error_code"))


@query(_with("SELECT page_id, score >= 0.9::FLOAT AS sure, least(score, 0.95::FLOAT)::DOUBLE AS confidence FROM p", LINES))
def p05_ocr_gate(spark, sf_dir):
    least = F.lit(Policy().image_mask.auto_apply_min_ocr_confidence).cast("float")
    return _lines(spark, sf_dir).select("page_id", (F.col("score") >= least).alias("sure"), F.least("score", F.lit(0.95).cast("float")).cast("double").alias("confidence"))


@query(_with("SELECT doc_id, part_ord, kind, kind NOT IN ('formula', 'sheet_name') AS selected, kind NOT IN ('formula', 'sheet_name') AS reviewed FROM p", _LOCATORS))
def p06_held_kinds(spark, sf_dir):
    t = spark_table(spark, sf_dir, _LOCATORS).withColumn("selected", F.lit(True)).withColumn("reviewed", F.lit(True))
    return redact.held_kinds(t).select("doc_id", "part_ord", "kind", "selected", "reviewed")


_POLICIES = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE concat('policy-', cast(s_suppkey AS string)) END AS id, s_suppkey % 13 / 10.0 AS confidence, s_suppkey % 300 AS margin, s_suppkey % 7 = 0 AS reversible FROM {supplier}"


@query(_with("""SELECT k, code, '' AS what FROM (SELECT k, unnest([CASE WHEN version <> 1 THEN 'UNSUPPORTED_SCHEMA' END, CASE WHEN trim(id) = '' THEN 'EMPTY_ID' END, CASE WHEN confidence > 1 THEN 'INVALID_AUTO_APPLY_CONFIDENCE' END,
    CASE WHEN reversible THEN 'MISSING_KEY_REFERENCE' END, CASE WHEN reversible THEN 'REVERSIBLE_MAPPING_NOT_IMPLEMENTED' END, CASE WHEN margin > 128 THEN 'IMAGE_MARGIN_TOO_LARGE' END]) AS code FROM p) WHERE code IS NOT NULL
    UNION ALL SELECT k, 'DUPLICATE_EXACT_TERM', 'a' FROM p WHERE k % 4 = 0 UNION ALL SELECT k, 'INVALID_ALLOWLIST_VALUE', '' FROM p WHERE k % 6 = 0""", _POLICIES))
def p07_policy_violations(spark, sf_dir):
    t = spark_table(spark, sf_dir, _POLICIES)
    term = F.struct(F.lit("a").alias("value"), F.lit("EMAIL").alias("entity_type"))
    full = t.select(
        "k",
        F.col("version").cast("int").alias("schema_version"),
        "id",
        F.col("confidence").cast("float").alias("auto_apply_min_confidence"),
        F.create_map(F.lit("EMAIL"), F.struct(F.lit(True).alias("enabled"), F.lit(True).alias("auto_apply"), F.lit("x").alias("replacement"))).alias("entities"),
        F.array(F.struct(F.lit("d").alias("id"), F.lit(0.5).cast("float").alias("min_confidence"))).alias("detectors"),
        F.when(F.col("k") % 4 == 0, F.array(term, term)).otherwise(F.array(term)).alias("exact_terms"),
        F.when(F.col("k") % 6 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("v"))).alias("allowlist"),
        F.struct(F.col("margin").cast("int").alias("safety_margin_px"), F.lit(0.9).cast("float").alias("auto_apply_min_ocr_confidence")).alias("image_mask"),
        F.struct(F.lit("task").alias("scope"), "reversible", F.lit(None).cast("string").alias("key_reference")).alias("replacement_mapping"),
    )
    return policy.policy_violations(full, key="k")


@query(_with(f"""SELECT doc_id, finding_id, code FROM (SELECT doc_id, n AS finding_id, CASE WHEN length(text) IS NULL THEN 'MISSING_PART' WHEN start >= stop OR stop > length(text) THEN 'INVALID_SPAN'
    WHEN start < max(CASE WHEN n % 2 = 1 THEN stop END) OVER (PARTITION BY doc_id ORDER BY start, stop, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AND n % 2 = 1 THEN 'OVERLAPPING_FINDINGS' END AS code FROM p LEFT JOIN documents USING (doc_id)) WHERE code IS NOT NULL""", SPANS))
def p08_task_errors(spark, sf_dir):
    s = spark_table(spark, sf_dir, SPANS).select("doc_id", F.col("n").alias("finding_id"), "start", F.col("stop").alias("end"), (F.col("n") % 2 == 1).alias("selected"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = s.join(d, "doc_id", "left").withColumn("matched_text", F.expr("substring(text, start + 1, end - start)")).drop("text")
    return redact.task_errors(d, own)


_CASES = f"""SELECT cast(doc_id AS string) AS id, CASE WHEN doc_id % 11 = 0 THEN 'train' WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN doc_id % 13 = 0 THEN 'en' ELSE 'zh-CN' END AS language,
    CASE WHEN doc_id % 17 = 0 THEN 'same' ELSE text END AS text, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'normal' ELSE 'hard' END AS difficulty, doc_id FROM ({ZH}) z"""


@query(_with("""SELECT id, code FROM (SELECT id, unnest([CASE WHEN split NOT IN ('dev', 'test') THEN 'INVALID_SPLIT' END, CASE WHEN language NOT IN ('zh-CN', 'zh-TW', 'mixed') THEN 'INVALID_LANGUAGE' END, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY id) > 1 THEN 'DUPLICATE_TEXT' END,
    CASE WHEN doc_id % 7 = 0 THEN CASE WHEN length(text) < 12 THEN 'INVALID_SPAN' END END, CASE WHEN doc_id % 7 = 0 THEN 'UNSORTED_ENTITIES' END]) AS code FROM p) WHERE code IS NOT NULL""", _CASES))
def p09_dataset_errors(spark, sf_dir):
    t = spark_table(spark, sf_dir, _CASES)
    e = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("EMAIL").alias("label"), F.substring("text", a + 1, b - a).alias("text"))
    cases = t.withColumn("entities", F.when(F.col("doc_id") % 7 == 0, F.array(e(8, 12), e(0, 3))).otherwise(F.array(e(0, 2))))
    return scoring.dataset_errors(cases)


@query(_with(f"""SELECT doc_id, finding_ord, entity_type, v AS matched_text, substr(text, greatest(s - 80, 0) + 1, s - greatest(s - 80, 0)) AS before, substr(text, e + 1, 80) AS after
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, rule_ord) - 1 AS finding_ord FROM ({core_sql('p')})) JOIN p USING (doc_id)"""))
def p10_review_projection(spark, sf_dir):
    from ..operators import desktop

    p = parts(spark, sf_dir)
    found = detect.exploded(detect.detect_rules(p))
    return desktop.review_projection(found, p).select("doc_id", "finding_ord", "entity_type", "matched_text", "before", "after")


@query(_with("SELECT id, split FROM p WHERE split = 'dev' ORDER BY id LIMIT 50", _CASES))
def p12_split_and_limit(spark, sf_dir):
    """A split's first records: the limit is the feature."""
    return spark_table(spark, sf_dir, _CASES).where("split = 'dev'").orderBy("id").limit(50).select("id", "split")


_FILES = "SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS ready, o_custkey % 3 <> 0 AS scan_supported, CASE o_orderkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'complete' WHEN 3 THEN 'scanning' END AS status FROM {orders}"


@query(_with("SELECT * FROM p WHERE ready AND scan_supported AND (status IS NULL OR status IN ('blocked', 'cancelled'))", _FILES))
def p13_eligible_files(spark, sf_dir):
    from ..operators import desktop

    return desktop.eligible(spark_table(spark, sf_dir, _FILES))


# Joins


@query(_with(f"SELECT doc_id, n, length(text) AS signs, text IS NULL AS missing FROM p LEFT JOIN documents USING (doc_id)", SPANS))
def j01_findings_and_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark_table(spark, sf_dir, SPANS).join(d, "doc_id", "left").select("doc_id", "n", F.length("text").alias("signs"), F.col("text").isNull().alias("missing"))


@query(_with("SELECT a.doc_id, a.part_ord, b.part_ord AS other FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.locator = b.locator", _LOCATORS))
def j02_parts_by_locator(spark, sf_dir):
    t = spark_table(spark, sf_dir, _LOCATORS)
    return t.select("doc_id", "locator", "part_ord").join(t.select("doc_id", "locator", F.col("part_ord").alias("other")), ["doc_id", "locator"]).select("doc_id", "part_ord", "other")


def _sides(spark, sf_dir):
    t = spark_table(spark, sf_dir, SPANS).withColumnRenamed("stop", "end")
    return t.where("side = 'R'").drop("side"), t.where("side <> 'R'").drop("side")


@query(_with("SELECT a.doc_id, a.n AS l_n, b.n AS r_n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop WHERE a.side = 'R' AND b.side <> 'R'", SPANS))
def j03_overlap_join(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return resolve.overlap_pairs(left, right, ["doc_id"]).select("doc_id", "l_n", "r_n")


_PAGE_LINES = f"SELECT l_orderkey AS page_id, l_linenumber - 1 AS line_index, l_comment AS text FROM {{lineitem}}"


def _page_lines(spark, sf_dir):
    return spark_table(spark, sf_dir, _PAGE_LINES)


_LAYOUT_SQL = "SELECT page_id, line_index, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM p"


@query(_with(f"SELECT page_id, line_index, greatest(start, 10) - start AS text_start, least(start + length(text), 40) - start AS text_end FROM ({_LAYOUT_SQL}) WHERE start < 40 AND 10 < start + length(text)", _PAGE_LINES))
def j04_spans_and_lines(spark, sf_dir):
    """A span of every page (10 to 40) cut by the lines it touches."""
    placed = ocr.layout(_page_lines(spark, sf_dir))
    span = placed.select("page_id").distinct().withColumns({"start": F.lit(10), "end": F.lit(40)})
    lines = placed.select("page_id", "line_index", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    both = span.join(lines, "page_id").where("start < l_end AND l_start < end")
    return both.select("page_id", "line_index", (F.greatest("l_start", "start") - F.col("l_start")).alias("text_start"), (F.least("l_end", "end") - F.col("l_start")).alias("text_end"))


@query(_with(f"SELECT DISTINCT o.page_id, o.o AS \"offset\", min(l.line_index) OVER (PARTITION BY o.page_id, o.o) AS line_index FROM (SELECT DISTINCT page_id, unnest([5, 30, 60]) AS o FROM p) o LEFT JOIN ({_LAYOUT_SQL}) l ON o.page_id = l.page_id AND l.start <= o.o AND o.o < l.start + length(l.text)", _PAGE_LINES))
def j05_line_at_offset(spark, sf_dir):
    placed = ocr.layout(_page_lines(spark, sf_dir))
    offsets = placed.select("page_id").distinct().select("page_id", F.explode(F.array(F.lit(5), F.lit(30), F.lit(60))).alias("offset"))
    return ocr.line_at(offsets, placed)


@query(_with("SELECT a.doc_id, a.n FROM p a WHERE side = 'R' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.side <> 'R' AND a.doc_id = b.doc_id AND a.start = b.start AND a.stop = b.stop)", SPANS))
def j06_same_span_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return resolve.same_span_anti(left, right, ["doc_id"]).select("doc_id", "n")


@query(_with("SELECT a.doc_id, a.n FROM p a WHERE side = 'R' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.side <> 'R' AND a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop)", SPANS))
def j07_overlap_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return resolve.without_overlaps(left, right, ["doc_id"]).select("doc_id", "n")


@query(_with("SELECT doc_id, n, label FROM p a WHERE side = 'R' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.side = 'N' AND a.doc_id = b.doc_id AND a.label = b.label AND a.start = b.start)", SPANS))
def j08_kept_values_anti(spark, sf_dir):
    t = spark_table(spark, sf_dir, SPANS)
    kept = t.where("side = 'N'").select("doc_id", "label", "start").distinct()
    return t.where("side = 'R'").join(kept, ["doc_id", "label", "start"], "left_anti").select("doc_id", "n", "label")


@query(_with(f"SELECT doc_id, entity_type, v AS matched_text FROM ({_HELD_SQL})"))
def j09_policy_joins(spark, sf_dir):
    """The policy as joins with its tables instead of expressions."""
    found = detect.exploded(detect.detect_rules(parts(spark, sf_dir)))
    return policy.filter_finding_rows(found, HELD).select("doc_id", "entity_type", "matched_text")


#: Gold spans of orders; predictions lack every seventh order and shift some spans.
_GOLD = "SELECT cast(l_orderkey AS string) AS id, l_linenumber AS n, cast(l_partkey % 50 AS int) AS start, cast(l_partkey % 50 + 5 AS int) AS stop, CASE l_suppkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'ADDRESS' ELSE 'ORG_NAME' END AS label, l_orderkey FROM {lineitem}"
_PREDICTED = "SELECT id, n, start + CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END AS start, stop + CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END AS stop, CASE WHEN n % 5 = 0 THEN 'EMAIL' ELSE label END AS label, l_orderkey FROM (" + _GOLD + ") g WHERE l_orderkey % 7 <> 0"
_BOTH = f"WITH g AS ({duck(_GOLD)}), q AS ({duck(_PREDICTED)})"


def _gold(spark, sf_dir):
    """(gold, predictions) as nested records."""
    e = F.struct("n", "start", F.col("stop").alias("end"), "label")
    nest = lambda sql: spark_table(spark, sf_dir, sql).groupBy("id").agg(F.first("l_orderkey").alias("k"), F.array_sort(F.collect_list(e)).alias("x")).withColumn("entities", F.transform("x", lambda s: s.dropFields("n"))).drop("x")
    difficulty = F.element_at(F.array(F.lit("easy"), F.lit("normal"), F.lit("hard")), (F.col("k") % 3 + 1).cast("int"))
    gold = nest(_GOLD).withColumn("difficulty", difficulty).withColumn("tags", F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    runtime = F.when(F.col("k") % 4 != 0, (F.col("k") % 101).cast("double") / 2)
    return gold, nest(_PREDICTED).withColumn("runtime_ms", runtime).withColumn("structured_output_valid", F.col("k") % 10 < 9)


@query(f"{_BOTH} SELECT id, coalesce(np, 0) AS n_predicted, np IS NULL AS missing FROM (SELECT DISTINCT id FROM g) LEFT JOIN (SELECT id, count(*) AS np FROM q GROUP BY id) USING (id)")
def j10_gold_and_predictions(spark, sf_dir):
    gold, predictions = _gold(spark, sf_dir)
    return scoring.joined(gold, predictions).select("id", F.size("predicted").cast("long").alias("n_predicted"), "missing")


@query(f"{_BOTH} SELECT id, count(*) AS n FROM q WHERE id IN (SELECT id FROM g) GROUP BY id")
def j11_rules_and_model(spark, sf_dir):
    gold, predictions = _gold(spark, sf_dir)
    return gold.select("id").join(predictions, "id").select("id", F.size("entities").cast("long").alias("n"))


@query(_with(f"SELECT k, bool_or(coalesce({_SHARED} / nullif({_AREA.format('a', 'b')}, 0), 0) >= 0.8) AS covered, bool_or(coalesce({_SHARED} / nullif({_AREA.format('a', 'b')} + {_AREA.format('c', 'd')} - {_SHARED}, 0), 0) >= 0.5) AS detected FROM p GROUP BY k", _BOXES))
def j12_box_matches(spark, sf_dir):
    t, a, b = _boxes(spark, sf_dir)
    return t.groupBy("k").agg(F.bool_or(geometry.covered_fraction(a, b) >= 0.8).alias("covered"), F.bool_or(geometry.intersection_over_union(a, b) >= 0.5).alias("detected"))


#: Terms that are scanned for at once.
TERMS_AT_ONCE = 10_000


def _texts_and_many_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, item_id) of docs (doc_id, text) and terms (item_id, term), one row for each pair of rows.

    A whole word inside a term is a word of each text that holds the term, so these pairs meet by it. Terms without
    one are scanned for in blocks. Equal rows go as one with a count.
    """
    docs = docs.where("text IS NOT NULL").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    terms = terms.where("term IS NOT NULL").groupBy("item_id", "term").agg(F.count("*").alias("m"))
    terms = terms.withColumn("w", F.regexp_extract("term", r"\S+\s+(\S+)\s", 1))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).distinct()
    asked = words.join(terms.where("w <> ''"), "w").select(F.col("doc_id").alias("id"), "item_id", "term", "m")
    held = F.contains("text", F.col("term"))
    found = asked.join(docs, F.col("id").eqNullSafe(F.col("doc_id"))).where(held).select("doc_id", "item_id", "n", "m")
    scanned = terms.where("w = ''")
    blocks = -(-scanned.count() // TERMS_AT_ONCE)
    for b in range(blocks):
        block = scanned.where(F.pmod(F.xxhash64("item_id", "term"), F.lit(blocks)) == b)
        found = found.unionByName(docs.join(F.broadcast(block), held).select("doc_id", "item_id", "n", "m"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n") * F.col("m")))).select("doc_id", "item_id")


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def j13_texts_and_terms(spark, sf_dir):
    """Literal terms in texts. The terms are a policy's, so few; each text is scanned where it lies."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if terms.limit(TERMS_AT_ONCE + 1).count() > TERMS_AT_ONCE:
        return _texts_and_many_terms(docs, terms)
    return docs.join(F.broadcast(terms), F.contains("text", F.col("term"))).select("doc_id", "item_id")


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right, b.k IS NULL AS only_left FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def j14_set_equality(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    a, b = (l.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")).distinct().withColumn(x, F.lit(True)) for x in "RA")
    return a.join(b, "k", "full").where("R IS NULL OR A IS NULL").select("k", F.col("R").isNull().alias("only_right"), F.col("A").isNull().alias("only_left"))


@query("SELECT * FROM (VALUES ('siamese_uie', 50, 'RUN', 0), ('qwen_review', 30, 'MODEL_RUNTIME_NOT_CONFIGURED', 1)) AS t(detector_id, priority, outcome, place)")
def j15_detector_runtimes(spark, sf_dir):
    return policy.detector_runtimes(spark, Policy(), ["siamese_uie"]).select("detector_id", "priority", "outcome", "place")


@query("SELECT l_orderkey, l_linenumber, p_name AS text FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j16_shared_strings(spark, sf_dir):
    shared = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    return table(spark, sf_dir, "lineitem").join(shared, "l_partkey", "left").select("l_orderkey", "l_linenumber", "text")


# Aggregates and folds


def _nested(spark, sf_dir, side: str) -> Column:
    f = F.struct(F.col("start"), F.col("stop").alias("end"), F.col("label").alias("entity_type"), F.lit("").alias("matched_text"), F.col("side").alias("detector"), "confidence", F.lit("").alias("explanation_code"), F.lit(True).alias("selected"), F.lit(False).alias("reviewed"), F.lit("").alias("replacement"), F.col("n").cast("int").alias("rule_ord"))
    typed = f.cast(detect.FINDING)
    ordered = F.array_sort(F.collect_list(F.when(F.expr(side), F.struct("n", typed.alias("f")))))
    return F.transform(ordered, lambda x: x["f"])


def _merged(spark, sf_dir, merge) -> DataFrame:
    t = spark_table(spark, sf_dir, SPANS)
    nested = t.groupBy("doc_id").agg(_nested(spark, sf_dir, "side = 'R'").alias("first"), _nested(spark, sf_dir, "side <> 'R'").alias("second"))
    return nested.withColumn("findings", merge(F.col("first"), F.col("second")))


_GREEDY = """SELECT doc_id, unnest(list_reduce(list_concat([coalesce(list([n, start, stop]) FILTER (side = 'R'), [])], coalesce(list([[n, start, stop]] ORDER BY confidence DESC, stop - start DESC, n) FILTER (side <> 'R'), [])),
    lambda a, b: CASE WHEN len(list_filter(a, lambda y: y[2] < b[1][3] AND b[1][2] < y[3])) > 0 THEN a ELSE list_concat(a, b) END))[1] AS n FROM p GROUP BY doc_id"""


@query(_with(_GREEDY, SPANS))
def a01_merge_model_findings(spark, sf_dir):
    return detect.exploded(_merged(spark, sf_dir, resolve.merge_model)).select("doc_id", F.col("rule_ord").alias("n"))


_EXACT_KEPT = """SELECT doc_id, unnest(list_reduce(list([[n, start, stop]] ORDER BY start - stop, n), lambda a, b: CASE WHEN len(list_filter(a, lambda y: y[2] < b[1][3] AND b[1][2] < y[3])) > 0 THEN a ELSE list_concat(a, b) END)) AS f FROM p WHERE side <> 'R' GROUP BY doc_id"""


@query(_with(f"""SELECT doc_id, f[1] AS n FROM ({_EXACT_KEPT}) UNION ALL SELECT a.doc_id, a.n FROM p a WHERE side = 'R' AND NOT EXISTS (SELECT 1 FROM ({_EXACT_KEPT}) k WHERE k.doc_id = a.doc_id AND a.start < k.f[3] AND k.f[2] < a.stop)""", SPANS))
def a02_merge_exact_terms(spark, sf_dir):
    named = lambda x: F.transform(x, lambda f: f.withField("detector", F.lit(rules.TERMS_DETECTOR)))
    return detect.exploded(_merged(spark, sf_dir, lambda a, b: resolve.merge_exact(a, named(b)))).select("doc_id", F.col("rule_ord").alias("n"))


#: State and elements are lists of [n, start, stop, label]; customers (2) push out organisations (0).
_LEFT = "(CASE WHEN b[1][4] = 2 THEN list_filter(a, lambda y: NOT (y[4] = 0 AND y[2] < b[1][3] AND b[1][2] < y[3])) ELSE a END)"
_MERGED_EVALUATION = f"""SELECT doc_id, f[2]::INT AS start, f[3]::INT AS "end", ['ORG_NAME', 'PERSON_NAME', 'CUSTOMER_NAME'][f[4] + 1] AS label FROM (
    SELECT doc_id, unnest(list_reduce(list_concat([coalesce(list([n, start, stop, l] ORDER BY n) FILTER (side = 'R'), [])], coalesce(list([[n, start, stop, l]] ORDER BY n) FILTER (side <> 'R'), [])),
        lambda a, b: CASE WHEN len(list_filter({_LEFT}, lambda y: y[2] < b[1][3] AND b[1][2] < y[3])) > 0 THEN {_LEFT} ELSE list_concat({_LEFT}, b) END)) AS f
    FROM (SELECT doc_id, n::BIGINT AS n, start::BIGINT AS start, stop::BIGINT AS stop, side, CASE label WHEN 'ORG_NAME' THEN 0 WHEN 'PERSON_NAME' THEN 1 ELSE 2 END::BIGINT AS l FROM p) GROUP BY doc_id)"""


@query(_with(_MERGED_EVALUATION, SPANS))
def a03_merge_evaluation(spark, sf_dir):
    return detect.exploded(_merged(spark, sf_dir, resolve.merge_evaluation)).select("doc_id", "start", "end", F.col("entity_type").alias("label"))


_REDACTED = f"""SELECT p.doc_id, CASE WHEN bad THEN NULL ELSE coalesce(pieces, '') || substr(text, coalesce(last_end, 0) + 1) END AS redacted, CASE WHEN bad THEN 'OVERLAPPING_FINDINGS' END AS error_code
    FROM p LEFT JOIN (SELECT doc_id, bool_or(s < before) AS bad, max(e) AS last_end, string_agg(substr(text, before + 1, greatest(s - before, 0)) || {placeholder_sql('entity_type')}, '' ORDER BY s, e, rule_ord) AS pieces
      FROM (SELECT c.*, text, coalesce(max(e) OVER (PARTITION BY c.doc_id ORDER BY s, e, rule_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({core_sql('p')}) c JOIN p USING (doc_id)) GROUP BY doc_id) r ON p.doc_id = r.doc_id"""


def _redacted(spark, sf_dir) -> DataFrame:
    return redact.redact(redact.scan(parts(spark, sf_dir), Policy()))


@query(_with(_REDACTED))
def a04_redacted_texts(spark, sf_dir):
    """Selected spans replaced; overlapping ones are an error of that text."""
    return _redacted(spark, sf_dir).select("doc_id", "redacted", "error_code")


@query(_with(f"""SELECT doc_id, count(c.s)::INT AS selected_findings, sha256(coalesce(any_value(r.redacted), '')) AS output_sha256 FROM ({_REDACTED}) r LEFT JOIN ({core_sql('p')}) c USING (doc_id) GROUP BY doc_id"""))
def a05_report_counts(spark, sf_dir):
    v = redact.verify(_redacted(spark, sf_dir), Policy())
    return v.select("doc_id", "selected_findings", "output_sha256")


@query("SELECT l_partkey % 100 AS page_id, count(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') AS unreviewed_groups, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1")
def a06_distinct_groups(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_partkey") % 100).alias("page_id")).agg(F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("unreviewed_groups"), F.count_distinct("l_suppkey").alias("groups"))


@query("SELECT page_id, count(*) AS groups, count(*) FILTER (s) AS selected_groups, count(*) FILTER (r) AS reviewed_groups FROM (SELECT l_orderkey AS page_id, l_linestatus, bool_or(l_returnflag = 'R') AS s, bool_and(l_returnflag <> 'N') AS r FROM lineitem GROUP BY 1, 2) GROUP BY page_id")
def a07_group_states(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return ocr.group_states(l.select(F.col("l_orderkey").alias("page_id"), F.col("l_linestatus").alias("group_id"), (F.col("l_returnflag") == "R").alias("selected"), (F.col("l_returnflag") != "N").alias("reviewed")))


_CHECKED = "SELECT l_orderkey AS doc_id, l_linenumber AS part, concat('d', cast(l_suppkey % 3 AS string)) AS detector FROM {lineitem} UNION ALL SELECT l_orderkey, l_linenumber, 'rules' FROM {lineitem}"


@query(_with("SELECT doc_id, detector FROM p GROUP BY doc_id, detector HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM p q WHERE q.doc_id = p.doc_id)", _CHECKED))
def a08_detectors_of_all_parts(spark, sf_dir):
    t = spark_table(spark, sf_dir, _CHECKED)
    n = t.groupBy("doc_id").agg(F.count_distinct("part").alias("parts"))
    return t.groupBy("doc_id", "detector").agg(F.count_distinct("part").alias("k")).join(n, "doc_id").where("k = parts").select("doc_id", "detector")


@query(_with("SELECT doc_id, count(DISTINCT detector) FILTER (detector IN ('d0', 'd1')) = 2 AS complete FROM p GROUP BY doc_id", _CHECKED))
def a09_complete_flag(spark, sf_dir):
    return spark_table(spark, sf_dir, _CHECKED).groupBy("doc_id").agg((F.count_distinct(F.when(F.col("detector").isin("d0", "d1"), F.col("detector"))) == 2).alias("complete"))


@query(f"{_BOTH} SELECT id, label, tp, fp, fn FROM (SELECT id, label, sum(least(g, p))::BIGINT AS tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM (SELECT id, label, start, stop, sum(gg) AS g, sum(pp) AS p FROM (SELECT id, label, start, stop, 1 AS gg, 0 AS pp FROM g UNION ALL SELECT id, label, start, stop, 0, 1 FROM q) GROUP BY ALL) GROUP BY id, label)")
def a10_exact_counts(spark, sf_dir):
    return scoring.exact_counts(*_gold(spark, sf_dir))


#: The state is the list of used predictions behind a -1; elements are [start, stop, label].
_MATCHED = """SELECT id, tp, np - tp AS fp, ng - tp AS fn FROM (SELECT id, len(gold)::BIGINT AS ng, len(pred)::BIGINT AS np, len(list_reduce(list_concat([[-1::BIGINT]], gold), lambda a, b: CASE WHEN len(list_filter(range(1, len(pred) + 1), lambda i: pred[i][3] = b[3] AND pred[i][1] < b[2] AND b[1] < pred[i][2] AND NOT list_contains(a, i))) > 0
    THEN list_append(a, list_filter(range(1, len(pred) + 1), lambda i: pred[i][3] = b[3] AND pred[i][1] < b[2] AND b[1] < pred[i][2] AND NOT list_contains(a, i))[1]) ELSE a END))::BIGINT - 1 AS tp
    FROM (SELECT id, list([start::BIGINT, stop::BIGINT, (hash(label) >> 2)::BIGINT] ORDER BY n) AS gold FROM g GROUP BY id) LEFT JOIN (SELECT id, list([start::BIGINT, stop::BIGINT, (hash(label) >> 2)::BIGINT] ORDER BY n) AS found FROM q GROUP BY id) USING (id), LATERAL (SELECT coalesce(found, []) AS pred))"""


@query(f"{_BOTH} {_MATCHED}")
def a11_overlap_counts(spark, sf_dir):
    return scoring.overlap_counts(*_gold(spark, sf_dir))


_CHARACTERS = "SELECT id, count(*) FILTER (gg = 1 AND pp = 1) AS tp, count(*) FILTER (gg = 0) AS fp, count(*) FILTER (pp = 0) AS fn FROM (SELECT id, label, pos, max(gg) AS gg, max(pp) AS pp FROM (SELECT id, label, unnest(range(start, stop)) AS pos, 1 AS gg, 0 AS pp FROM g UNION ALL SELECT id, label, unnest(range(start, stop)), 0, 1 FROM q) GROUP BY ALL) GROUP BY id"


@query(f"{_BOTH} {_CHARACTERS}")
def a12_character_counts(spark, sf_dir):
    return scoring.character_counts(*_gold(spark, sf_dir))


_EXACT_SQL = "SELECT id, label, sum(least(g, p))::BIGINT AS tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM (SELECT id, label, start, stop, sum(gg) AS g, sum(pp) AS p FROM (SELECT id, label, start, stop, 1 AS gg, 0 AS pp FROM g UNION ALL SELECT id, label, start, stop, 0, 1 FROM q) GROUP BY ALL) GROUP BY id, label"


def _measures_sql(counts: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT {k}tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM ({counts}))"


@query(f"{_BOTH} {_measures_sql(f'SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_EXACT_SQL})')}")
def a13_precision_recall(spark, sf_dir):
    return scoring.total(scoring.exact_counts(*_gold(spark, sf_dir)))


_GROUPS = f"""SELECT dimension, value, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
    SELECT 'label' AS dimension, label AS value, tp, fp, fn FROM ({_EXACT_SQL}) UNION ALL SELECT 'micro', 'all', tp, fp, fn FROM ({_EXACT_SQL})
    UNION ALL SELECT 'difficulty', ['easy', 'normal', 'hard'][(id::BIGINT % 3 + 1)::INT], tp, fp, fn FROM ({_EXACT_SQL})
    UNION ALL SELECT 'tag', unnest(CASE WHEN id::BIGINT % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END), tp, fp, fn FROM ({_EXACT_SQL})) GROUP BY ALL"""


@query(f"{_BOTH} {_measures_sql(_GROUPS, 'dimension, value')}")
def a14_grouped_metrics(spark, sf_dir):
    return scoring.grouped(*_gold(spark, sf_dir))


_RUNTIMES = "SELECT DISTINCT id, (l_orderkey % 101)::DOUBLE / 2 AS r FROM q WHERE l_orderkey % 4 <> 0"


@query(f"{_BOTH} SELECT avg(r) AS mean_ms, median(r) AS median_ms, list_sort(list(r))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95_ms, sum(r) AS total_ms FROM ({_RUNTIMES})")
def a15_runtime_summary(spark, sf_dir):
    return scoring.runtimes(*_gold(spark, sf_dir))


@query(f"{_BOTH} SELECT count(*) AS records, count(*) FILTER (k % 7 = 0) AS missing_predictions, (count(*) FILTER (k % 7 <> 0 AND k % 10 < 9) / count(*))::DOUBLE AS structured_output_valid_rate FROM (SELECT DISTINCT l_orderkey AS k FROM g)")
def a16_output_rates(spark, sf_dir):
    return scoring.rates(*_gold(spark, sf_dir))


@query(_with(f"""SELECT style, count(*) AS records, 1 - sum(levenshtein(e, r)) / sum(length(e)) AS character_accuracy, avg((v <> '' AND contains(r, v))::INT)::DOUBLE AS sensitive_exact_recall, avg(covered::INT)::DOUBLE AS sensitive_coverage_recall, avg(iou::INT)::DOUBLE AS line_recall
    FROM (SELECT *, regexp_replace(text, '\\s', '', 'g') AS e, regexp_replace(substr(text, 1, 30), '\\s', '', 'g') AS r, substr(regexp_replace(text, '\\s', '', 'g'), 25, 8) AS v, page_id % 3 <> 0 AS covered, page_id % 3 <> 0 AS iou, CASE WHEN page_id % 2 = 0 THEN 'plain' ELSE 'photo' END AS style FROM (SELECT page_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM p)) GROUP BY ROLLUP (style)""", LINES))
def a17_ocr_metrics(spark, sf_dir):
    t = _lines(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^ -~]", "x"))  # DuckDB's edit distance counts bytes
    dense = scalars.without_space(F.col("text"))
    region = F.array(F.struct(F.substring(dense, 25, 8).alias("text"), F.col("bbox")))
    manifest = t.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "plain").otherwise("photo").alias("style"), "text", region.alias("sensitive_regions"), region.alias("line_regions"))
    boxes = F.when(F.col("page_id") % 3 != 0, F.array("bbox")).otherwise(F.array(geometry.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))))
    predictions = t.select(F.col("page_id").alias("id"), F.substring("text", 1, 30).alias("recognized_text"), boxes.alias("boxes"))
    return scoring.score_ocr(manifest, predictions)


@query(f"{_BOTH} SELECT label, count(*) AS n FROM g GROUP BY label")
def a18_label_histogram(spark, sf_dir):
    return scoring.labels_histogram(_gold(spark, sf_dir)[0])


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY user_id, event_type")
def a19_first_diagnostics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


@query("SELECT l_orderkey, count(DISTINCT l_shipmode) > 1 AS conflict FROM lineitem GROUP BY l_orderkey")
def a20_replacement_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_shipmode") > 1).alias("conflict"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R') AS retained FROM part")
def a21_retained_strings(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("retained", F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("retained", F.lit(False)).alias("retained"))


@query(_with("SELECT doc_id, count(*) AS entries, sum(size)::BIGINT AS total_size, max(size) AS largest FROM p GROUP BY doc_id", _ENTRIES))
def a22_package_totals(spark, sf_dir):
    return spark_table(spark, sf_dir, _ENTRIES).groupBy("doc_id").agg(F.count("*").alias("entries"), F.sum("size").alias("total_size"), F.max("size").alias("largest"))


_EXPORTS = "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ready_to_export' WHEN 1 THEN 'export_failed' WHEN 2 THEN 'complete' WHEN 3 THEN 'review_required' ELSE 'blocked' END AS status, o_custkey % 4 <> 0 AS exported, o_custkey % 3 <> 0 AS complete FROM {orders}"


@query(_with("""SELECT count(*) FILTER (w) AS attempted, count(*) FILTER (w AND exported) AS succeeded, count(*) FILTER (w AND NOT exported) AS failed, count(*) FILTER (NOT w) AS skipped, count(*) FILTER (w AND exported AND complete) AS complete_verifications, count(*) FILTER (w AND exported AND NOT complete) AS basic_verifications
    FROM (SELECT *, status IN ('ready_to_export', 'export_failed', 'complete') AS w FROM p)""", _EXPORTS))
def a23_export_summary(spark, sf_dir):
    from ..operators import desktop

    return desktop.export_summary(spark_table(spark, sf_dir, _EXPORTS))


@query("SELECT l_orderkey AS doc_id, bool_and(l_partkey % 7 < 6) AS passed, sum(l_linenumber)::BIGINT AS residual_count, list_sort(list_distinct(flatten(list([l_shipmode, l_linestatus])))) AS detectors FROM lineitem GROUP BY 1")
def a24_report_rollup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.bool_and(F.col("l_partkey") % 7 < 6).alias("passed"), F.sum("l_linenumber").alias("residual_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("l_shipmode", "l_linestatus"))))).alias("detectors"))


@query("SELECT event_type, max(value) AS peak FROM events GROUP BY event_type")
def a25_peaks(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("peak"))


# Windows and orders


@query("SELECT l_orderkey, printf('xlsx-part-%05d', n) AS part_id, l_comment AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE length(l_comment) > 20")
def w01_part_numbers(spark, sf_dir):
    """Parts are numbered before empty ones go, so numbers have gaps."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).where("length(l_comment) > 20").select("l_orderkey", F.format_string("xlsx-part-%05d", "n").alias("part_id"), F.col("l_comment").alias("text"))


@query(_with("SELECT doc_id, n, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop, n) < stop, false) AS overlaps FROM p", SPANS))
def w02_adjacent_overlaps(spark, sf_dir):
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "stop", "n"))
    return spark_table(spark, sf_dir, SPANS).withColumn("overlaps", F.coalesce(nxt < F.col("stop"), F.lit(False))).select("doc_id", "n", "overlaps")


@query(_with(f'SELECT page_id, line_index, start, start + length(text) AS "end" FROM ({_LAYOUT_SQL})', _PAGE_LINES))
def w03_page_layout(spark, sf_dir):
    return ocr.layout(_page_lines(spark, sf_dir)).select("page_id", "line_index", "start", "end")


@query(_with("SELECT page_id, string_agg(text, chr(10) ORDER BY line_index) AS text FROM p GROUP BY page_id", _PAGE_LINES))
def w03_page_texts(spark, sf_dir):
    return ocr.page_texts(_page_lines(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(length(l_comment)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slot_start FROM lineitem")
def w04_slot_offsets(spark, sf_dir):
    before = F.sum(F.length("l_comment")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(before, F.lit(0)).alias("slot_start"))


@query(_with(f"SELECT doc_id, r.o AS \"open\", r.c AS \"close\" FROM (SELECT doc_id, unnest(ranges) AS r FROM ({_FENCES}))", MARKDOWN))
def w05_fences(spark, sf_dir):
    return parts(spark, sf_dir, MARKDOWN).select("doc_id", F.explode(detect.fences(F.col("text"))).alias("r")).select("doc_id", "r.open", "r.close")


@query(_with("SELECT doc_id, part_ord, count(*) OVER (PARTITION BY doc_id, kind ORDER BY part_ord) AS part_number FROM p", _LOCATORS))
def w06_part_ordinals(spark, sf_dir):
    from ..operators import desktop

    return desktop.with_part_number(spark_table(spark, sf_dir, _LOCATORS)).select("doc_id", "part_ord", "part_number")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate_text FROM documents")
def w07_duplicate_flags(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("text").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", (n > 1).alias("duplicate_text"))


@query(_with("SELECT doc_id, bool_and(ok) AS is_sorted FROM (SELECT doc_id, coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY n) <= start, true) AS ok FROM p) GROUP BY doc_id", SPANS))
def w08_sortedness(spark, sf_dir):
    before = F.lag("start").over(Window.partitionBy("doc_id").orderBy("n"))
    return spark_table(spark, sf_dir, SPANS).withColumn("ok", F.coalesce(before <= F.col("start"), F.lit(True))).groupBy("doc_id").agg(F.bool_and("ok").alias("is_sorted"))


@query("SELECT o_orderkey, CASE WHEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 5 = 0 THEN 'dev' ELSE 'test' END AS split FROM orders")
def w09_split(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 5 == 0, "dev").otherwise("test").alias("split"))


@query(_with("SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, n) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC, stop DESC, n) AS from_right FROM p", SPANS))
def t01_finding_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "stop", "n"))
    right = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("start"), F.desc("stop"), "n"))
    return spark_table(spark, sf_dir, SPANS).select("doc_id", "n", place.alias("place"), right.alias("from_right"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 16")
def t06_first_warnings(spark, sf_dir):
    """The first 16 of each: the cap is the feature."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", n).where("n <= 16").select("user_id", "event_id", "value")


@query("(SELECT doc_id, true AS positive FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 80) UNION ALL (SELECT doc_id, false FROM labels WHERE toxic = 0 ORDER BY doc_id LIMIT 20)")
def t07_positives_and_negatives(spark, sf_dir):
    """The first 80 positive and 20 negative records: the limit is the feature."""
    pick = lambda v, n: table(spark, sf_dir, "labels").where(F.col("toxic") == v).orderBy("doc_id").limit(n).select("doc_id", F.lit(bool(v)).alias("positive"))
    return pick(1, 80).unionByName(pick(0, 20))


@query(_with(f"SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY start, {order_sql('label')}, n) AS place FROM p", SPANS))
def t08_line_and_entity_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", detect.entity_order(F.col("label")), "n"))
    return spark_table(spark, sf_dir, SPANS).select("doc_id", "n", place.alias("place"))


# Set operations


@query(_with(f"SELECT doc_id, s AS start, e AS \"end\", 'deterministic_rules_v1' AS detector FROM ({core_sql('p')}) UNION ALL SELECT doc_id, s, e, 'policy_exact_terms_v1' FROM ({_terms_sql()})"))
def u01_union_findings(spark, sf_dir):
    p = parts(spark, sf_dir)
    both = [p.withColumn("findings", f) for f in (detect.core_findings(F.col("text")), detect.exact_findings(F.col("text"), TERMS))]
    return detect.exploded(both[0]).unionByName(detect.exploded(both[1])).select("doc_id", "start", "end", "detector")


@query(_with("SELECT doc_id, start, stop, label, arg_min(side, n) AS side FROM p GROUP BY doc_id, start, stop, label", SPANS))
def u02_first_wins_union(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("doc_id", "start", "stop", "label").orderBy("n"))
    return spark_table(spark, sf_dir, SPANS).withColumn("first_one", n).where("first_one = 1").select("doc_id", "start", "stop", "label", "side")


@query("(SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT p_partkey FROM part)")
def u03_set_differences(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey")
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return a.subtract(b).unionByName(b.subtract(a))


@query(f"{_BOTH} SELECT id, label, pos FROM (SELECT id, label, unnest(range(start, stop))::INT AS pos FROM g) INTERSECT SELECT id, label, unnest(range(start, stop))::INT FROM q")
def u04_character_sets(spark, sf_dir):
    gold, predictions = _gold(spark, sf_dir)
    at = lambda d: scoring.spans_of(d).select("id", "label", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return at(gold).intersect(at(predictions))


@query(f'{_BOTH} SELECT id, label, start, stop AS "end" FROM g INTERSECT ALL SELECT id, label, start, stop FROM q')
def u05_multiset_intersection(spark, sf_dir):
    gold, predictions = _gold(spark, sf_dir)
    return scoring.spans_of(gold).intersectAll(scoring.spans_of(predictions))


@query(f"{_BOTH} SELECT id FROM q WHERE id::BIGINT % 11 <> 0 AND false UNION ALL SELECT DISTINCT id FROM g WHERE id::BIGINT % 7 = 0")
def u06_unknown_ids(spark, sf_dir):
    """Ids on one side only; here the sides change places, so there are some."""
    gold, predictions = _gold(spark, sf_dir)
    return scoring.unknown_ids(predictions, gold)


# Redaction, verification, review


@query(_with(f"SELECT doc_id, redacted FROM ({_REDACTED}) WHERE error_code IS NULL"))
def r01_redact(spark, sf_dir):
    return _redacted(spark, sf_dir).where("error_code IS NULL").select("doc_id", "redacted")


@query(_with(f"""SELECT DISTINCT c.doc_id, x.s AS start, x.e AS "end", c.entity_type FROM (SELECT doc_id, v, entity_type, unnest(list_transform(range(1, len(string_split(text, v))), lambda i: struct_pack(s := (list_sum(list_transform(string_split(text, v)[1:i], lambda y: length(y))) + (i - 1) * length(v))::INT, e := (list_sum(list_transform(string_split(text, v)[1:i], lambda y: length(y))) + i * length(v))::INT))) AS x FROM ({core_sql('p')}) JOIN p USING (doc_id)) c"""))
def r02_target_residuals(spark, sf_dir):
    """Of texts left as they are: every selected value remains, at each of its places."""
    scanned = redact.scan(parts(spark, sf_dir), Policy())
    left = scanned.select("doc_id", F.explode(redact.target_residuals(F.col("text"), F.col("findings"))).alias("r"))
    return left.select("doc_id", "r.start", "r.end", "r.entity_type")


_AGAIN = f"SELECT doc_id, redacted AS text FROM ({_REDACTED}) WHERE error_code IS NULL"


@query(f"WITH p AS ({duck(PARTS)}), o AS ({_AGAIN}) SELECT {_FOUND_SQL} FROM ({core_sql('o')})")
def r03_rescan(spark, sf_dir):
    """What the rules find in the redacted texts."""
    out = _redacted(spark, sf_dir).where("error_code IS NULL").select("doc_id", F.col("redacted").alias("text"))
    return detect.exploded(detect.detect_rules(out)).select(*FOUND)


@query(_with(f"""SELECT page_id, line_index, entity_type, CASE WHEN sure THEN 'target_value_check' ELSE '{rules.RULES_DETECTOR}' END AS detector, CASE WHEN sure THEN 'SELECTED_VALUE_REMAINS' ELSE code END AS explanation_code
    FROM (SELECT doc_id AS page_id, 0 AS line_index, entity_type, arg_min(code, s) AS code, bool_or(score >= {Policy().image_mask.auto_apply_min_ocr_confidence}::FLOAT) AS sure FROM ({core_sql('(SELECT page_id AS doc_id, text FROM p)')}) c JOIN p ON p.page_id = c.doc_id WHERE page_id % 2 = 0 GROUP BY ALL)""", LINES))
def r04_image_rescan(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    pages = lines.select("page_id", F.lit(600).alias("width"), F.lit(700).alias("height"))
    found = ocr.scan_pages(lines, pages, Policy())
    after = lines.where("page_id % 2 = 0")
    return ocr.page_residuals(found, after, Policy()).select("page_id", "line_index", "entity_type", "detector", "explanation_code")


_DECISIONS = "SELECT l_orderkey AS doc_id, l_linenumber AS n, l_linenumber % 2 = 0 AS selected, CASE WHEN l_suppkey % 5 = 0 THEN concat('R', cast(l_suppkey AS string)) END AS replacement FROM {lineitem} WHERE l_partkey % 3 = 0"


@query(f"""WITH p AS ({duck(SPANS)}), d AS ({duck(_DECISIONS)}) SELECT p.doc_id, p.n, coalesce(d.selected, p.side = 'R') AS selected, coalesce(d.replacement, p.label) AS replacement, d.n IS NOT NULL AS reviewed FROM p LEFT JOIN d ON p.doc_id = d.doc_id AND p.n = d.n""")
def r05_review_decisions(spark, sf_dir):
    t = spark_table(spark, sf_dir, SPANS).select("doc_id", "n", (F.col("side") == "R").alias("selected"), F.col("label").alias("replacement"), F.lit(False).alias("reviewed"))
    return redact.review(t, spark_table(spark, sf_dir, _DECISIONS), ("doc_id", "n"))


_CELLS = "SELECT l_orderkey AS doc_id, concat('f', cast(l_linenumber AS string)) AS finding_id, CASE l_linenumber % 3 WHEN 0 THEN 'formula' WHEN 1 THEN 'formula_cache' ELSE 'cell' END AS kind, concat('s#cell=A', cast(l_partkey % 2 AS string), CASE l_linenumber % 3 WHEN 0 THEN '/formula' WHEN 1 THEN '/cache' ELSE '' END) AS locator FROM {lineitem}"


@query(_with("""SELECT a.doc_id, a.finding_id, CASE WHEN a.kind <> 'cell' THEN EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.finding_id = 'f1' AND split_part(b.locator, '/', 1) = split_part(a.locator, '/', 1)) ELSE false END AS reviewed FROM p a""", _CELLS))
def r06_review_cells(spark, sf_dir):
    t = spark_table(spark, sf_dir, _CELLS).withColumns({"selected": F.lit(False), "reviewed": F.lit(False), "replacement": F.lit("")})
    decisions = t.where("finding_id = 'f1'").select("doc_id", "finding_id", F.lit(True).alias("selected"), F.lit("x").alias("replacement"))
    return redact.review_cells(t, decisions).select("doc_id", "finding_id", "reviewed")


@query("SELECT l_orderkey AS page_id, l_linenumber AS n, (l_linestatus = 'F') OR l_returnflag = 'R' AS selected, l_linestatus = 'F' AS reviewed FROM lineitem")
def r07_review_groups(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    t = l.select(F.col("l_orderkey").alias("page_id"), F.col("l_linestatus").alias("group_id"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("selected"), F.lit(False).alias("reviewed"))
    decisions = t.where("group_id = 'F'").select("page_id", "group_id", F.lit(True).alias("selected")).distinct()
    return redact.review_groups(t, decisions).select("page_id", "n", "selected", "reviewed")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a < b THEN substr(c, 1, a) || CASE WHEN first_one THEN '[X]' ELSE '' END || substr(c, b + 1) ELSE c END AS slot FROM (SELECT *, min(CASE WHEN a < b THEN l_linenumber END) OVER (PARTITION BY l_orderkey) = l_linenumber AS first_one FROM (SELECT *, greatest(10 - begins, 0) AS a, least(40 - begins, length(c)) AS b FROM (SELECT l_orderkey, l_linenumber, l_comment AS c, coalesce(sum(length(l_comment)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS begins FROM lineitem)))")
def r08_cross_run_rewrite(spark, sf_dir):
    """One span (10 to 40) over the runs of each paragraph: the first run takes the replacement, the others lose their signs."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    at = F.coalesce(F.sum(F.length("l_comment")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    t = table(spark, sf_dir, "lineitem").withColumn("at", at).withColumn("a", F.greatest(10 - F.col("at"), F.lit(0))).withColumn("b", F.least(40 - F.col("at"), F.length("l_comment")))
    first = F.min(F.when(F.col("a") < F.col("b"), F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey")) == F.col("l_linenumber")
    new = scalars.splice(F.col("l_comment"), F.col("a"), F.col("b"), F.when(F.col("first_one"), "[X]").otherwise(""))
    return t.withColumn("first_one", first).select("l_orderkey", "l_linenumber", F.when(F.col("a") < F.col("b"), new).otherwise(F.col("l_comment")).alias("slot"))


_PROBE = "concat('%PDF-1.7 ', CASE WHEN p_partkey % 2 = 0 THEN '/Type /Page /Annots [] ' ELSE '/JSX ' END, CASE WHEN p_partkey % 3 = 0 THEN '/JS (x) ' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '/Encrypt 1' ELSE '' END)"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'PDF_ENCRYPTED' END AS error_code, (p_partkey % 2 = 0)::INT AS pages, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'PDF_ANNOTATIONS' END, CASE WHEN p_partkey % 3 = 0 THEN 'PDF_JAVASCRIPT' END], lambda x: x IS NOT NULL) AS diagnostics FROM part")
def s19_pdf_probe(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_PROBE).cast("binary").alias("content"))
    return files.pdf_probe(t).select(F.col("path").cast("long").alias("p_partkey"), "error_code", "pages", "diagnostics")


@query("SELECT doc_id, doc_id % 3 <> 0 AS unchanged FROM documents")
def r16_source_changed(spark, sf_dir):
    from ..operators import sinks

    d = table(spark, sf_dir, "documents")
    tasks = d.select("doc_id", scalars.sha256_hex(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return sinks.source_unchanged(tasks, d).select("doc_id", "unchanged")


@query("SELECT DISTINCT user_id AS doc_id, event_type AS detector_id, 'warning' AS severity, CASE WHEN event_id % 3 = 0 THEN 'MODEL_CONFIDENCE_UNCALIBRATED' ELSE 'MODEL_RUNTIME_WARNING' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE place < 16")
def r17_warning_diagnostics(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("detector_id"), place.alias("place"), F.when(F.col("event_id") % 3 == 0, models.UNCALIBRATED[0]).otherwise("some text").alias("warning"))
    return models.warning_diagnostics(e)


_TASKS = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'scanned' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'exporting' WHEN 5 THEN 'exported' ELSE 'export_failed' END AS event, o_custkey % 2 AS unreviewed FROM {orders}"


@query(_with("SELECT id, CASE event WHEN 'queued' THEN 'queued' WHEN 'failed' THEN 'blocked' WHEN 'cancelled' THEN 'cancelled' WHEN 'scanned' THEN CASE WHEN unreviewed > 0 THEN 'review_required' ELSE 'ready_to_export' END WHEN 'exporting' THEN 'exporting' WHEN 'exported' THEN 'complete' ELSE 'export_failed' END AS status FROM p", _TASKS))
def r18_scan_states(spark, sf_dir):
    from ..operators import desktop

    return desktop.scan_states(spark_table(spark, sf_dir, _TASKS)).select("id", "status")


# Generators


@query(_with("SELECT doc_id, text FROM p", ZH))
def g03_synthetic_cases(spark, sf_dir):
    return spark_table(spark, sf_dir, ZH)


@query(_with("SELECT k, cn_id, card, dated FROM p", _NUMBERS))
def g02_synthetic_values(spark, sf_dir):
    return spark_table(spark, sf_dir, _NUMBERS)


@query("SELECT o_orderkey, o_orderpriority || '：' || 'Clerk#' || o_custkey || '，' || o_orderstatus AS text, length(o_orderpriority) + 1 AS start, length(o_orderpriority) + 1 + length('Clerk#' || o_custkey) AS \"end\" FROM orders")
def g01_composed_text(spark, sf_dir):
    """Pieces of text, some with a label: the text and the span of the labelled piece."""
    from ..operators import generate

    pieces = F.array(generate.piece(F.col("o_orderpriority")), generate.piece(F.lit("：")), generate.piece(F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")), "PERSON_NAME"), generate.piece(F.lit("，")), generate.piece(F.col("o_orderstatus")))
    made = table(spark, sf_dir, "orders").select("o_orderkey", generate.compose(pieces).alias("m"))
    return made.select("o_orderkey", "m.text", F.col("m.entities")[0]["start"].alias("start"), F.col("m.entities")[0]["end"].alias("end"))


# Sinks


@query("SELECT id, CASE WHEN n = 1 THEN stem || '_redacted.txt' ELSE stem || '_redacted_' || n || '.txt' END AS output_name FROM (SELECT o_orderkey AS id, 's' || o_custkey AS stem, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM orders)")
def k08_output_names(spark, sf_dir):
    """Names of copies; those of even customers find their first name taken."""
    from ..operators import desktop

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("stem"), F.lit("txt").alias("extension"), "o_custkey")
    taken = o.where("o_custkey % 2 = 0").select(F.concat("stem", F.lit("_redacted.txt")).alias("name")).distinct()
    return desktop.output_names(o, taken)


#: Selected values that outputs still hold, and what the rules find in outputs; places count once.
_VERIFIED = f"""SELECT o.doc_id, coalesce(n_left, 0) = 0 AS passed, false AS complete, error_code, coalesce(n, 0)::INT AS selected_findings, 0 AS unreviewed_findings, coalesce(n_targets, 0)::INT AS target_residual_count, coalesce(n_left, 0)::INT AS residual_count, sha256(o.text) AS output_sha256
    FROM o LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_left, count(*) FILTER (target) AS n_targets FROM (
        SELECT doc_id, s, e, entity_type, bool_or(target) AS target FROM (SELECT doc_id, s, e, entity_type, target FROM t UNION ALL SELECT doc_id, s, e, entity_type, false FROM ({core_sql("o")})) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"""
_VERIFIED = f"""SELECT * FROM (WITH c AS ({core_sql("p")}), o AS (SELECT doc_id, coalesce(redacted, '') AS text, error_code FROM ({_REDACTED})),
    t AS (SELECT doc_id, place::INT AS s, (place + length(v))::INT AS e, entity_type, true AS target FROM (SELECT doc_id, v, entity_type, unnest(list_transform(range(1, len(x)), lambda k: list_sum(list_transform(x[1:k], lambda y: length(y))) + (k - 1) * length(v))) AS place
        FROM (SELECT DISTINCT o.doc_id, v, entity_type, string_split(text, v) AS x FROM o JOIN c USING (doc_id) WHERE contains(text, v)))) {_VERIFIED})"""


@query(_with(f"SELECT v.doc_id, r.redacted FROM ({_VERIFIED}) v JOIN ({_REDACTED}) r USING (doc_id) WHERE passed AND v.error_code IS NULL"))
def k02_rendered(spark, sf_dir):
    """All documents and synthetic texts behind their check, without those that it holds back."""
    from ..operators import sinks

    return sinks.rendered(redact.redact_and_verify(parts(spark, sf_dir), Policy()))


_DRAFTS = f"""SELECT p.doc_id, to_json(struct_pack(schema_version := 3, task_id := 'task-' || substr(sha256(text), 1, 12), policy_id := 'default-high-recall', text := text, findings := coalesce(f, []), contains_sensitive_plaintext := true))::VARCHAR AS draft
    FROM p LEFT JOIN (SELECT doc_id, list(struct_pack(start := s, "end" := e, entity_type := entity_type, matched_text := v, detector := '{rules.RULES_DETECTOR}', confidence := 1.0::FLOAT, explanation_code := code, selected := true, reviewed := true, replacement := {placeholder_sql("entity_type")}, rule_ord := rule_ord) ORDER BY s, e, rule_ord) AS f
        FROM ({core_sql("p")}) GROUP BY doc_id) USING (doc_id)"""


@query(_with(_DRAFTS))
def k06_drafts(spark, sf_dir):
    from ..operators import sinks

    return sinks.drafts(redact.scan(parts(spark, sf_dir), Policy()), "default-high-recall")


@query(f"""{_BOTH} SELECT 0 AS place, '| dimension | value | precision | recall | F1 |' AS line UNION ALL SELECT 1, '| --- | --- | ---: | ---: | ---: |'
    UNION ALL SELECT (row_number() OVER (ORDER BY dimension, value))::INT + 1, printf('| %s | %s | %.2f%% | %.2f%% | %.2f%% |', dimension, value, precision * 100, recall * 100, f1 * 100) FROM ({_measures_sql(_GROUPS, "dimension, value")})""")
def k07_markdown_report(spark, sf_dir):
    return scoring.report_markdown(scoring.grouped(*_gold(spark, sf_dir)))


@query(_with(_VERIFIED))
def verified_redaction(spark, sf_dir):
    """The whole text workflow: scan, redact, check; reports without values."""
    from ..operators import sinks

    return sinks.reports(redact.redact_and_verify(parts(spark, sf_dir), Policy())).drop("residuals")


# Pages and packages made from the driver's tables


@query(_with("SELECT page_id, 'INVALID_OCR_LINE' AS code FROM p WHERE page_id % 6 = 0 OR page_id % 10 = 3 OR x1 > 600", LINES))
def s07_ocr_line_errors(spark, sf_dir):
    """Pages of which one line is empty, or has an impossible score or box."""
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("page_id") % 6 == 0, "").otherwise(F.col("text")))
    lines = lines.withColumn("score", F.when(F.col("page_id") % 10 == 3, 1.5).otherwise(F.col("score")).cast("float"))
    pages = lines.select("page_id", F.lit(600).alias("width"), F.lit(700).alias("height"))
    return ocr.line_errors(pages, lines)


_SURE = f"score >= {Policy().image_mask.auto_apply_min_ocr_confidence}::FLOAT"
#: Findings of lines with their place in the text, and the boxes over them as in f14 and f15.
_IN_LINES = f"SELECT p.*, s, e, entity_type, v, code, row_number() OVER (PARTITION BY page_id ORDER BY s, e, rule_ord) AS k FROM p JOIN ({core_sql('(SELECT page_id AS doc_id, text FROM p)')}) c ON c.doc_id = p.page_id"
_BOXED = _PART_SQL.replace("substr(text, 1, 4)", "substr(text, 1, s)").replace("substr(text, 1, 12)", "substr(text, 1, e)").replace("length(text) >= 12", "true").replace("FROM p)", f"FROM ({_IN_LINES}))")
_MASKS = f"""SELECT page_id, printf('image-group-%04d', k) AS group_id, printf('image-finding-%04d', row_number() OVER (PARTITION BY page_id ORDER BY line_index, {order_sql("entity_type")}, k)) AS finding_id, entity_type,
    greatest(px0 - mx, 0) AS x0, greatest(py0 - my, 0) AS y0, least(px1 + mx, 600) AS x1, least(py1 + my, 700) AS y1, {_SURE} AS selected, {_SURE} AS reviewed
    FROM (SELECT *, CASE WHEN w >= h THEN 4 + (h + 1) // 2 ELSE 4 END AS mx, CASE WHEN w >= h THEN 4 ELSE 4 + (w + 1) // 2 END AS my FROM ({_BOXED}))"""


@query(_with(_MASKS, LINES))
def p11_mask_projection(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    pages = lines.select("page_id", F.lit(600).alias("width"), F.lit(700).alias("height"))
    return ocr.mask_projection(ocr.scan_pages(lines, pages, Policy())).select("page_id", "group_id", "finding_id", "entity_type", "mask_rect.*", "selected", "reviewed")


def made_packages(spark: SparkSession, sf_dir: str, kind: str, picture: bytes = b"png") -> DataFrame:
    """One small package for each synthetic text: its first signs in one run, the others in another, and a picture."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pyarrow as pa

    from ..sources.packages import REQUIRED, ROOTS

    def entries(text: str) -> dict[str, str]:
        a, b = escape(text[:8]), escape(text[8:])
        if kind == "docx":
            return {REQUIRED[kind]: f"<w:document><w:p><w:r><w:t>{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p></w:document>"}
        if kind == "pptx":
            return {REQUIRED[kind]: "<p:presentation/>", "ppt/slides/slide1.xml": f"<p:sld><a:p><a:r><a:t>{a}</a:t></a:r><a:r><a:t>{b}</a:t></a:r></a:p></p:sld>"}
        shared = f"<sst><si><r><t>{a}</t></r><r><t>{b}</t></r></si></sst>"
        return {REQUIRED[kind]: '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>'}

    def build(batches):
        for batch in batches:
            made = []
            for text in batch.column(1):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("[Content_Types].xml", "<Types/>")
                    z.writestr("_rels/.rels", "<Relationships/>")
                    for name, data in entries(text.as_py()).items():
                        z.writestr(name, data)
                    z.writestr(f"{ROOTS[kind]}/media/image1.png", picture)
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * batch.num_rows), pa.array(made, pa.binary())], names=["doc_id", "format", "content"])

    return parts(spark, sf_dir, ZH).mapInArrow(build, "doc_id long, format string, content binary")


def _package_parts(key: str, kind: str, oracle: str) -> None:
    def run(spark, sf_dir):
        from ..sources import packages

        return packages.package_parts(made_packages(spark, sf_dir, kind)).where("kind <> 'sheet_name'").select("doc_id", "kind", "locator", "text")

    run.__name__ = key
    query(_with(oracle, ZH))(run)


# texts with carriage returns lose them in XML, which reads them as line breaks
_XML_TEXT = "replace(text, chr(13) || chr(10), chr(10)) AS text"
_package_parts("s08_docx_parts", "docx", f"SELECT doc_id, 'body' AS kind, 'word/document.xml#p000001' AS locator, {_XML_TEXT} FROM p")
_package_parts("s09_xlsx_parts", "xlsx", f"SELECT doc_id, 'cell' AS kind, 'xl/worksheets/sheet1.xml#cell=A1' AS locator, {_XML_TEXT} FROM p")
_package_parts("s10_pptx_parts", "pptx", f"SELECT doc_id, 'slide' AS kind, 'ppt/slides/slide1.xml#p000001' AS locator, {_XML_TEXT} FROM p")


@query(_with("SELECT doc_id, 'word/media/image1.png' AS entry_name, 'docx://' || doc_id || '#word/media/image1.png' AS path, 3::BIGINT AS size_bytes FROM p", ZH))
def s12_embedded_images(spark, sf_dir):
    from ..sources import packages

    found = packages.embedded_images(made_packages(spark, sf_dir, "docx"))
    return found.select("doc_id", "entry_name", "path", F.length("content").cast("long").alias("size_bytes"))


#: Line ends of XML are line feeds.
_XML = "(SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM p)"
_PACKAGES = f"""SELECT o.doc_id, error_code, error_code IS NULL AS metadata_scrubbed, CASE WHEN error_code IS NULL THEN coalesce(n, 0) ELSE -1 END AS "left" FROM (WITH p AS {_XML} {_REDACTED}) o
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({core_sql(f"(WITH p AS {_XML} SELECT doc_id, redacted AS text FROM ({_REDACTED}))")}) GROUP BY doc_id) USING (doc_id)"""


@query(_with(_PACKAGES, ZH))
def k04_redacted_packages(spark, sf_dir):
    """Packages scanned, rewritten and read again: how many findings each had and has."""
    from ..sources import packages

    made = made_packages(spark, sf_dir, "docx", small_picture())
    found = detect.exploded(redact.scan(packages.package_parts(made), Policy()), keys=("doc_id", "locator"))
    out = packages.redact_packages(made, found.where("selected"), masked_images(made))
    again = packages.package_parts(out.where("error_code IS NULL").select("doc_id", "format", F.col("redacted").alias("content")))
    left = redact.scan(again, Policy()).groupBy("doc_id").agg(F.sum(F.size("findings")).alias("left"))
    return out.select("doc_id", "error_code", "metadata_scrubbed").join(left, "doc_id", "left").withColumn("left", F.coalesce("left", F.lit(-1)))


def small_picture() -> bytes:
    import numpy as np

    from ..sources import rasters

    return rasters.encode(np.full((12, 16, 3), 255, np.uint8))


def masked_images(made: DataFrame) -> DataFrame:
    """The pictures of packages with a box painted: doc_id, entry_name, redacted."""
    from ..sources import packages, rasters

    pictures = packages.embedded_images(made)
    box = {"x0": F.lit(2), "y0": F.lit(3), "x1": F.lit(9), "y1": F.lit(8)}
    done = rasters.mask_pictures(pictures, pictures.select("path").withColumns(box))
    return done.join(pictures.select("path", "doc_id", "entry_name"), "path")
