"""Registered queries over pictures, PDFs, packages and what stands between a checked text and its export."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generate, policy, redact, sinks
from ..operators.policy import Policy
from ..sources import files, packages, rasters
from .catalog import _REDACTED, _VERIFIED, _XML, _with, made_packages, masked_images, parts, query, small_picture, table, weight_sql
from .inputs import ZH, core_sql


def _made(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """rows (key, ...) as key, content."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, f"{key} long, content binary")


def _pixels(pictures: DataFrame) -> DataFrame:
    """(key, content) as key, width, height, black, white."""
    key = pictures.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [rasters.decode(c) for c in batch.column(1).to_pylist()]
            numbers = [[p.shape[1], p.shape[0], int((p == 0).all(axis=2).sum()), int((p == 255).all(axis=2).sum())] for p in seen]
            columns = list(zip(*numbers, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], names=[key, "width", "height", "black", "white"])

    return pictures.mapInArrow(run, f"{key} long, width long, height long, black long, white long")


def _pictures(spark, sf_dir) -> DataFrame:
    """White pictures of 20 to 49 by 15 to 34 pixels, one for each customer."""
    return _made(table(spark, sf_dir, "customer").select("c_custkey"), lambda k: rasters.encode(np.full((15 + k % 20, 20 + k % 30, 1 + k % 4), 255, np.uint8)))


_W, _H, _BW, _BH = "(20 + c_custkey % 30)", "(15 + c_custkey % 20)", "(1 + c_custkey % 15)", "(1 + c_custkey % 10)"


@query(f"SELECT c_custkey, {_W} AS width, {_H} AS height, CASE WHEN c_custkey % 4 IN (1, 3) THEN 0 ELSE {_BW} * {_BH} END AS black, {_W} * {_H} - {_BW} * {_BH} AS white FROM customer")
def r13_masked_pixels(spark, sf_dir):
    """Pictures of one to four samples with a box painted; with an alpha channel a painted pixel isn't all zero."""
    made = _pictures(spark, sf_dir)
    k = F.col("c_custkey").cast("int")
    boxes = made.select("c_custkey", F.lit(2).alias("x0"), F.lit(3).alias("y0"), (3 + k % 15).alias("x1"), (4 + k % 10).alias("y1"))
    return _pixels(rasters.mask_pictures(made, boxes, "c_custkey").select("c_custkey", F.col("redacted").alias("content")))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'INVALID_MASK' WHEN c_custkey % 7 = 0 THEN 'UNSUPPORTED_IMAGE' END AS error_code, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN '89504E470D0A1A0A' END AS head FROM customer""")
def k03_masked_images(spark, sf_dir):
    """Export of pictures: a mask outside of one and a file that is none are errors of their own rows."""
    made = _pictures(spark, sf_dir).withColumn("content", F.expr("CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 <> 0 THEN cast('GIF89a' AS binary) ELSE content END"))
    boxes = made.select("c_custkey", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 100 ELSE 5 END").alias("x1"), F.lit(5).alias("y1"))
    out = rasters.mask_pictures(made, boxes, "c_custkey")
    return out.select("c_custkey", "error_code", F.hex(F.expr("substring(redacted, 1, 8)")).alias("head"))


@query(f"SELECT c_custkey, CASE WHEN m <= 24 THEN {_W} ELSE greatest({_W} * 24 // m, 1) END AS width, CASE WHEN m <= 24 THEN {_H} ELSE greatest({_H} * 24 // m, 1) END AS height FROM (SELECT *, greatest({_W}, {_H}) AS m FROM customer)")
def r15_previews(spark, sf_dir):
    made = rasters.previews(_pictures(spark, sf_dir), "c_custkey", 24)
    return _pixels(made.select("c_custkey", F.col("redacted").alias("content"))).select("c_custkey", "width", "height")


def _jpeg(k: int, page: int) -> bytes:
    """The frame of a JPEG, which is all that a PDF's structure asks for; every seventh is cut short."""
    frame = b"\xff\xc0\x00\x11\x08" + (100 + page).to_bytes(2, "big") + (200 + k % 50).to_bytes(2, "big") + b"\x03" + bytes(9)
    return b"\xff\xd8" + frame + bytes(16) + (b"" if k % 7 == 0 else b"\xff\xd9")


def _pdfs(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c_custkey") % 3 + 1)).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_jpeg(k, p) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["c_custkey", "page", "content"])

    return rasters.page_pdfs(pages.mapInArrow(run, "c_custkey long, page long, content binary"), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'UNSUPPORTED_IMAGE' END AS error_code, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 + 1 ELSE 0 END AS pages, 0 AS diagnostics FROM customer")
def k05_page_pdfs(spark, sf_dir):
    """PDFs of JPEG pages, read again by the probe."""
    made = _pdfs(spark, sf_dir)
    probed = files.pdf_probe(made.select(F.col("c_custkey").alias("path"), F.col("redacted").alias("content")))
    probed = probed.select(F.col("path").alias("c_custkey"), F.col("pages").cast("long").alias("pages"), F.size("diagnostics").alias("n"))
    return made.select("c_custkey", "error_code").join(probed, "c_custkey").select("c_custkey", "error_code", F.coalesce("pages", F.lit(0)).alias("pages"), F.greatest("n", F.lit(0)).alias("diagnostics"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS safe FROM customer WHERE c_custkey % 7 <> 0")
def r14_safe_structures(spark, sf_dir):
    """PDFs of pictures, as they are or with a script, a foreign name or a tail in a stream."""
    made = _pdfs(spark, sf_dir).where("error_code IS NULL")
    text = F.decode("redacted", "ISO-8859-1")
    worse = F.when(F.col("c_custkey") % 4 == 1, F.replace(text, F.lit("/Catalog"), F.lit("/Catalog /JavaScript 9 0 R"))).when(F.col("c_custkey") % 4 == 2, F.replace(text, F.lit("/Count"), F.lit("/Foreign 1 /Count"))).when(F.col("c_custkey") % 4 == 3, F.replace(text, F.lit("/Im0 Do Q"), F.lit("/Im0 Do q"))).otherwise(text)
    return files.safe_structures(made.select("c_custkey", F.encode(worse, "ISO-8859-1").alias("content")), "c_custkey")


#: Leaks that are planted in packages, with the code of each.
_LEAKS = (
    ("docProps/core.xml", "<c:coreProperties xmlns:c='c' xmlns:d='d'><d:creator>Somebody</d:creator></c:coreProperties>", "CORE_PROPERTY"),
    ("docProps/app.xml", "<Properties><Company>Some</Company></Properties>", "APP_PROPERTY"),
    ("word/comments.xml", '<w:comments xmlns:w="w"><w:comment w:author="Somebody" w:date="2000-01-01T00:00:00Z"/></w:comments>', "AUTHOR"),
    ("word/footer1.xml", '<w:ftr xmlns:w="w"><w:ins w:author="Author" w:date="2024-05-06T00:00:00Z"/></w:ftr>', "DATE"),
    ("word/header1.xml", '<w:hdr xmlns:w="w" w:rsidR="00A1"/>', "REVISION_ID"),
    ("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r" TargetMode="External" Target="https://h/x"/></Relationships>', "EXTERNAL_TARGET"),
    ("customXml/item1.xml", "<a/>", "DROPPED_ENTRY"),
    ("word/settings.xml", '<w:settings xmlns:w="w"><w:docVars><w:docVar/></w:docVars></w:settings>', "DOCUMENT_VARIABLES"),
    ("word/styles.xml", "<a/>", None),
)


def _leaky(k: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p/></w:document>')
        z.writestr(*_LEAKS[k % len(_LEAKS)][:2])
        if k % 2:
            z.comment = b"note"
    return out.getvalue()


_CODES = ", ".join(f"'{code}'" if code else "NULL" for *_, code in _LEAKS)


@query(f"SELECT c_custkey, array_to_string(list_sort(list_filter([[{_CODES}][(c_custkey % {len(_LEAKS)} + 1)::INT], CASE WHEN c_custkey % 2 = 1 THEN 'ARCHIVE_COMMENT' END], lambda x: x IS NOT NULL)), ',') AS faults FROM customer")
def r12_metadata_faults(spark, sf_dir):
    """What a parser, apart from the rules that scrub, still finds in packages with planted leaks."""
    made = _made(table(spark, sf_dir, "customer").select("c_custkey"), _leaky)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([",".join(packages.metadata_faults(c)) for c in batch.column(1).to_pylist()], pa.string())], names=["c_custkey", "faults"])

    return made.mapInArrow(run, "c_custkey long, faults string")


_LEFT = f"""SELECT o.doc_id, error_code, coalesce(n, 0) + coalesce(m, 0) AS n_left FROM (WITH p AS {_XML} {_REDACTED}) o
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({core_sql(f"(WITH p AS {_XML} SELECT doc_id, redacted AS text FROM ({_REDACTED}) WHERE error_code IS NULL)")}) GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(DISTINCT v) AS m FROM ({core_sql(_XML)}) JOIN (WITH p AS {_XML} {_REDACTED}) USING (doc_id) WHERE contains(redacted, v) GROUP BY doc_id) USING (doc_id)"""


@query(_with(f"""SELECT doc_id, format, CASE WHEN error_code IS NOT NULL THEN error_code WHEN doc_id % 5 = 0 THEN 'EMBEDDED_IMAGE_NOT_MASKED' WHEN n_left > 0 THEN 'RESIDUALS_REMAIN' END AS error_code,
    CASE WHEN error_code IS NOT NULL OR doc_id % 5 = 0 THEN 0 ELSE n_left END AS residual_count FROM ({_LEFT}), (VALUES ('docx'), ('xlsx'), ('pptx')) AS f(format)""", ZH))
def k04_verified_packages(spark, sf_dir):
    """Documents, workbooks and slides through the whole workflow; of every fifth the picture has no masked one."""
    found = None
    for kind in ("docx", "xlsx", "pptx"):
        made = made_packages(spark, sf_dir, kind, small_picture())
        out = packages.verified_packages(made, Policy(), masked_images(made).where("doc_id % 5 <> 0"))
        found = out if found is None else found.unionByName(out)
    return found.select("doc_id", "format", "error_code", F.col("residual_count").cast("long").alias("residual_count"))


_GATED = f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'SOURCE_CHANGED' WHEN doc_id % 17 = 0 THEN 'OUTPUT_EXISTS' WHEN error_code IS NOT NULL THEN error_code WHEN residual_count > 0 THEN 'RESIDUALS_REMAIN' END AS export_error FROM ({_VERIFIED})"""


def _gated(spark, sf_dir) -> DataFrame:
    """Of the sources every 11th has changed and every 13th is gone; every 17th output is there already."""
    checked = redact.redact_and_verify(parts(spark, sf_dir), Policy())
    sources = parts(spark, sf_dir).where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return sinks.export_gate(checked, sources, parts(spark, sf_dir).where("doc_id % 17 = 0"))


@query(_with(_GATED))
def k01_export_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", "export_error")


@query(_with(f"SELECT coalesce(export_error, 'EXPORTED') AS outcome, count(*) AS n FROM ({_GATED}) GROUP BY ALL"))
def k09_batch_outcomes(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("export_error", F.lit("EXPORTED")).alias("outcome")).agg(F.count("*").alias("n"))


@query(_with(f"SELECT g.doc_id, r.redacted FROM ({_GATED}) g JOIN ({_REDACTED}) r USING (doc_id) WHERE export_error IS NULL"))
def k10_copy_back(spark, sf_dir):
    return sinks.copy_back(_gated(spark, sf_dir))


@query("SELECT c_custkey AS line_number FROM customer WHERE c_custkey % 4 = 1")
def s15_lines_that_fail(spark, sf_dir):
    """JSON lines of which some are blank, some cut short."""
    value = F.expr("CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat('{\"id\": \"', c_custkey) ELSE concat('{\"id\": \"', c_custkey, '\"}') END")
    return files.jsonl_errors(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_number"), value.alias("value")), "id string")


_ORDERED = sorted(Policy().detectors, key=lambda d: -d.priority)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d.id}', {d.priority})" for i, d in enumerate(_ORDERED)) + ") AS t(place, detector_id, priority)")
def t03_detector_order(spark, sf_dir):
    return policy.detector_order(spark, Policy())


_STORY_NAMES = ("word/footer2.xml", "word/document.xml", "word/comments.xml", "word/header1.xml", "word/footnotes.xml", "word/charts/chart1.xml", "word/endnotes.xml", "word/footer1.xml", "word/styles.xml", "word/_rels/document.xml.rels")


@query("SELECT c_custkey, unnest(['word/document.xml', 'word/header1.xml', 'word/footer1.xml', 'word/footer2.xml', 'word/footnotes.xml', 'word/endnotes.xml', 'word/comments.xml', 'word/charts/chart1.xml']) AS entry_name, unnest(range(8))::INT AS place FROM customer")
def t05_story_order(spark, sf_dir):
    """Entries that hold text, by the order of their kind and then by name, whatever their order in the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, name, i) for k in batch.column(0).to_pylist() for i, (_, name, *_) in enumerate(packages.stories([*_STORY_NAMES[k % 10 :], *_STORY_NAMES[: k % 10]], "docx"))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["c_custkey", "entry_name", "place"])

    return table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(run, "c_custkey long, entry_name string, place int")


def _wide_sql(text: str) -> str:
    return f"round({weight_sql(text)} * 15)::INT"


@query(_with(f"""SELECT doc_id, start, line, 64 AS x0, (54 + (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) * 40)::INT AS y0, 64 + {_wide_sql("line")} AS x1 FROM (
    SELECT doc_id, x.start AS start, x.line AS line FROM (SELECT doc_id, unnest(flatten(list_transform(range(1, len(lines) + 1), lambda i: list_transform(range(0, (length(lines[i]) + 27) // 28), lambda k: struct_pack(start := (coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0) + k * 28)::INT, line := substr(lines[i], k * 28 + 1, 28)))))) AS x
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM p)))""", ZH))
def g04_page_lines(spark, sf_dir):
    cases = parts(spark, sf_dir, ZH).select(F.col("doc_id").cast("string").alias("id"), "text", F.array().cast(f"array<{generate.ENTITY}>").alias("entities"), F.array().cast("array<string>").alias("tags"))
    lines = generate.page_manifest(cases).select(F.col("source_id").cast("long").alias("doc_id"), F.explode("line_regions").alias("r"))
    return lines.select("doc_id", "r.start", F.col("r.text").alias("line"), "r.bbox.x0", "r.bbox.y0", "r.bbox.x1")


@query(_with(f"""SELECT doc_id, s AS start, e AS "end", v AS text, 64 + {_wide_sql("substr(text, line_start + 1, s - line_start)")} AS x0, 64 + {_wide_sql("substr(text, line_start + 1, s - line_start)")} + {_wide_sql("v")} AS x1
    FROM (SELECT c.*, p.text, s // 28 * 28 AS line_start FROM ({core_sql("p", ("email", "cn_id"))}) c JOIN p USING (doc_id) WHERE NOT contains(p.text, chr(10)) AND s // 28 = (e - 1) // 28)""", ZH))
def g04_page_fragments(spark, sf_dir):
    """Boxes of e-mails and resident numbers that lie on one line of a page."""
    from ..operators import detect

    found = F.concat(*[detect.core_rule(F.col("text"), n) for n in ("email", "cn_id")])
    entity = lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["entity_type"].alias("label"), f["matched_text"].alias("text"))
    p = detect.settled(parts(spark, sf_dir, ZH).where(~F.contains("text", F.lit("\n"))), "found", found)
    cases = p.select(F.col("doc_id").cast("string").alias("id"), "text", F.transform("found", entity).alias("entities"), F.array().cast("array<string>").alias("tags"))
    regions = generate.page_manifest(cases).select(F.col("source_id").cast("long").alias("doc_id"), F.explode("sensitive_regions").alias("r")).select("doc_id", "r.*")
    whole = p.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.start", "f.end")
    return regions.join(whole, ["doc_id", "start", "end"]).select("doc_id", "start", "end", "text", "bbox.x0", "bbox.x1")


