import io
import zipfile

from pyspark.sql import functions as F

from veilwright.operators import detect
from veilwright.operators.policy import Policy, apply_policy
from veilwright.sources import files, packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(**extra):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types></Types>")
        z.writestr("_rels/.rels", "<Relationships></Relationships>")
        body = "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in ("手机138", "0000", "0001 &amp; 完"))
        z.writestr("word/document.xml", f'<w:document {W}><w:p></w:p><w:p w:rsidR="1">{body}</w:p></w:document>')
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>a@example.com </w:t></w:r></w:p></w:hdr>")
        z.writestr("docProps/core.xml", "<cp:coreProperties><dc:creator>Somebody</dc:creator></cp:coreProperties>")
        for name, data in extra.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types></Types>")
        z.writestr("_rels/.rels", "<Relationships></Relationships>")
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>手机13800000001</t></si><si><t>kept</t></si></sst>")
        cells = '<c r="A1" s="3" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="str"><f>"b@example.com"</f><v>b@example.com</v></c>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>")
    return out.getvalue()


def scanned(spark, kind, content):
    df = spark.createDataFrame([(1, kind, bytearray(content))], "doc_id long, format string, content binary")
    parts = packages.package_parts(df)
    found = detect.detect_rules(parts).withColumn("findings", apply_policy(F.col("findings"), Policy()))
    return df, parts, detect.exploded(found, keys=("doc_id", "locator", "kind"))


def test_docx_round_trip(spark):
    df, parts, found = scanned(spark, "docx", docx())
    rows = {r.locator: r for r in parts.collect()}
    assert rows["word/document.xml#p000002"].text == "手机13800000001 & 完"
    out = packages.redact_packages(df, found.where("selected")).first()
    assert out.error_code is None and out.metadata_scrubbed
    again = {p[3]: p[4] for p in packages.parts_of(bytes(out.redacted), "docx")}
    assert again == {"word/document.xml#p000002": "手机[手机号] & 完", "word/header1.xml#p000001": "[邮箱] "}
    assert b"Somebody" not in zipfile.ZipFile(io.BytesIO(bytes(out.redacted))).read("docProps/core.xml")


def test_xlsx_round_trip(spark):
    df, parts, found = scanned(spark, "xlsx", xlsx())
    assert sorted(r.kind for r in found.collect()) == ["cell", "formula", "formula_cache"]
    out = packages.redact_packages(df, found).first()
    assert out.error_code is None
    again = {p[3]: p[4] for p in packages.parts_of(bytes(out.redacted), "xlsx", storage=True)}
    assert again["xl/worksheets/sheet1.xml#cell=A1"] == "手机[手机号]" and again["xl/worksheets/sheet1.xml#cell=B1"] == "kept"
    assert not any("13800000001" in t or "b@example.com" in t for t in again.values())


def test_preflight(spark):
    rows = [(1, "docx", docx()), (2, "docx", docx(**{"word/media/image1.gif": b"x", "word/vbaProject.bin": b"x"})), (3, "docx", b"no zip"), (4, "xlsx", docx())]
    df = spark.createDataFrame([(i, k, bytearray(c)) for i, k, c in rows], "doc_id long, format string, content binary")
    entries = packages.package_entries(df).cache()
    codes = {r.doc_id: r.error_code for r in packages.preflight(entries).collect()}
    assert codes == {1: None, 2: None, 3: "INVALID_ZIP", 4: "MISSING_REQUIRED_ENTRY"}
    payloads = {r["name"]: r.payload for r in packages.classified(entries).where("doc_id = 2 AND payload IS NOT NULL").collect()}
    assert payloads == {"word/media/image1.gif": "unsupported_image", "word/vbaProject.bin": "active"}


def test_text_files(spark):
    content = [("/x/a.TXT", "﻿手机\r\n".encode()), ("/x/b.md", b"\xff"), ("/x/c.exe", b"x")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in content], "path string, content binary")
    rows = {r.path: r for r in files.text_documents(df).collect()}
    a = rows["/x/a.TXT"]
    assert (a.text, a.has_utf8_bom, a.line_ending, a.file_kind, a.char_len) == ("手机\r\n", True, "cr_lf", "text", 4)
    assert (rows["/x/b.md"].error_code, rows["/x/c.exe"].error_code) == ("INVALID_UTF8", "UNSUPPORTED_EXTENSION")
