"""Text files, JSON records and image or PDF headers as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

#: What counts as text and what doesn't fit.
TEXT_KINDS = {"txt": "text", "md": "markdown", "markdown": "markdown"}
MIB = 1024 * 1024
MOST_STDIN = 2 * MIB
PROFILES = {"txt": ("text", 2 * MIB), "md": ("text", 2 * MIB), "docx": ("word", 100 * MIB), "xlsx": ("spreadsheet", 100 * MIB), "pptx": ("presentation", 100 * MIB), "pdf": ("pdf", 100 * MIB), "png": ("image", 50 * MIB), "jpg": ("image", 50 * MIB), "jpeg": ("image", 50 * MIB)}
PDF_TOKENS = {"/JavaScript": "PDF_JAVASCRIPT", "/JS": "PDF_JAVASCRIPT", "/Annots": "PDF_ANNOTATIONS", "/EmbeddedFiles": "PDF_ATTACHMENTS", "/Filespec": "PDF_ATTACHMENTS", "/Sig": "PDF_SIGNATURE"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def _pick(column: Column, table: dict, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column), default)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def text_documents(files: DataFrame) -> DataFrame:
    """files (path, length, content) as documents with one part each. error_code instead of text for files that aren't
    text by name or not UTF-8; a byte order mark is taken off, the hash is that of all bytes."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TEXT_KINDS.items() for x in pair]), extension(F.col("path")))
    bom = F.startswith(F.hex("content"), F.lit("EFBBBF"))
    body = F.when(bom, F.expr("substring(content, 4, length(content))")).otherwise(F.col("content"))
    error = F.when(kind.isNull(), "UNSUPPORTED_EXTENSION").when(~F.is_valid_utf8("content"), "INVALID_UTF8")
    text = F.when(error.isNull(), body.cast("string"))
    return files.select(
        "path",
        F.sha2("content", 256).alias("sha256"),
        F.length("content").cast("long").alias("size_bytes"),
        kind.alias("file_kind"),
        F.lit("UTF-8").alias("encoding"),
        bom.alias("has_utf8_bom"),
        scalars.line_ending(text).alias("line_ending"),
        F.lit("part-0001").alias("part_id"),
        F.lit("whole_file").alias("locator"),
        text.alias("text"),
        F.length(text).alias("char_len"),
        error.alias("error_code"),
    )


def documents_from_text(rows: DataFrame, key: str = "doc_id", label: str = "stdin://clipboard", kind: str = "clipboard") -> DataFrame:
    """Texts in a table as documents of one part."""
    return rows.select(
        key,
        F.lit(label).alias("path"),
        scalars.sha256_hex(F.col("text")).alias("sha256"),
        scalars.task_id(F.col("text")).alias("task_id"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(kind).alias("file_kind"),
        F.lit(False).alias("has_utf8_bom"),
        scalars.line_ending(F.col("text")).alias("line_ending"),
        F.lit("part-0001").alias("part_id"),
        "text",
        F.length("text").alias("char_len"),
    )


def within_stdin_limit(rows: DataFrame) -> DataFrame:
    return rows.where(F.octet_length("text") <= MOST_STDIN)


def image_headers(files: DataFrame) -> DataFrame:
    """path, kind, width, height, error_code of PNG and JPEG files by their first bytes; JPEG sizes from the frame header."""
    head = F.hex(F.expr("substring(content, 1, 32)"))
    png, jpeg = F.startswith(head, F.lit("89504E470D0A1A0A")), F.startswith(head, F.lit("FFD8FF"))
    number = lambda text, at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    frame = F.regexp_extract(F.hex("content"), r"\A(?:..)*?FFC[0-35-79-BD-F]....08(.{8})", 1)
    width = F.when(png, number(head, 33)).when(jpeg & (frame != ""), F.conv(F.substring(frame, 5, 4), 16, 10).cast("long"))
    height = F.when(png, number(head, 41)).when(jpeg & (frame != ""), F.conv(F.substring(frame, 1, 4), 16, 10).cast("long"))
    rows = files.select("path", F.length("content").alias("size_bytes"), F.when(png, "png").when(jpeg, "jpeg").alias("kind"), width.alias("width"), height.alias("height"))
    side = (F.col("width") > 20_000) | (F.col("height") > 20_000) | (F.col("width") * F.col("height") > 100_000_000)
    return rows.withColumn("error_code", F.when(F.col("size_bytes") > 50 * MIB, "FILE_TOO_LARGE").when(F.col("kind").isNull(), "UNSUPPORTED_IMAGE").when(F.col("width").isNull() | side, "INVALID_IMAGE_DIMENSIONS"))


def pdf_probe(files: DataFrame) -> DataFrame:
    """path, error_code and structure codes of PDF files: what a picture of the pages would leave out."""
    text = F.decode("content", "ISO-8859-1")
    codes = [F.when(F.regexp_like(text, F.lit(rf"{token}(?![A-Za-z0-9])")), code) for token, code in PDF_TOKENS.items()]
    error = F.when(F.length("content") > 100 * MIB, "FILE_TOO_LARGE").when(~F.startswith(text, F.lit("%PDF-")), "NOT_A_PDF").when(F.regexp_like(text, F.lit(r"/Encrypt(?![A-Za-z0-9])")), "PDF_ENCRYPTED")
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z0-9])"))
    return files.select("path", error.alias("error_code"), pages.alias("pages"), F.array_sort(F.array_distinct(F.array_compact(F.array(*codes)))).alias("diagnostics"))


def parse_pdfinfo(output: Column) -> Column:
    """'key: value' lines as a map; the first of equal keys counts."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(x, r"\A[^:]*:\s*|\s+\z", "").alias("value"))
    entries = F.transform(lines, entry)
    first = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda kept, e: F.when(F.exists(kept, lambda o: o["key"] == e["key"]), kept).otherwise(F.array_append(kept, e)))
    return F.map_from_entries(first)


#: Names that a PDF of pictures may and may not hold.
PDF_ALLOWED = frozenset(
    ("BitsPerComponent", "Catalog", "ColorSpace", "Contents", "Count", "DCTDecode", "DeviceRGB", "Filter", "Height", "Image", "Im0", "Interpolate", "Kids")
    + ("Length", "MediaBox", "Page", "Pages", "Parent", "Resources", "Root", "Size", "Subtype", "Type", "Width", "XObject")
)
PDF_FORBIDDEN = frozenset(
    ("AA", "AcroForm", "Annots", "EmbeddedFiles", "Encrypt", "Filespec", "Info", "JavaScript", "JS", "Metadata", "Names", "ObjStm", "OCProperties", "OpenAction", "RichMedia", "Sig", "XFA")
)


def safe_pdf_structure(content: bytes, allowed: frozenset[str] = PDF_ALLOWED, forbidden: frozenset[str] = PDF_FORBIDDEN) -> bool:
    """Whether a PDF consists of pictures of pages only: known names, JPEG streams and streams that draw one picture."""
    import re

    at, plain = 0, []
    for m in re.finditer(rb"/Length\s+(\d+)[^>]*>>\s*stream\r?\n", content):
        if m.start() < at:
            continue
        end = m.end() + int(m[1])
        body = content[m.end() : end].strip()
        picture = body[:2] == b"\xff\xd8" and body[-2:] == b"\xff\xd9"
        drawing = re.fullmatch(rb"q\s+[\d.]+\s+0\s+0\s+[\d.]+\s+0\s+0\s+cm\s+/Im0\s+Do\s+Q", body)
        if not (picture or drawing) or not content[end:].lstrip().startswith(b"endstream"):
            return False
        plain.append(content[at : m.end()])
        at = end
    plain.append(content[at:])
    names = {n.decode("latin-1") for n in re.findall(rb"/([A-Za-z0-9.+-]+)", b"".join(plain))}
    return content.startswith(b"%PDF-") and names <= allowed and not names & forbidden


def safe_structures(files: DataFrame, key: str = "path") -> DataFrame:
    """key, safe: whether a PDF (content) consists of pictures of pages only."""

    @F.pandas_udf("boolean")
    def safe(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: c is not None and safe_pdf_structure(c))

    return files.select(key, safe("content").alias("safe"))


def registered(items: DataFrame, most: int = 200) -> DataFrame:
    """items (seq from 1, path, size_bytes), the first most of them: kind, whether each can be scanned and why not; later copies of a path are duplicates."""
    from pyspark.sql import Window

    ext = extension(F.col("path"))
    kind = _pick(ext, {k: v[0] for k, v in PROFILES.items()}, F.lit("unknown"))
    limit = _pick(ext, {k: v[1] for k, v in PROFILES.items()}, F.lit(0)).cast("long")
    again = F.row_number().over(Window.partitionBy("path").orderBy("seq")) > 1
    reason = F.when(F.col("kind") == "unknown", "UNSUPPORTED_EXTENSION").when(F.col("size_bytes") > limit, "FILE_TOO_LARGE").otherwise("READY")
    rows = items.where(F.col("seq") <= most).withColumn("kind", kind).withColumn("duplicate", again).withColumn("reason_code", F.when(F.col("duplicate"), "ALREADY_IMPORTED").otherwise(reason))
    return rows.withColumn("ready", F.col("reason_code") == "READY").select("seq", "path", "kind", "size_bytes", "duplicate", "reason_code", "ready")


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line, blank lines skipped; a line that isn't one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_errors(lines: DataFrame, schema: str) -> DataFrame:
    """lines (line_number, value): numbers of the lines that don't parse."""
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("value") != "").withColumn("p", parsed).where(F.col("p._bad").isNotNull() | F.col("p").isNull()).select("line_number")


def load_runtimes(path: str) -> list[dict]:
    """The registry of local models: paths relative to it, unique ids, a timeout from 100 ms to 10 minutes, SHA-256 of assets."""
    registry = json.loads(Path(path).read_text(encoding="utf-8"))
    base, seen = Path(path).resolve().parent, set()
    for entry in registry["runtimes"]:
        if not entry["id"].strip() or entry["id"] in seen:
            raise ValueError(f"runtime id {entry['id']!r} is empty or repeated")
        seen.add(entry["id"])
        if not 100 <= entry.get("timeout_ms", 60_000) <= 600_000:
            raise ValueError(f"timeout of {entry['id']}")
        for asset in entry.get("assets", []):
            if len(asset["sha256"]) != 64 or not all(c in "0123456789abcdefABCDEF" for c in asset["sha256"]):
                raise ValueError(f"hash of an asset of {entry['id']}")
            asset["path"] = str(base / asset["path"])
        entry["program"] = str(base / entry["program"])
    return registry["runtimes"]
