import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import SF, duck, rows  # noqa: F401
from veilwright.operators import redact, sinks
from veilwright.operators.policy import Policy
from veilwright.plans import catalog, exports
from veilwright.sources import files, packages, rasters

NEW = ("k04_verified_packages", "k05_page_pdfs", "r14_safe_structures", "r12_metadata_faults", "k01_export_gate", "g04_page_fragments", "verified_redaction", "k06_drafts", "a11_overlap_counts", "a03_merge_evaluation")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def filtered(pixels, kinds):
    """A PNG whose rows are filtered by the kinds in turn, in plain Python."""
    height, width, step = pixels.shape
    out, above = b"", [0] * (width * step)
    for y in range(height):
        row, kind = pixels[y].ravel().tolist(), kinds[y % len(kinds)]
        coded = []
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *coded])
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    return chunk, rasters.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_pixels_of_all_filters(step):
    pixels = np.random.default_rng(step).integers(0, 256, (11, 7, step), dtype=np.uint8)
    _, head, body = filtered(pixels, (0, 1, 2, 3, 4))
    assert (rasters.decode(head + body) == pixels).all() and (rasters.decode(rasters.encode(pixels)) == pixels).all()


def test_orientation_is_applied_and_dropped():
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    chunk, head, body = filtered(pixels, (0,))
    exif = b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    turned = rasters.decode(head + chunk(b"eXIf", exif) + body)
    assert turned[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert b"eXIf" not in rasters.encode(turned)


def test_errors_of_pictures(spark):
    good = rasters.encode(np.full((5, 6, 3), 9, np.uint8))
    wide = good[:16] + struct.pack(">I", 30_000) + good[20:]
    broken = [("a", good), ("b", b"GIF89a"), ("c", good[:-30]), ("d", None), ("e", wide), ("f", good)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), 1) for p, c in broken], "path string, content binary, x0 int")
    boxes = spark.createDataFrame([("a", 0, 0, 2, 2), ("a", 3, 1, 6, 5), ("f", 0, 0, 7, 1)], "path string, x0 int, y0 int, x1 int, y1 int")
    got = {r.path: r for r in rasters.mask_pictures(df, boxes).collect()}
    assert {p: r.error_code for p, r in got.items()} == {"a": None, "b": "UNSUPPORTED_IMAGE", "c": "INVALID_IMAGE", "d": "UNSUPPORTED_IMAGE", "e": "INVALID_IMAGE", "f": "INVALID_MASK"}
    pixels = rasters.decode(bytes(got["a"].redacted))
    assert (pixels[:2, :2] == 0).all() and (pixels[1:5, 3:6] == 0).all() and int((pixels == 9).all(axis=2).sum()) == 30 - 4 - 12


def test_pdf_of_pages():
    page = exports._jpeg(1, 1)
    made = rasters.pdf_of([page, page])
    assert files.safe_pdf_structure(made) and not files.safe_pdf_structure(made.replace(b"/Root", b"/Info 9 0 R /Root"))
    with pytest.raises(ValueError):
        rasters.pdf_of([page] * (rasters.MOST_PAGES + 1))


def test_leaks_hold_a_package_back(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("_rels/.rels", "<Relationships/>")
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>手机13800000001</w:t></w:r></w:p></w:document>')
        # an author under a prefix that the scrubber doesn't know
        z.writestr("word/comments.xml", '<w:comments xmlns:w="w" xmlns:q="w"><w:comment q:author="Somebody"/></w:comments>')
    df = spark.createDataFrame([(1, "docx", bytearray(out.getvalue()))], "doc_id long, format string, content binary")
    row = packages.verified_packages(df, Policy()).first()
    assert (row.error_code, row.redacted) == ("METADATA_REMAINS", None)


def test_gate_and_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "手机13800000001。"), (2, "x"), (3, "gone"), (4, "taken"), (5, None)], "doc_id long, text string")
    checked = redact.redact_and_verify(docs, Policy())
    sources = docs.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 2, "y").otherwise(F.coalesce("text", F.lit(""))))
    gated = sinks.export_gate(checked, sources, docs.where("doc_id = 4"))
    outcome = {r.doc_id: r.export_error for r in sinks.export_batch(gated, f"{tmp_path}/out").collect()}
    assert outcome == {1: None, 2: "SOURCE_CHANGED", 3: "SOURCE_CHANGED", 4: "OUTPUT_EXISTS", 5: None}
    assert sorted(r.doc_id for r in spark.read.json(f"{tmp_path}/out/redacted").collect()) == [1, 5]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_batch(gated, f"{tmp_path}/out")
    assert {r.doc_id for r in sinks.copy_back(gated).collect()} == {1, 5}


def test_every_engine_query_but_the_rule_packs_has_sql():
    assert {n for n in catalog.QUERIES if n not in entry.oracle_sql()} == {"d18_baseline_rules", "d19_context_rules"}
