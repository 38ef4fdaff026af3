"""Office packages (zip files of XML): preflight, parts of text, redaction that touches only what it must.

A package is one row with its bytes. Work on one package is ordinary Python in an Arrow batch: packages are bounded
(100 MiB) and independent, so they spread over executors.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Limits of a package.
MOST_BYTES, MOST_ENTRIES, MOST_ENTRY, MOST_XML, MOST_TOTAL, MOST_RATIO, RATIO_FROM = 100 * MIB, 10_000, 100 * MIB, 20 * MIB, 500 * MIB, 1000, 10 * MIB
ROOTS = {"docx": "word", "xlsx": "xl", "pptx": "ppt"}
REQUIRED = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
#: Stories of a package: (pattern of the entry, kind, order, what is a part).
STORIES = {
    "docx": (
        (r"word/document\.xml", "body", 0, "p"),
        (r"word/header.*\.xml", "header", 1, "p"),
        (r"word/footer.*\.xml", "footer", 2, "p"),
        (r"word/footnotes\.xml", "footnote", 3, "p"),
        (r"word/endnotes\.xml", "endnote", 4, "p"),
        (r"word/comments.*\.xml", "comment", 5, "p"),
        (r"word/glossary/document\.xml", "glossary", 7, "p"),
        (r"word/charts/.*\.xml", "chart", 6, "t"),
        (r"word/diagrams/.*\.xml", "diagram", 7, "t"),
    ),
    "pptx": (
        (r"ppt/slides/slide.*\.xml", "slide", 0, "p"),
        (r"ppt/notesSlides/notesSlide.*\.xml", "notes", 1, "p"),
        (r"ppt/comments/.*\.xml", "comment", 2, "pt"),
        (r"ppt/slideMasters/slideMaster.*\.xml", "slide_master", 3, "p"),
        (r"ppt/slideLayouts/slideLayout.*\.xml", "slide_layout", 4, "p"),
        (r"ppt/notesMasters/notesMaster.*\.xml", "notes_master", 5, "p"),
        (r"ppt/handoutMasters/handoutMaster.*\.xml", "handout_master", 6, "p"),
        (r"ppt/diagrams/.*\.xml", "diagram", 7, "pt"),
    ),
}
TEXT_ELEMENTS = {"docx": {"t", "delText", "instrText", "v"}, "pptx": {"t", "text"}}
#: Payloads by name, small letters.
PAYLOADS = {
    "active": {"docx": r".*vbaproject\.bin|word/(activex|ctrlprops)/.*", "xlsx": r".*vbaproject\.bin|xl/(activex|ctrlprops)/.*", "pptx": r".*vbaproject\.bin|ppt/(activex|ctrlprops)/.*"},
    "unsupported": {
        "docx": r"word/embeddings/.*",
        "xlsx": r"xl/(embeddings|externallinks|pivotcache|charts|threadedcomments|persons|querytables|slicercaches)/.*|xl/connections\.xml|_xmlsignatures/.*",
        "pptx": r"ppt/(embeddings|charts|externallinks|model3d|ink)/.*|_xmlsignatures/.*",
    },
}
#: Entries that a redacted package doesn't keep.
DROPPED = re.compile(r"customXml/.*|docProps/(custom\.xml|thumbnail.*)|word/people\.xml|xl/calcChain\.xml|xl/printerSettings/.*|ppt/(customData|tags)/.*")
BLANK_PROPERTIES = {"Manager", "Company", "Template", "HyperlinkBase", "HeadingPairs", "TitlesOfParts"}
EPOCH, AUTHOR = "2000-01-01T00:00:00Z", "Author"


class InvalidPackage(ValueError):
    pass


def entries_of(content: bytes) -> list[tuple]:
    """(entry_no, name, size, compressed_size, method, encrypted, is_dir) of each zip entry."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i, e.filename, e.file_size, e.compress_size, e.compress_type, bool(e.flag_bits & 1), e.is_dir()) for i, e in enumerate(z.infolist())]


ENTRY = "entry_no int, name string, size long, compressed_size long, method int, encrypted boolean, is_dir boolean"


def package_entries(packages: DataFrame) -> DataFrame:
    """packages (doc_id, format, content): one row per entry; a file that isn't a zip has one row without name."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(doc, kind, len(content), *e) for e in entries_of(content)]
                except Exception:
                    rows.append((doc, kind, len(content or b""), None, None, None, None, None, None, None))
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "format", "package_bytes", *[x.split()[0] for x in ENTRY.split(", ")]])

    kind = packages.schema["doc_id"].dataType.simpleString()
    return packages.select("doc_id", "format", "content").mapInArrow(each, f"doc_id {kind}, format string, package_bytes long, {ENTRY}")


def _by_format(table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("format"))


def classified(entries: DataFrame) -> DataFrame:
    """entries with payload: active, unsupported, image, unsupported_image or null."""
    lower, root = F.lower("name"), _by_format(ROOTS)
    media = F.startswith("name", F.concat(root, F.lit("/media/"))) & ~F.endswith("name", F.lit("/"))
    matches = lambda kind: F.coalesce(F.regexp_like(lower, F.concat(F.lit(r"\A(?:"), _by_format(PAYLOADS[kind]), F.lit(r")\z"))), F.lit(False))
    image = F.regexp_like(lower, F.lit(r"\.(png|jpg|jpeg)\z"))
    payload = F.when(F.col("is_dir"), None).when(matches("active"), "active").when(matches("unsupported"), "unsupported").when(media & image, "image").when(media, "unsupported_image")
    return entries.withColumn("payload", payload)


def preflight(entries: DataFrame) -> DataFrame:
    """One row per package: totals and error_code (the first that applies) before anything is unpacked."""
    unsafe = F.regexp_like("name", F.lit(r"(\A/|\\|\x00|(\A|/)\.\.(/|\z)|\A[A-Za-z]:)"))
    large = (F.col("size") > MOST_ENTRY) | (F.endswith("name", F.lit(".xml")) & (F.col("size") > MOST_XML))
    bomb = (F.col("size") > RATIO_FROM) & (F.col("size") > F.col("compressed_size") * MOST_RATIO)
    root = _by_format(REQUIRED)
    s = entries.groupBy("doc_id", "format").agg(
        F.max("package_bytes").alias("package_bytes"),
        F.count("name").alias("entries"),
        F.count_distinct("name").alias("names"),
        F.sum("size").alias("total_size"),
        F.max("size").alias("largest"),
        F.bool_or(unsafe).alias("unsafe"),
        F.bool_or("encrypted").alias("encrypted"),
        F.bool_or(~F.col("is_dir") & ~F.col("method").isin(0, 8)).alias("method"),
        F.bool_or(large).alias("large"),
        F.bool_or(bomb).alias("bomb"),
        F.count_if(F.col("name").isin("[Content_Types].xml", "_rels/.rels") | (F.col("name") == root)).alias("required"),
    )
    code = (
        F.when(F.col("package_bytes") > MOST_BYTES, "PACKAGE_TOO_LARGE")
        .when(F.col("entries") == 0, "INVALID_ZIP")
        .when(F.col("entries") > MOST_ENTRIES, "TOO_MANY_ENTRIES")
        .when(F.col("unsafe") | (F.col("names") < F.col("entries")), "UNSAFE_ENTRY_NAME")
        .when(F.col("encrypted"), "ENCRYPTED_ENTRY")
        .when(F.col("method"), "UNSUPPORTED_COMPRESSION")
        .when(F.col("large"), "ENTRY_TOO_LARGE")
        .when(F.col("total_size") > MOST_TOTAL, "PACKAGE_TOO_LARGE")
        .when(F.col("bomb"), "SUSPICIOUS_COMPRESSION")
        .when(F.col("required") < 3, "MISSING_REQUIRED_ENTRY")
    )
    return s.select("doc_id", "format", "entries", "total_size", "largest", code.alias("error_code"))


def local(name: str) -> str:
    return name.rpartition(":")[2]


def _parse(data: bytes, start, end, text) -> None:
    """Events of an XML entry; document types and CDATA inside text are refused."""
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def refuse(*_):
        raise InvalidPackage("DOCTYPE or CDATA")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise InvalidPackage(str(e)) from e


def story_parts(data: bytes, grouping: str, elements: set[str]) -> list[tuple[str, str]]:
    """(marker, text): paragraphs p000001... (numbered with empty ones) and text nodes t000001... of an entry."""
    found, open_ = [], {"p": 0, "paragraphs": 0, "nodes": 0, "text": 0}
    paragraph: list[str] = []
    node: list[str] = []

    def start(name, _):
        if local(name) == "p":
            open_["p"] = 1
            paragraph.clear()
        elif local(name) in elements:
            open_["text"] = 1
            node.clear()

    def end(name):
        if local(name) == "p":
            open_["paragraphs"] += 1
            if "p" in grouping and any(paragraph):
                found.append((f"p{open_['paragraphs']:06d}", "".join(paragraph)))
            open_["p"] = 0
            paragraph.clear()
        elif local(name) in elements:
            open_["text"] = 0
            value = "".join(node)
            inside = "p" in grouping and open_["p"]
            if "t" in grouping and value and not inside:
                open_["nodes"] += 1
                found.append((f"t{open_['nodes']:06d}", value))
            node.clear()

    def text(value):
        if open_["text"]:
            node.append(value)
            if open_["p"]:
                paragraph.append(value)

    _parse(data, start, end, text)
    return found


def stories(names: list[str], kind: str) -> list[tuple[int, str, str, str]]:
    """(order, name, kind, grouping) of the entries that hold text."""
    found = []
    for name in names:
        for pattern, story, order, grouping in STORIES[kind]:
            if re.fullmatch(pattern, name) and "/_rels/" not in name:
                found.append((order, name, story, grouping))
                break
    return sorted(found)


def word_or_slide_parts(z: zipfile.ZipFile, kind: str) -> list[tuple[str, str, str]]:
    parts = []
    for _, name, story, grouping in stories(z.namelist(), kind):
        parts += [(story, f"{name}#{marker}", text) for marker, text in story_parts(z.read(name), grouping, TEXT_ELEMENTS[kind])]
    return parts


def _tree(data: bytes):
    import xml.etree.ElementTree as tree

    if b"<!DOCTYPE" in data:
        raise InvalidPackage("DOCTYPE")
    try:
        return tree.fromstring(data)
    except tree.ParseError as e:
        raise InvalidPackage(str(e)) from e


def _all(node, *names: str):
    return (x for x in node.iter() if local(x.tag.replace("}", ":")) in names)


def _text(node) -> str:
    return "".join(t.text or "" for t in _all(node, "t"))


def sheet_parts(z: zipfile.ZipFile, storage: bool = False) -> list[tuple[str, str, str]]:
    """Parts of a workbook, by locator; with storage also the shared strings themselves."""
    names = z.namelist()
    shared = [_text(si) for si in _all(_tree(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    parts: list[tuple[str, str, str]] = []
    book = _tree(z.read("xl/workbook.xml"))
    parts += [("sheet_name", f"xl/workbook.xml#sheet={i:06d}", s.get("name") or "") for i, s in enumerate(_all(book, "sheet"), 1)]
    parts += [("defined_name", f"xl/workbook.xml#definedName={i:06d}", d.text or "") for i, d in enumerate(_all(book, "definedName"), 1)]
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/.*\.xml", n) and "/_rels/" not in n):
        sheet = _tree(z.read(name))
        for c in _all(sheet, "c"):
            ref, kind = c.get("r") or "", c.get("t") or "n"
            formula, value = next(_all(c, "f"), None), next(_all(c, "v"), None)
            cached = value.text or "" if value is not None else ""
            at = f"{name}#cell={ref}"
            if formula is not None:
                parts.append(("formula", f"{at}#formula", formula.text or ""))
                parts.append(("formula_cache", f"{at}#cache", cached))
            elif kind == "s":
                parts.append(("cell", at, shared[int(cached)] if cached.isdigit() and int(cached) < len(shared) else ""))
            elif kind == "inlineStr":
                parts.append(("cell", at, _text(c)))
            elif kind == "n":
                parts.append(("number", at, cached))
            else:
                parts.append(("cell", at, cached))
        for area in ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter"):
            parts += [("header_footer", f"{name}#{area}", x.text or "") for x in _all(sheet, area)]
    for name in sorted(n for n in names if re.fullmatch(r"xl/comments.*\.xml", n)):
        parts += [("comment", f"{name}#comment={c.get('ref') or ''}", _text(c)) for c in _all(_tree(z.read(name)), "comment")]
    for name in sorted(n for n in names if re.fullmatch(r"xl/drawings/.*\.xml", n) and "/_rels/" not in n and not n.rpartition("/")[2].startswith("vml")):
        parts += [("drawing_text", f"{name}#t{i:06d}", t.text or "") for i, t in enumerate(_all(_tree(z.read(name)), "t"), 1)]
    if storage:
        parts += [("shared_string_storage", f"xl/sharedStrings.xml#si={i:06d}", s) for i, s in enumerate(shared)]
    return sorted(parts, key=lambda p: p[1])


def parts_of(content: bytes, kind: str, storage: bool = False) -> list[tuple[int, str, str, str, str]]:
    """(part_ord, part_id, kind, locator, text). Parts are numbered before empty ones are left out, so numbers have gaps."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = sheet_parts(z, storage) if kind == "xlsx" else word_or_slide_parts(z, kind)
    return [(i, f"{kind}-part-{i:05d}", *p) for i, p in enumerate(found, 1) if p[2]]


PART = "part_ord int, part_id string, kind string, locator string, text string"


def package_parts(packages: DataFrame, storage: bool = False) -> DataFrame:
    """packages (doc_id, format, content): one row per part of text, or one with error_code for a package that can't be read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(doc, *p, None) for p in parts_of(content, kind, storage)]
                except Exception:
                    rows.append((doc, None, None, None, None, None, "INVALID_PACKAGE"))
            types = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 5]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "part_ord", "part_id", "kind", "locator", "text", "error_code"])

    kind = packages.schema["doc_id"].dataType.simpleString()
    return packages.select("doc_id", "format", "content").mapInArrow(each, f"doc_id {kind}, {PART}, error_code string")


def embedded_images(packages: DataFrame) -> DataFrame:
    """doc_id, entry_name, path (docx://...#entry) and content of each picture inside."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(doc, n, f"{kind}://{doc}#{n}", z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(rf"{ROOTS[kind]}/media/.*\.(png|jpe?g)", n, re.I)]
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "entry_name", "path", "content"])

    kind = packages.schema["doc_id"].dataType.simpleString()
    return packages.select("doc_id", "format", "content").mapInArrow(each, f"doc_id {kind}, entry_name string, path string, content binary")


_TOKEN = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<[^>]+>", re.S)


def rewritten_slots(slots: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """Edits (start, end, replacement) of the joined slots: the first slot of a span takes the replacement, others only lose signs."""
    out = list(slots)
    for start, end, replacement in sorted(edits, reverse=True):
        at, inserted = 0, False
        for i, slot in enumerate(slots):
            a, b = max(start - at, 0), min(end - at, len(slot))
            if a < b:
                out[i] = out[i][:a] + ("" if inserted else replacement) + out[i][b:]
                inserted = True
            at += len(slot)
        if not inserted:
            raise InvalidPackage("a span has no slot")
    return out


def rewrite_story(data: bytes, name: str, edits: dict[str, list[tuple[int, int, str]]], grouping: str, elements: set[str]) -> bytes:
    """The entry with its text nodes rewritten; markup stays as it is."""
    xml = data.decode("utf-8")
    pieces: list[str] = []
    nodes: list[tuple[int, bool, int, int]] = []  # piece, inside a paragraph, paragraph number, node number
    at = paragraph = number = 0
    inside = text = False
    for m in [*_TOKEN.finditer(xml), None]:
        before = xml[at : m.start() if m else len(xml)]
        if before:
            if text:
                if not ("p" in grouping and inside):
                    number += 1
                nodes.append((len(pieces), inside, paragraph + 1, number))
            pieces.append(before)
        if not m:
            break
        pieces.append(m[0])
        at = m.end()
        tag = re.match(r"<(/?)([\w:.-]+)", m[0])
        if tag:
            short, closing, empty = local(tag[2]), bool(tag[1]), m[0].endswith("/>")
            if short == "p":
                paragraph += closing or empty
                inside = not closing and not empty
            elif short in elements and not empty:
                text = not closing
    groups: dict[str, list[int]] = {}
    for piece, within, p, t in nodes:
        groups.setdefault(f"{name}#p{p:06d}" if "p" in grouping and within else f"{name}#t{t:06d}", []).append(piece)
    for locator, spans in edits.items():
        own = groups.get(locator)
        if not own:
            raise InvalidPackage(f"no part {locator}")
        for piece, new in zip(own, rewritten_slots([unescape(pieces[i], {"&quot;": '"', "&apos;": "'"}) for i in own], spans), strict=True):
            pieces[piece] = escape(new)
    return "".join(pieces).encode("utf-8")


def scrubbed(name: str, data: bytes) -> bytes:
    """The entry without what tells who wrote it when; external links lead nowhere."""
    if not name.endswith((".xml", ".rels")):
        return data
    xml = data.decode("utf-8")
    if name == "docProps/core.xml":
        xml = re.sub(r"(<(?:[\w]+:)?(?!coreProperties)[\w]+(?: [^>]*)?>)[^<]*(</)", r"\1\2", xml)
    elif name == "docProps/app.xml":
        xml = re.sub(rf"<({'|'.join(BLANK_PROPERTIES)})>.*?</\1>", r"<\1></\1>", xml, flags=re.S)
    elif name.endswith(".rels"):
        def relation(m):
            if 'TargetMode="External"' in m[0]:
                if "/hyperlink" not in m[0]:
                    raise InvalidPackage("an external relation")
                return re.sub(r'Target="[^"]*"', 'Target="about:blank"', m[0])
            target = re.search(r'Target="([^"]*)"', m[0])
            return "" if target and DROPPED.search(target[1].lstrip("/").removeprefix("../")) else m[0]

        xml = re.sub(r"<Relationship [^>]*?/>", relation, xml)
    elif name == "[Content_Types].xml":
        xml = re.sub(r'<Override [^>]*?PartName="/([^"]*)"[^>]*?/>', lambda m: "" if DROPPED.fullmatch(m[1]) else m[0], xml)
    else:
        xml = re.sub(r'(\s(?:w:)?(?:author|initials))="[^"]*"', rf'\1="{AUTHOR}"', xml)
        xml = re.sub(r'(\s(?:w:)?(?:date|dt))="[^"]*"', rf'\1="{EPOCH}"', xml)
        xml = re.sub(r'\sw:rsid\w*="[^"]*"', "", xml)
        xml = re.sub(r"<w:docVars>.*?</w:docVars>", "", xml, flags=re.S)
    return xml.encode("utf-8")


def _entry_faults(name: str, data: bytes) -> set[str]:
    """What an entry still tells, read by a parser and not by the rules that scrub."""
    faults, path, texts = set(), [], []

    def opened(tag: str, attributes: dict[str, str]) -> None:
        local = tag.rpartition(":")[2]
        path.append(local)
        texts.append("")
        if name.endswith(".rels") and local == "Relationship":
            target, outside = attributes.get("Target", ""), attributes.get("TargetMode") == "External"
            if outside and target != "about:blank":
                faults.add("EXTERNAL_TARGET")
            if not outside and DROPPED.search(target.lstrip("/").removeprefix("../")):
                faults.add("RELATION_TO_DROPPED_ENTRY")
        elif name == "[Content_Types].xml":
            if local == "Override" and DROPPED.fullmatch(attributes.get("PartName", "").lstrip("/")):
                faults.add("TYPE_OF_DROPPED_ENTRY")
        elif not name.startswith("docProps/"):
            for key, value in attributes.items():
                plain = key.rpartition(":")[2]
                if plain in ("author", "initials") and value != AUTHOR:
                    faults.add("AUTHOR")
                elif plain in ("date", "dt") and value != EPOCH:
                    faults.add("DATE")
                elif plain.startswith("rsid") and key != plain:
                    faults.add("REVISION_ID")
            if local == "docVars":
                faults.add("DOCUMENT_VARIABLES")

    def text(value: str) -> None:
        if texts:
            texts[-1] += value

    def closed(tag: str) -> None:
        local, own = path.pop(), texts.pop()
        if name == "docProps/core.xml" and own.strip():
            faults.add("CORE_PROPERTY")
        if name == "docProps/app.xml" and own.strip() and BLANK_PROPERTIES & {local, *path}:
            faults.add("APP_PROPERTY")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, text
    parser.Parse(data, True)
    return faults


def metadata_faults(content: bytes) -> list[str]:
    """Codes of what a package still tells about who wrote it when and where; empty if nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        faults = {"ARCHIVE_COMMENT"} if z.comment else set()
        for e in z.infolist():
            if e.comment:
                faults.add("ENTRY_COMMENT")
            if DROPPED.fullmatch(e.filename):
                faults.add("DROPPED_ENTRY")
            elif e.filename.endswith((".xml", ".rels")):
                faults |= _entry_faults(e.filename, z.read(e))
    return sorted(faults)


def _sheet_rewritten(data: bytes, name: str, edits: dict[str, str], areas: dict[str, str]) -> bytes:
    """Cells of edits (reference -> new text) become inline strings of their style; headers and footers are replaced."""
    xml = data.decode("utf-8")

    def cell(m):
        ref = re.search(r'\sr="([^"]*)"', m[1])
        if not ref or ref[1] not in edits:
            return m[0]
        style = re.search(r'\ss="[^"]*"', m[1])
        return f'<c r={quoteattr(ref[1])}{style[0] if style else ""} t="inlineStr"><is><t xml:space="preserve">{escape(edits[ref[1]])}</t></is></c>'

    xml = re.sub(r"<c\b([^>]*?)(?:/>|>.*?</c>)", cell, xml, flags=re.S)
    for area, text in areas.items():
        xml = re.sub(rf"(<{area}[^>]*>).*?(</{area}>)", lambda m, t=text: m[1] + escape(t) + m[2], xml, flags=re.S)
    return xml.encode("utf-8")


def redacted_package(content: bytes, kind: str, findings: list[dict], images: dict[str, bytes] | None = None) -> bytes:
    """The package with selected findings (locator, start, end, replacement) applied and metadata scrubbed. images are the masked
    pictures by entry; a picture without one holds the package back."""
    images = images or {}
    by: dict[str, list[tuple[int, int, str]]] = {}
    for f in findings:
        by.setdefault(f["locator"], []).append((f["start"], f["end"], f["replacement"]))
    for spans in by.values():
        spans.sort()
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
            raise InvalidPackage("OVERLAPPING_FINDINGS")
    texts = {p[3]: p[4] for p in parts_of(content, kind)}
    new = {at: "".join(rewritten_slots([texts[at]], spans)) for at, spans in by.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        live = _live_strings(z, new) if kind == "xlsx" else None
        grouping = {name: g for _, name, _, g in stories(z.namelist(), kind)} if kind in STORIES else {}
        for entry in z.infolist():
            if entry.is_dir() or DROPPED.fullmatch(entry.filename):
                continue
            name, data = entry.filename, z.read(entry)
            if name.startswith(f"{ROOTS[kind]}/media/"):
                if name not in images:
                    raise InvalidPackage("EMBEDDED_IMAGE_NOT_MASKED")
                data = images[name]
            own = {at: spans for at, spans in by.items() if at.split("#")[0] == name}
            if name in grouping and own:
                data = rewrite_story(data, name, own, grouping[name], TEXT_ELEMENTS[kind])
            elif kind == "xlsx":
                data = _workbook_entry(name, data, own, new, live)
            target.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), scrubbed(name, data), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _live_strings(z: zipfile.ZipFile, new: dict[str, str]) -> set[int]:
    """Numbers of shared strings that a cell without redaction still uses."""
    live = set()
    for name in z.namelist():
        if re.fullmatch(r"xl/worksheets/.*\.xml", name) and "/_rels/" not in name:
            for c in _all(_tree(z.read(name)), "c"):
                value = next(_all(c, "v"), None)
                if c.get("t") == "s" and value is not None and f"{name}#cell={c.get('r')}" not in new:
                    live.add(int(value.text or -1))
    return live


def _workbook_entry(name: str, data: bytes, own: dict, new: dict[str, str], live: set[int]) -> bytes:
    if re.fullmatch(r"xl/worksheets/.*\.xml", name):
        cells: dict[str, str] = {}
        conflicts = {}
        for at in own:
            ref = re.search(r"#cell=([^#]*)", at)
            if ref:
                value = own[at][0][2] if at.endswith(("#formula", "#cache")) else new[at]
                if conflicts.setdefault(ref[1], value) != value:
                    raise InvalidPackage("FORMULA_REPLACEMENT_CONFLICT")
                cells[ref[1]] = value
        areas = {at.rpartition("#")[2]: new[at] for at in own if re.search(r"#(odd|even|first)(Header|Footer)\Z", at)}
        return _sheet_rewritten(data, name, cells, areas)
    xml = data.decode("utf-8") if name.endswith(".xml") else ""
    if name == "xl/sharedStrings.xml":
        numbers = iter(range(10**9))
        xml = re.sub(r"<si>.*?</si>", lambda m: m[0] if next(numbers) in live else "<si><t></t></si>", xml, flags=re.S)
    elif name == "xl/workbook.xml":
        numbers = iter(range(1, 10**9))
        xml = re.sub(r"<definedName\b.*?</definedName>", lambda m: "" if f"{name}#definedName={next(numbers):06d}" in own else m[0], xml, flags=re.S)
    elif re.fullmatch(r"xl/comments.*\.xml", name):
        xml = re.sub(r"<author>.*?</author>", f"<author>{AUTHOR}</author>", xml, flags=re.S)
        for at in own:
            ref = re.escape(at.partition("#comment=")[2])
            xml = re.sub(rf'(<comment\b[^>]*ref="{ref}"[^>]*>)\s*<text>.*?</text>', lambda m, t=new[at]: f'{m[1]}<text><r><t xml:space="preserve">{escape(t)}</t></r></text>', xml, flags=re.S)
    elif re.fullmatch(r"xl/drawings/[^/]*\.xml", name) and not name.rpartition("/")[2].startswith("vml"):
        numbers = iter(range(1, 10**9))
        xml = re.sub(r"(<a:t>)(.*?)(</a:t>)", lambda m: m[1] + escape(new.get(f"{name}#t{next(numbers):06d}", unescape(m[2]))) + m[3], xml, flags=re.S)
        xml = re.sub(r'\s(name|descr|title)="[^"]*"', r' \1=""', xml)
    else:
        return data
    return xml.encode("utf-8")


#: What reading a damaged package raises.
FAULTS = (ValueError, KeyError, zipfile.BadZipFile, expat.ExpatError, zlib.error, EOFError, NotImplementedError)


def redact_packages(packages: DataFrame, findings: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """packages (doc_id, format, content) with redacted (null on error), error_code and metadata_scrubbed.
    findings: rows (doc_id, locator, start, end, replacement) that are selected; images: rows (doc_id, entry_name, redacted)
    of masked pictures. A package with a picture that has no masked one, or with metadata left, is an error."""
    grouped = findings.groupBy("doc_id").agg(F.collect_list(F.struct("locator", "start", "end", "replacement")).alias("spans"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, error, clean = [], [], []
            for kind, content, spans, pictures in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                try:
                    made = redacted_package(content, kind, spans or [], {p["entry_name"]: p["redacted"] for p in pictures or []})
                    if metadata_faults(made):
                        raise InvalidPackage("METADATA_REMAINS")
                    out.append(made)
                    error.append(None)
                    clean.append(True)
                except FAULTS as e:
                    out.append(None)
                    error.append(str(e) if isinstance(e, InvalidPackage) and str(e).isupper() and " " not in str(e) else "INVALID_PACKAGE")
                    clean.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(error, pa.string()), pa.array(clean, pa.bool_())], names=["doc_id", "format", "redacted", "error_code", "metadata_scrubbed"])

    kind = packages.schema["doc_id"].dataType.simpleString()
    none = packages.select("doc_id", F.lit("").alias("entry_name"), F.lit(b"").alias("redacted")).limit(0)
    pictures = (none if images is None else images.where("redacted IS NOT NULL")).groupBy("doc_id").agg(F.collect_list(F.struct("entry_name", "redacted")).alias("pictures"))
    joined = packages.join(grouped, "doc_id", "left").join(pictures, "doc_id", "left").select("doc_id", "format", "content", "spans", "pictures")
    return joined.mapInArrow(each, f"doc_id {kind}, format string, redacted binary, error_code string, metadata_scrubbed boolean")


def verified_packages(packages: DataFrame, policy, images: DataFrame | None = None) -> DataFrame:
    """The whole workflow over packages (doc_id, format, content): parts are scanned, the package is rewritten, and what was
    written is read and scanned again. doc_id, format, error_code, residual_count, redacted: null unless nothing is left."""
    from ..operators import detect, redact

    found = detect.exploded(redact.scan(package_parts(packages), policy), keys=("doc_id", "locator")).where("selected")
    made = redact_packages(packages, found, images)
    again = package_parts(made.where("error_code IS NULL").select("doc_id", "format", F.col("redacted").alias("content")))
    values = found.select("doc_id", "matched_text").distinct().groupBy("doc_id").agg(F.collect_set("matched_text").alias("values"))
    checked = redact.scan(again, policy).join(values, "doc_id", "left")
    held = F.size(F.filter(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.contains("text", v)))
    left = checked.groupBy("doc_id").agg(F.sum(F.size("findings") + held).alias("left"))
    joined = made.join(left, "doc_id", "left").withColumn("residual_count", F.coalesce("left", F.lit(0)))
    error = F.coalesce("error_code", F.when(F.col("residual_count") > 0, "RESIDUALS_REMAIN"))
    return joined.select("doc_id", "format", error.alias("error_code"), "residual_count", F.when(error.isNull(), F.col("redacted")).alias("redacted"))
