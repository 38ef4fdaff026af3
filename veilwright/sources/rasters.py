"""Pictures as rows: PNG pixels are decoded, masked, shrunk and written anew without metadata; PDFs get one JPEG per page.

A picture is bounded (50 MiB, 10^8 pixels), so each is ordinary Python in an Arrow batch. Errors are codes in rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_BYTES, MOST_SIDE, MOST_PIXELS = 50 << 20, 20_000, 100_000_000
PREVIEW_SIDE = 2400
MOST_PAGES = 200
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FAULTS = (ValueError, zlib.error, struct.error, IndexError)


class BadPicture(ValueError):
    pass


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BadPicture("INVALID_IMAGE")
        yield kind, body
        at += 12 + size


def _orientation(exif: bytes) -> int:
    order = "<" if exif[:2] == b"II" else ">"
    start = struct.unpack_from(f"{order}I", exif, 4)[0]
    for i in range(struct.unpack_from(f"{order}H", exif, start)[0]):
        tag, _, _, value = struct.unpack_from(f"{order}HHIH", exif, start + 2 + 12 * i)
        if tag == 0x0112:
            return value
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is meant to be seen (1 to 8 as cameras number them)."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise BadPicture("INVALID_IMAGE")
    out, up, given = [0] * (len(row) + step), [0] * step + above.tolist(), row.tolist()
    for i, x in enumerate(given):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        out[i + step] = (x + guess) & 255
    return np.array(out[step:], np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 to 4 samples of 8 bits), upright. Palettes become RGB; interlaced and 16-bit pictures are not supported."""
    if len(data) > MOST_BYTES:
        raise BadPicture("FILE_TOO_LARGE")
    if not data.startswith(SIGNATURE):
        raise BadPicture("UNSUPPORTED_IMAGE")
    head, packed, palette, turned = None, [], None, 1
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            width, height, depth, colour, *_, interlaced = head
            if not 0 < width <= MOST_SIDE or not 0 < height <= MOST_SIDE or width * height > MOST_PIXELS:
                raise BadPicture("INVALID_IMAGE_DIMENSIONS")
            if depth != 8 or interlaced or colour not in SAMPLES:
                raise BadPicture("UNSUPPORTED_IMAGE")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"eXIf":
            turned = _orientation(body)
    if head is None:
        raise BadPicture("INVALID_IMAGE")
    step = SAMPLES[colour]
    stride = width * step + 1
    raw = zlib.decompressobj().decompress(b"".join(packed), height * stride)
    if len(raw) != height * stride:
        raise BadPicture("INVALID_IMAGE")
    rows, above, out = np.frombuffer(raw, np.uint8).reshape(height, stride), np.zeros(stride - 1, np.uint8), []
    for row in rows:
        above = _unfiltered(int(row[0]), row[1:], above, step)
        out.append(above)
    pixels = np.array(out).reshape(height, width, step)
    return upright(palette[pixels[:, :, 0]] if palette is not None and colour == 3 else pixels, turned)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of pixels that holds nothing else."""
    height, width, step = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels).reshape(height, width * step)], axis=1)
    out = [SIGNATURE]
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b"")):
        out += [struct.pack(">I", len(body)), kind, body, struct.pack(">I", zlib.crc32(kind + body))]
    return b"".join(out)


def masked(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """pixels with solid boxes (x0, y0, x1, y1; ends exclusive). A box that leaves the picture or is empty is an error."""
    out, step = pixels.copy(), pixels.shape[2]
    fill = {1: (colour[0],), 2: (colour[0], 255), 3: colour, 4: (*colour, 255)}[step]
    for x0, y0, x1, y1 in boxes:
        if not (0 <= x0 < x1 <= out.shape[1] and 0 <= y0 < y1 <= out.shape[0]):
            raise BadPicture("INVALID_MASK")
        out[y0:y1, x0:x1] = fill
    return out


def shrunk(pixels: np.ndarray, side: int = PREVIEW_SIDE) -> np.ndarray:
    """The picture with no side above side, by the nearest pixels."""
    height, width = pixels.shape[:2]
    longest = max(height, width)
    if longest <= side:
        return pixels
    h, w = max(1, height * side // longest), max(1, width * side // longest)
    return pixels[np.arange(h) * height // h][:, np.arange(w) * width // w]


def _each(rows: DataFrame, work: Callable[[list], bytes]) -> DataFrame:
    """rows (key, content, more) as key, redacted, error_code."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for values in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)), strict=True):
                try:
                    out.append(work(*values))
                    errors.append(None)
                except FAULTS as e:
                    out.append(None)
                    errors.append(str(e) if isinstance(e, BadPicture) else "INVALID_IMAGE")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "redacted", "error_code"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, redacted binary, error_code string")


def mask_pictures(pictures: DataFrame, boxes: DataFrame, key: str = "path", colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """pictures (key, content) with the boxes (key, x0, y0, x1, y1) painted: key, redacted (PNG, null on error), error_code."""
    own = boxes.groupBy(key).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))  # a page has few
    joined = pictures.select(key, "content").join(own, key, "left")

    def paint(content: bytes | None, found: list[dict] | None) -> bytes:
        return encode(masked(decode(content or b""), [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in found or []], colour))

    return _each(joined, paint)


def previews(pictures: DataFrame, key: str = "path", side: int = PREVIEW_SIDE) -> DataFrame:
    """key, redacted (a PNG no longer than side), error_code."""
    return _each(pictures.select(key, "content"), lambda content: encode(shrunk(decode(content or b""), side)))


def jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the frame header."""
    if data[:2] != b"\xff\xd8" or data[-2:] != b"\xff\xd9":
        raise BadPicture("UNSUPPORTED_IMAGE")
    at = 2
    while at < len(data) - 9:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if data[at] != 0xFF:
            break
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    raise BadPicture("INVALID_IMAGE")


def pdf_of(pages: list[bytes], dpi: int = 200) -> bytes:
    """A new PDF of JPEG pages that holds nothing but them."""
    if not 0 < len(pages) <= MOST_PAGES:
        raise BadPicture("PDF_PAGE_LIMIT")
    n = len(pages)
    kids = " ".join(f"{3 + 3 * i} 0 R" for i in range(n))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {n} /Kids [{kids}] >>".encode()]
    for i, page in enumerate(pages):
        width, height = jpeg_size(page)
        w, h = f"{width * 72 / dpi:.2f}", f"{height * 72 / dpi:.2f}"
        draw = f"q {w} 0 0 {h} 0 0 cm /Im0 Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Contents {4 + 3 * i} 0 R /Resources << /XObject << /Im0 {5 + 3 * i} 0 R >> >> >>".encode())
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length {len(page)} >>\nstream\n".encode() + page + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def page_pdfs(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages (key, page, content: JPEG) as one PDF for each key: key, redacted, error_code. A structure that isn't pictures only is an error."""
    from .files import safe_pdf_structure

    own = pages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda p: p["content"]).alias("pages"))  # MOST_PAGES at most are written

    def build(found: list[bytes]) -> bytes:
        made = pdf_of(found)
        if not safe_pdf_structure(made):
            raise BadPicture("UNSAFE_PDF_STRUCTURE")
        return made

    return _each(own, build)
