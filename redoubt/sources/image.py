"""JPEG and PNG containers: their metadata, and the same image without it."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import RedactionError
from .text import NODES

PNG = b"\x89PNG\r\n\x1a\n"

# EXIF tags that are read.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9286: "UserComment", 0xA430: "OwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0x013C: "HostComputer",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
PNG_METADATA = (b"tEXt", b"iTXt", b"zTXt", b"eXIf", b"tIME", b"dSIG")


def sniff(raw: bytes) -> str | None:
    return "jpeg" if raw[:2] == b"\xff\xd8" else "png" if raw[:8] == PNG else None


def _jpeg_blocks(raw: bytes) -> list[tuple[str, int, int]]:
    """Metadata segments ``(kind, start, end)`` before the scan: EXIF, XMP, IPTC, comments, other APPn; JFIF and colour profiles stay."""
    out, at = [], 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xDA, 0xD9):
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        end = at + 2 + size
        if size < 2 or end > len(raw):
            raise RedactionError("E_PARSE", "a JPEG segment runs over the end")
        body = raw[at + 4 : end]
        if marker == 0xE1:
            out.append(("exif" if body[:6] == b"Exif\0\0" else "xmp" if body[:28] == b"http://ns.adobe.com/xap/1.0/" else "app1", at, end))
        elif marker == 0xED:
            out.append(("iptc", at, end))
        elif marker == 0xFE:
            out.append(("comment", at, end))
        elif 0xE2 <= marker <= 0xEF and not (marker == 0xE2 and body[:11] == b"ICC_PROFILE") and not (marker == 0xEE and body[:5] == b"Adobe"):
            out.append((f"app{marker - 0xE0}", at, end))
        at = end
    return out


def _png_chunks(raw: bytes) -> list[tuple[bytes, int, int]]:
    out, at = [], 8
    while at + 12 <= len(raw):
        size = struct.unpack_from(">I", raw, at)[0]
        end = at + 12 + size
        if end > len(raw):
            raise RedactionError("E_PARSE", "a PNG chunk runs over the end")
        out.append((raw[at + 4 : at + 8], at, end))
        at = end
        if out[-1][0] == b"IEND":
            break
    return out


def scan_container(raw: bytes) -> list[tuple[str, int, int]]:
    kind = sniff(raw)
    if kind == "jpeg":
        return _jpeg_blocks(raw)
    if kind == "png":
        return [(t.decode(), a, z) for t, a, z in _png_chunks(raw) if t in PNG_METADATA]
    raise RedactionError("E_PARSE", "neither JPEG nor PNG")


def strip_metadata(raw: bytes) -> bytes:
    """The file without its metadata blocks; image data are the same bytes."""
    out, at = [], 0
    for _, start, end in scan_container(raw):
        out.append(raw[at:start])
        at = end
    return b"".join(out) + raw[at:]


def dimensions(raw: bytes) -> tuple[int, int] | None:
    if sniff(raw) == "png" and raw[12:16] == b"IHDR":
        return struct.unpack_from(">II", raw, 16)
    at = 2
    while sniff(raw) == "jpeg" and at + 9 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", raw, at + 5)
            return w, h
        at += 2 + size
    return None


def gps_to_decimal(parts, ref: str) -> float:
    d, m, s = (list(parts) + [0, 0, 0])[:3]
    return (d + m / 60 + s / 3600) * (-1 if ref.upper() in ("S", "W") else 1)


def read_exif(tiff: bytes) -> dict[str, object]:
    """Fields of IFD0, the EXIF and the GPS directory; damaged entries are left out."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict[str, object] = {}
    seen: set[int] = set()
    if order is None or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return out

    def value(kind: int, count: int, at: int):
        size = SIZES.get(kind, 0) * count
        if not size or size > len(tiff):
            return None
        if size > 4:
            at = struct.unpack_from(order + "I", tiff, at)[0]
        if at + size > len(tiff):
            return None
        raw = tiff[at : at + size]
        if kind == 2:
            return raw.split(b"\0")[0].decode("latin-1").strip()
        if kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
        if kind in (3, 4, 8, 9):
            return list(struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i"}[kind] * count, raw))
        return raw

    def walk(at: int, names: dict[int, str], depth: int):
        if depth > 4 or at in seen or at + 2 > len(tiff):
            return
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            if tag in (0x8769, 0x8825):
                walk(struct.unpack_from(order + "I", tiff, entry + 8)[0], TAGS if tag == 0x8769 else GPS_TAGS, depth + 1)
            elif tag in names and (v := value(kind, count, entry + 8)) is not None:
                out[names[tag]] = v

    walk(struct.unpack_from(order + "I", tiff, 4)[0], TAGS, 0)
    return out


MOST_TEXT = 64 << 20  # of one compressed text block; a longer one is an error, never cut
BATCH_TEXT = 4 << 20  # characters after which a batch of nodes goes out, since a few kilobytes of file may hold megabytes of text


def inflated(data: bytes) -> bytes:
    reader = zlib.decompressobj()
    out = reader.decompress(data, MOST_TEXT)
    if reader.unconsumed_tail:
        raise RedactionError("E_PARSE", f"a text block inflates to more than {MOST_TEXT} bytes")
    return out + reader.flush()


def _numbers(v) -> bool:
    return isinstance(v, list) and 0 < len(v) and all(isinstance(x, int | float) for x in v)


def metadata_fields(raw: bytes) -> list[tuple[str, str]]:
    """``(key, text)`` of everything the container says besides its pixels; GPS as one decimal position."""
    out: list[tuple[str, str]] = []
    for kind, start, end in scan_container(raw):
        body = raw[start + 4 : end] if sniff(raw) == "jpeg" else raw[start + 8 : end - 4]
        if kind in ("exif", "eXIf"):
            fields = read_exif(body[6:] if kind == "exif" else body)
            if _numbers(fields.get("GPSLatitude")) and _numbers(fields.get("GPSLongitude")):
                lat = gps_to_decimal(fields["GPSLatitude"], str(fields.get("GPSLatitudeRef", "N")))
                lon = gps_to_decimal(fields["GPSLongitude"], str(fields.get("GPSLongitudeRef", "E")))
                out.append(("GPSPosition", f"{lat:.6f}, {lon:.6f}"))
            out += [(k, v) for k, v in fields.items() if isinstance(v, str) and not k.startswith("GPS") and v]
        elif kind in ("tEXt", "zTXt"):
            key, _, rest = body.partition(b"\0")
            text = inflated(rest[1:]) if kind == "zTXt" else rest
            out.append((key.decode("latin-1"), text.decode("latin-1")))
        elif kind == "iTXt":
            key, _, rest = body.partition(b"\0")
            text = rest[2:].split(b"\0", 2)[-1]
            out.append((key.decode("latin-1"), (inflated(text) if rest[:1] == b"\1" else text).decode("utf-8", "replace")))
        elif kind == "comment":
            out.append(("Comment", body.decode("latin-1")))
        else:
            out.append((kind, f"{end - start} bytes"))
    return out


def metadata_batches(batches):
    """Node batches of ``(doc_id, content)`` batches; each goes out at ``BATCH_TEXT``, whatever its number of rows."""
    for batch in batches:
        rows, held = [], 0
        for doc, raw in zip(batch.column(0), batch.column(1)):
            doc = doc.as_py()
            try:
                found = metadata_fields(raw.as_py() or b"")
                own = [(doc, f"meta:{k}:{i}", i, "metadata", None, text, [("key", k)]) for i, (k, text) in enumerate(found)]
            except Exception as e:  # a damaged file is a row, whatever breaks in it
                own = [(doc, "container", 0, "container", None, None, [("error", str(e))])]
            for row in own:
                rows.append(row)
                held += len(row[5] or "")
                if held >= BATCH_TEXT:
                    yield node_batch(rows)
                    rows, held = [], 0
        yield node_batch(rows)


def parse(files: DataFrame) -> DataFrame:
    """Metadata nodes of ``files(doc_id, content)``; a file that can't be read has one ``container`` node with ``attrs.error``."""
    return files.select("doc_id", "content").mapInArrow(metadata_batches, NODES)


def node_batch(rows, boxes=None, pages=None) -> pa.RecordBatch:
    """Node rows ``(doc_id, node_id, ord, kind, role, text, attrs)`` with optional boxes and pages."""
    n = len(rows)
    rect = pa.struct([(k, pa.float64()) for k in ("x", "y", "width", "height")])
    col = lambda i, t: pa.array([r[i] for r in rows], t)
    return pa.RecordBatch.from_arrays(
        [
            col(0, pa.string()), col(1, pa.string()), col(2, pa.int32()), col(3, pa.string()), col(4, pa.string()), pa.nulls(n, pa.string()), pa.array(pages or [None] * n, pa.int32()),
            pa.array(boxes or [None] * n, rect), col(5, pa.string()), col(6, pa.map_(pa.string(), pa.string())),
        ],
        names=["doc_id", "node_id", "ord", "kind", "role", "parent", "page", "bbox", "text", "attrs"],
    )


def scrub(files: DataFrame) -> DataFrame:
    """``(doc_id, content, removed, bytes_removed, error)``: the same images without metadata."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    blocks = scan_container(raw or b"")
                    out.append((doc, strip_metadata(raw), [b[0] for b in blocks], sum(z - a for _, a, z in blocks), None))
                except Exception as e:  # as above
                    out.append((doc, None, None, None, str(e)))
            kinds = [pa.string(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_id", "content", "removed", "bytes_removed", "error"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, content binary, removed array<string>, bytes_removed long, error string")


def read_files(spark, path: str) -> DataFrame:
    """``(doc_id, content)`` of files, by path."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS doc_id", "content")
