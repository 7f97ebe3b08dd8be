"""Images, PDF files, pixels and streams."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from redoubt.errors import RedactionError
from redoubt.operators import raster
from redoubt.plans import queries
from redoubt.sources import image, pdf
from redoubt.streaming import streams


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*extra):
    return image.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + b"".join(extra) + chunk(b"IDAT", zlib.compress(bytes(20))) + chunk(b"IEND", b"")


def exif(order="<"):
    ratio = lambda *v: b"".join(struct.pack(order + "II", x, 1) for x in v)
    make = b"Maker\0"
    gps_at, data_at = 8 + 2 + 24 + 4, 8 + 2 + 24 + 4 + 2 + 48 + 4
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    ifd = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x010F, 2, 6, data_at) + struct.pack(order + "HHII", 0x8825, 4, 1, gps_at) + struct.pack(order + "I", 0)
    entries = struct.pack(order + "HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack(order + "HHII", 2, 5, 3, data_at + 6) + struct.pack(order + "HHI4s", 3, 2, 2, b"W\0\0\0") + struct.pack(order + "HHII", 4, 5, 3, data_at + 30)
    return head + ifd + struct.pack(order + "H", 4) + entries + struct.pack(order + "I", 0) + make + ratio(51, 30, 30) + ratio(0, 7, 30)


@pytest.mark.parametrize("order", ["<", ">"])
def test_jpeg_metadata(order):
    body = b"Exif\0\0" + exif(order)
    jfif, app1 = b"\xff\xe0" + struct.pack(">H", 4) + b"JF", b"\xff\xe1" + struct.pack(">H", 2 + len(body)) + body
    sof, scan = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 30, 1), b"\xff\xda\x00\x02pixels\xff\xd9"
    raw = b"\xff\xd8" + jfif + app1 + sof + scan
    fields = dict(image.metadata_fields(raw))
    assert fields["Make"] == "Maker" and fields["GPSPosition"] == "51.508333, -0.125000"
    assert image.strip_metadata(raw) == b"\xff\xd8" + jfif + sof + scan and image.dimensions(raw) == (30, 20)


def test_png_metadata():
    raw = png(chunk(b"tEXt", b"Author\0Me"), chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"long")), chunk(b"iTXt", b"Title\0\0\0\0\0T\xc3\xa9"))
    assert image.metadata_fields(raw) == [("Author", "Me"), ("Note", "long"), ("Title", "Té")]
    assert image.strip_metadata(raw) == png() and image.dimensions(raw) == (3, 2)
    for bad in (b"", b"GIF89a", image.PNG + b"\xff\xff\xff\xfftEXt" + bytes(10)):
        with pytest.raises(RedactionError):
            image.scan_container(bad)
    assert image.read_exif(b"II*\0\xff\xff\xff\xff") == {}


def test_metadata_batches_are_bounded_by_their_text():
    size = 1 << 20
    files = [png(chunk(b"zTXt", b"Note\0\0" + zlib.compress(bytes([97 + i % 26]) * size))) if i % 5 else b"none" for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(30)]), pa.array(files, pa.binary())], names=["doc_id", "content"])
    out = list(image.metadata_batches([batch]))
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in out) < image.BATCH_TEXT + size
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [str(i) for i in range(30)]
    assert all(r["text"] == (chr(97 + i % 26) * size if i % 5 else None) for i, r in enumerate(rows))


def test_pixels():
    pixels = np.random.default_rng(1).integers(0, 256, 32 * 32 * 4, dtype=np.uint8).tobytes()
    rect = {"x": 8.5, "y": 8.5, "width": 8, "height": 8}
    for name in raster.KERNELS:
        out = np.frombuffer(raster.burn(pixels, 32, 32, [{"op_id": "a", "strategy": name, "rect": rect}], True), dtype=np.uint8).reshape(32, 32, 4)
        was = np.frombuffer(pixels, dtype=np.uint8).reshape(32, 32, 4)
        outside = np.ones((32, 32), dtype=bool)
        outside[6:19, 6:19] = False
        assert (out[outside] == was[outside]).all() and (out[6:19, 6:19] != was[6:19, 6:19]).any()
    other = bytes(255 - b for b in pixels)
    for name in ("scramble", "hatch", "noise-mosaic", "blackout"):  # nothing of the original is left
        a, b = (np.frombuffer(raster.burn(p, 32, 32, [{"op_id": "a", "strategy": name, "rect": rect}]), dtype=np.uint8).reshape(32, 32, 4)[6:19, 6:19] for p in (pixels, other))
        assert (a == b).all()
    with pytest.raises(RedactionError):
        raster.burn(pixels, 32, 32, [{"op_id": "a", "strategy": "pixelate", "rect": rect}])
    with pytest.raises(RedactionError):
        raster.burn(pixels, 5, 5, [])


def sample_pdf(**more):
    n, r = pdf.Name, pdf.Ref
    paint = b"BT /F1 12 Tf 72 700 Td (Marta \\(Feld\\) 212) Tj 0 -20 Td [(He) -300 <6c6c6f>] TJ ET q 0 g 70 695 220 16 re f Q 1 g 0 0 5 5 re f"
    objects = {
        1: {"Type": n("Catalog"), "Pages": r(2)}, 2: {"Type": n("Pages"), "Kids": [r(3)], "Count": 1}, 3: {"Type": n("Page"), "Parent": r(2), "MediaBox": [0, 0, 612, 792], "Contents": [r(4)], "Annots": [r(6)]},
        4: pdf.Stream({"Filter": n("FlateDecode")}, zlib.compress(paint)), 5: {"Author": b"M. (F)", "Title": b"\xfe\xff\x00T"}, 6: {"Type": n("Annot"), "Contents": b"a note"}, 7: {"Type": n("Filespec"), "F": b"a.xls"},
        8: pdf.Stream({"Type": n("Metadata")}, b"<x><dc:creator><li>Someone</li></dc:creator></x>"),
    }
    return pdf.assemble(objects, {"Root": r(1), "Info": r(5)} | more)


def test_pdf_reading():
    nodes = {n[0]: n for n in pdf.file_nodes(sample_pdf())}
    assert nodes["p0s0t0"][3] == "Marta (Feld) 212" and nodes["p0s0t1"][3] == "He llo"
    assert dict(nodes["p0s0r0"][4])["redactionBar"] == "true" and dict(nodes["p0s0r1"][4])["redactionBar"] == "false"
    assert (nodes["info:Author"][3], nodes["info:Title"][3], nodes["xmp:Author"][3], nodes["p0a0"][3], dict(nodes["file:7"][4])["name"]) == ("M. (F)", "T", "Someone", "a note", "a.xls")
    newer = sample_pdf() + b"4 0 obj\n" + pdf.dump(pdf.Stream({}, b"BT (new) Tj ET")) + b"\nendobj\n"
    found = {n[0].partition(":")[0]: n for n in pdf.file_nodes(newer)}
    assert "Marta (Feld) 212" in found["revision"][3] and found["p0s0t0"][3] == "new"
    for bad in (b"", b"%PDF-1.4\n1 0 obj\n" + b"[" * 100, sample_pdf(Encrypt={"V": 1})):
        try:
            pdf.file_nodes(bad)
        except RedactionError:
            continue
        raise AssertionError(bad[:20])


def test_pdf_filters():
    f, n = pdf.File(), pdf.Name
    assert f.data(pdf.Stream({"Filter": n("ASCIIHexDecode")}, b"48 65>")) == b"He"
    assert f.data(pdf.Stream({"Filter": [n("ASCII85Decode"), n("FlateDecode")]}, __import__("base64").a85encode(zlib.compress(b"text")) + b"~>")) == b"text"
    assert f.data(pdf.Stream({"Filter": n("DCTDecode")}, b"x")) is None
    rows = bytes([2, 1, 2, 3]) + bytes([2, 1, 1, 1])
    assert f.data(pdf.Stream({"Filter": n("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 3}}, zlib.compress(rows))) == bytes([1, 2, 3, 2, 3, 4])


def test_pdf_writing():
    ops = [
        {"loc_kind": "text", "node_id": "p0s0t0", "strategy": "replace", "replacement": "[X]"}, {"loc_kind": "text", "node_id": "p0s0t1", "strategy": "remove", "replacement": None},
        {"loc_kind": "node", "node_id": "info:Author", "strategy": "remove"}, {"loc_kind": "node", "node_id": "xmp:Author", "strategy": "remove"}, {"loc_kind": "node", "node_id": "p0a0", "strategy": "remove"},
        {"loc_kind": "node", "node_id": "file:7", "strategy": "remove"}, {"loc_kind": "region", "node_id": "page0", "strategy": "blackout", "rect": {"x": 1, "y": 1, "width": 9, "height": 9}, "page": 0},
    ]
    raw = pdf.rewrite(sample_pdf(), ops)
    nodes = {n[0]: n for n in pdf.file_nodes(raw)}
    assert nodes["p0s0t0"][3] == "[X]" and not {"p0s0t1", "info:Author", "xmp:Author", "p0a0", "file:7"} & set(nodes) and "info:Title" in nodes and "p0s1r0" in nodes
    assert b"Feld" not in raw and b"a note" not in raw
    with pytest.raises(RedactionError):
        pdf.rewrite(sample_pdf(), [{"loc_kind": "node", "node_id": "nope", "strategy": "remove"}])
    scan = pdf.image_pdf([{"width": 2, "height": 1, "rgb": bytes(range(6))}, {"width": 2, "height": 2, "jpeg": b"\xff\xd8x"}])
    one, two = pdf.images(scan)
    assert (one["data"], one["page"], two["filter"], two["page"]) == (bytes(range(6)), 0, "DCTDecode", 1)
    assert pdf.looks_like_a_page(1000, 1500) and not pdf.looks_like_a_page(3000, 500)


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    live = streams.drain(streams.findings(streams.read_stream(spark, str(tmp_path / "docs"))))
    batch = queries.D.patterns(queries.T.paragraphs(docs))
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "id", "value").collect()))
    assert pick(live) == pick(batch) and live.count() > 5


def test_long_texts_and_crafted_files(spark):
    long = b"x" * (3 << 20)
    png = image.PNG + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(long)) + chunk(b"iTXt", b"Title\0\1\0en\0t\0" + zlib.compress(long)) + chunk(b"IEND", b"")
    assert [(k, len(v)) for k, v in image.metadata_fields(png)] == [("Comment", len(long)), ("Title", len(long))]
    # A GPS position of the text type, by a damaged writer.
    gps = struct.pack("<HHHII", 2, 2, 2, 4, 0x00003135) + struct.pack("<HHII", 4, 2, 4, 0x00003135) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8825, 4, 1, 26) + struct.pack("<I", 0) + gps
    broken = image.PNG + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    bomb = image.PNG + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(bytes(65 << 20))) + chunk(b"IEND", b"")
    files = spark.createDataFrame([("gps", bytearray(broken)), ("bomb", bytearray(bomb)), ("fine", bytearray(png))], "doc_id string, content binary")
    found = image.parse(files).collect()
    assert {r.doc_id for r in found if r.kind == "container"} == {"bomb"} and sum(r.doc_id == "fine" for r in found) == 2
    assert not [r for r in found if r.doc_id == "gps" and r.kind == "metadata"]
