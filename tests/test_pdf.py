"""PDF files made by hand."""

import zlib

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, ingest
from lectern.sources import pdf

TREE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> /Contents 4 0 R >>"}
FONTS = {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Times-Bold >>"}


def stream(body, more=b"", length=None):
    return b"<< /Length " + str(len(body) if length is None else length).encode() + more + b" >>\nstream\n" + body + b"\nendstream"


def file(objects, trailer=b""):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"trailer << /Root 1 0 R " + trailer + b">>\n%%EOF"


def read(spark, folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.pdf").write_bytes(data)
    found = pdf.pages(spark, str(folder))
    return found, pdf.spans(found)


def lines(spans):
    return [(r.line, r.text, r.size, r.bold) for r in sorted(spans.collect(), key=lambda r: (r.page, r.pos))]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (rb"BT /F1 12 Tf (a \(b\) (c) \\ \101\7) Tj ET", [(0, "a (b) (c) \\ A\7", 12.0, False)]),
        (b"BT /F2 9.5 Tf [(Hel) 20 (lo) -250 (you) -10 <21 2>] TJ ET", [(0, "Hello you! ", 9.5, True)]),
        (b"BT /F1 10 Tf (x) Tj 5 0 Td (y) Tj 0 -12 Td (z) Tj T* (u) Tj (v) ' ET", [(0, "x", 10.0, False), (0, "y", 10.0, False), (1, "z", 10.0, False), (2, "u", 10.0, False), (3, "v", 10.0, False)]),
        (b"BT /F1 1 Tf 14 0 0 14 72 700 Tm (big) Tj 1 0 0 2 0 0 Tm (small) Tj ET BT (next) Tj ET", [(0, "big", 14.0, False), (1, "small", 2.0, False), (2, "next", 1.0, False)]),
        (b"BT /F1 10 Tf (5 0 Td /F2 3 Tf BT) Tj ET", [(0, "5 0 Td /F2 3 Tf BT", 10.0, False)]),
        (b"q BI /W 1 ID (no) Tj EI Q BT /F9 10 Tf (one\\\ntwo) Tj ET", [(0, "onetwo", 10.0, False)]),
        (b"BT (\x93q\x94 \x80) Tj ET", [(0, "“q” €", 0.0, False)]),
        (b"BT /F1 10 Tf () Tj [] TJ <> Tj ET", []),
        (b"", []),
    ],
)
def test_operators(spark, tmp_path, content, want):
    assert lines(read(spark, tmp_path / "in", a=file(TREE | {4: stream(content)} | FONTS))[1]) == want


def test_pages_in_order_of_a_nested_tree_with_inherited_fonts_and_object_streams(spark, tmp_path):
    inner = {3: b"<< /Type /Page /Contents [7 0 R 8 0 R] >>", 9: b"<< /Type /Pages /Kids [ 3 0 R ] >>", 10: b"<< /Type /Page /Contents 11 0 R >>"}
    at, index, body = 0, [], b""
    for n, b in inner.items():
        index.append(f"{n} {at}")
        body += b + b" "
        at = len(body)
    head = " ".join(index).encode() + b" "
    objects = {1: TREE[1], 2: b"<< /Type /Pages /Kids [9 0 R 10 0 R] /Resources 12 0 R >>", 12: b"<< /Font 13 0 R >>", 13: b"<< /F1 6 0 R >>"} | FONTS
    objects |= {20: stream(zlib.compress(head + body), b" /Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(head))}
    objects |= {7: stream(b"BT /F1 11 Tf (one"), 8: stream(b") Tj ET", length=3), 11: stream(zlib.compress(b"BT /F1 11 Tf (endobj two) Tj ET"), b" /Filter [ /FlateDecode ]")}
    found, spans = read(spark, tmp_path / "in", a=file(objects))
    assert [(r.page, r.error) for r in found.orderBy("page").collect()] == [(0, None), (1, None)]
    assert lines(spans) == [(0, "one\n", 11.0, True), (0, "endobj two", 11.0, True)]
    marked = chunking.layout_headings(spans.withColumnRenamed("page", "page_id")).orderBy("page_id").collect()
    assert [r.markdown for r in marked] == ["### one\n", "### endobj two"]


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    good = TREE | {4: stream(b"BT (x) Tj ET")} | FONTS
    files = {
        "good": file(good), "good too + 1%": file(good), "no byte": b"", "empty": b"", "text": b"hello", "cut": file(good)[:50], "no_pages": b"%PDF-1.4\n%%EOF", "blank": file(TREE | {4: stream(b"q Q")} | FONTS),
        "locked": file(good, b"/Encrypt 9 0 R "), "filter": file(good | {4: stream(b"x", b" /Filter /LZWDecode")}), "damaged": file(good | {4: stream(b"no zlib", b" /Filter /FlateDecode")}),
        "circle": file(good | {2: b"<< /Type /Pages /Kids [2 0 R] >>"}), "composite": file(good | {5: b"<< /Type /Font /Subtype /Type0 >>"}),
    }
    found, spans = read(spark, tmp_path / "in", **files)
    failed = {r.path.rsplit("/", 1)[1][:-4]: r.error for r in pdf.failures(found, spans).collect()}
    assert failed == {"no%20byte": "not a PDF", "empty": "not a PDF", "text": "not a PDF", "cut": "an object has no end", "no_pages": "no pages", "blank": "no text", "locked": "encrypted", "filter": "a filter isn't known", "damaged": "broken", "circle": "the tree of pages is broken", "composite": "a font is composite"}
    watched, seen = ingest.observed(found, "scan", failed=F.count_if(F.col("error").isNotNull()))
    assert len(watched.collect()) == 13 and seen.get == {"n": 13, "failed": 10}


def test_a_very_long_text(spark, tmp_path):
    text = b"word \\( " * 60_000
    assert len(lines(read(spark, tmp_path / "in", a=file(TREE | {4: stream(b"BT (" + text + b") Tj [(" + text + b") 3] TJ ET")} | FONTS))[1])[0][1]) == 7 * 60_000


def test_no_files(spark, tmp_path):
    found, spans = read(spark, tmp_path / "in")
    assert found.collect() == [] and spans.collect() == [] and pdf.failures(found, spans).collect() == []
