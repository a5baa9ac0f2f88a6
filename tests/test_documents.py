"""The document source and sink, and what PDF files can hold, against hand-made files."""

import base64
import zlib

import pytest

from quillstone.sources import document, encode, files, pdf
from quillstone.sources.document import DocumentReader, Files
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LINES = ["Größe & <Maß> 漢字", "second line", "3 | 4 🙂"] * 9


def read(kind, lines):
    return [(n, part, content) for _, n, part, content, _ in files.parsed(kind, encode.ENCODERS[kind]("7", lines))]


def test_every_kind_comes_back():
    whole = "\n".join(LINES)
    pages = ["\n".join(p) for p in encode.paged(LINES)]
    assert read("txt", LINES) == [(1, "text", whole)]
    assert read("html", LINES) == [(1, "page", whole)]
    assert read("epub", LINES) == read("pdf", LINES) == [(i, "page", p) for i, p in enumerate(pages, 1)]
    assert read("docx", LINES) == [(i, "paragraph", x) for i, x in enumerate(LINES, 1)]
    assert read("pptx", LINES) == [row for i, p in enumerate(pages, 1) for row in ((i, "title", f"Part {i}"), (i, "text", p))]
    assert read("eml", LINES)[1] == (2, "body", whole)
    assert read("xlsx", ["a b c", "d"]) == [(1, "sheet", "| a | b | c |\n| --- | --- | --- |\n| d |  |  |")]


@pytest.mark.parametrize("kind", encode.ENCODERS)
def test_empty_and_broken_files(kind):
    found = files.parsed(kind, encode.ENCODERS[kind]("7", []))
    assert found[0][4] == "no content" if kind != "eml" else found[0][2] == "header"
    for data in (b"", b"broken", encode.ENCODERS[kind]("7", LINES)[:200]):
        assert len(files.parsed(kind, data)) >= 1  # a row, perhaps with an error; never a crash


def classic(content: bytes, font: str = "", more: str = "", root: str = "1 0 R", broken: bool = False) -> bytes:
    """A file with a plain cross-reference table."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: content, 5: f"<< /Type /Font /Subtype /Type1 {font} >>".encode()}
    out, places = bytearray(b"%PDF-1.4\n%comment\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out) + (999 if broken else 0)
    out += b"xref\n0 6\n0000000000 65535 f \n" + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in objects)
    return bytes(out) + f"trailer\n<< /Size 6 /Root {root} {more} >>\nstartxref\n{start}\n%%EOF".encode()


def stream(body: bytes, extra: str = "", length: int | None = None) -> bytes:
    return f"<< /Length {len(body) if length is None else length} {extra} >>\nstream\n".encode() + body + b"\nendstream"


SHOWN = b"BT /F1 12 Tf (a \\(b\\) \\101\\\n c) Tj 0 -14 Td [(one) -300 (two) -20 (three)] TJ (next) ' 10 0 Td (same) Tj 1 0 0 1 5 9 Tm <414243> Tj ET"
TEXT = "a (b) A c\nonetwo".replace("onetwo", "one twothree") + "\nnext same\nABC"


@pytest.mark.parametrize("broken", [False, True])
def test_plain_tables_and_a_scan_where_they_are_broken(broken):
    assert pdf.pages(classic(stream(SHOWN), broken=broken)) == [TEXT]
    assert pdf.pages(classic(stream(SHOWN, length=3), broken=broken)) == [TEXT]


def test_filters():
    hexed = SHOWN.hex().encode() + b">"
    assert pdf.pages(classic(stream(hexed, "/Filter /ASCIIHexDecode"))) == [TEXT]
    both = base64.a85encode(zlib.compress(SHOWN)) + b"~>"
    assert pdf.pages(classic(stream(both, "/Filter [/ASCII85Decode /FlateDecode]"))) == [TEXT]
    rows = b"".join(bytes([k % 5]) + row for k, row in enumerate(_filtered(SHOWN + b" " * (-len(SHOWN) % 7), 7)))
    assert pdf.pages(classic(stream(zlib.compress(rows), "/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 7 >>"))) == [TEXT]
    with pytest.raises(ValueError):
        pdf.pages(classic(stream(SHOWN, "/Filter /DCTDecode")))


def _filtered(data, width):
    """Rows under the five row filters in turn."""
    above = bytes(width)
    for k, at in enumerate(range(0, len(data), width)):
        row = data[at : at + width]
        out = bytearray()
        for i, x in enumerate(row):
            a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, nearest)[k % 5]) & 255)
        above = row
        yield bytes(out)


def test_fonts():
    table = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <41> <00660066> endbfchar 2 beginbfrange <42> <43> <0078> <44> <45> [<2713> <D83DDE42>] endbfrange"
    # the table stands where the page's resources do, as a stream of its own
    data = classic(stream(b"BT /F1 1 Tf (ABCDEz) Tj ET"), "/ToUnicode 6 0 R").replace(b"xref\n0 6", b"6 0 obj\n" + stream(table) + b"\nendobj\nxref\n0 6")
    assert pdf.pages(data.replace(b"startxref\n", b"startxref\n9"))[0] == "ffxy✓🙂"
    assert pdf.pages(classic(stream(b"BT /F1 1 Tf (a\\001b\\002) Tj ET"), "/Encoding << /Differences [1 /comma /uni20AC] >>")) == ["a,b€"]
    assert pdf.pages(classic(stream(b"BT /F1 1 Tf (\\200) Tj ET"), "/Encoding /WinAnsiEncoding")) == ["€"]


def test_encrypted_and_cyclic_files():
    with pytest.raises(pdf.Unreadable):
        pdf.pages(classic(stream(SHOWN), more="/Encrypt << >>"))
    assert files.parsed("pdf", classic(stream(SHOWN), more="/Encrypt << >>"))[0][4] == "Unreadable: encrypted"
    looped = classic(stream(SHOWN)).replace(b"/Kids [3 0 R]", b"/Kids [2 0 R 3 0 R]").replace(b"startxref\n", b"startxref\n9")
    assert pdf.pages(looped) == [TEXT]


def test_planning_packs_files_by_size(tmp_path):
    for i, size in enumerate([10, 3 << 20, 5 << 20, 0, 40, 9 << 20, 100]):
        (tmp_path / f"f{i}.txt").write_bytes(b"x" * size)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "g.txt").write_bytes(b"y")
    (tmp_path / ".z.txt").write_bytes(b"y")
    schema = StructType([StructField(c.split()[0], StringType()) for c in document.SCHEMA.split(", ")])
    reader = DocumentReader({"path": str(tmp_path), "split": str(8 << 20)}, schema)
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [2, 2, 1, 1, 1]  # a file costs its bytes and a megabyte more
    assert [path.rpartition("/")[2] for p in parts for path, _ in p.files] == [f"f{i}.txt" for i in range(7)]
    assert DocumentReader({"path": str(tmp_path), "glob": "*.pdf"}, schema).partitions() == [Files([])]


def test_source_and_sink(spark, tmp_path):
    document.register(spark)
    rows = [(f"n{i}", kind, "\n".join(LINES[:i])) for i, kind in enumerate([*encode.ENCODERS] * 3)]
    df = spark.createDataFrame(rows, document.WRITTEN).repartition(3)
    folder = str(tmp_path / "out")
    df.write.format("document").mode("append").save(folder)
    df.write.format("document").mode("append").save(folder)  # again: the same files
    (tmp_path / "out" / "deep").mkdir()
    (tmp_path / "out" / "deep" / "noname").write_bytes(encode.pdf("x", ["by its bytes"]))
    got = spark.read.format("document").load(folder)
    by = {}
    for r in got.collect():
        by.setdefault(r["path"].rpartition("/")[2], []).append((r["kind"], r["number"], r["part"], r["content"], r["error"]))
    assert set(by) == {f"{n}.{k}" for n, k, _ in rows} | {"noname"}
    for n, k, text in rows:
        assert sorted(by[f"{n}.{k}"], key=repr) == sorted(files.parsed(k, encode.ENCODERS[k](n, text.split("\n") if text else [])), key=repr)
    assert by["noname"] == [("pdf", 1, "page", "by its bytes", None)]
    only = got.where("kind = 'pdf' and size > 0").select("path").distinct()
    assert only.count() == 4
    big = spark.read.format("document").option("largest", "900").load(folder)
    assert {r["kind"] for r in big.where("size > 900").collect()} == {"oversize"} and big.where("kind = 'pdf'").where("size > 900").count() == 0


def test_a_list_opens_nothing(spark, tmp_path):
    import os

    document.register(spark)
    (tmp_path / "gone").mkdir()
    os.symlink(str(tmp_path / "absent"), tmp_path / "gone" / "a.txt")
    (tmp_path / "gone" / "b.txt").write_text("x")
    listed = spark.read.format("document").schema("path string, size long").load(str(tmp_path / "gone"))
    assert listed.count() >= 1
    with pytest.raises(Exception, match="unknown|no columns"):
        spark.read.format("document").schema("other string").load(str(tmp_path / "gone")).collect()


def test_files_are_made_in_even_parts(spark, monkeypatch):
    """A table of one part is dealt before its texts become files."""
    from quillstone.plans import files as plans

    monkeypatch.setattr(plans, "TEXTS", 20)
    sizes = [r["count"] for r in plans._lines(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 0.4 * sum(sizes)


def test_small_files_share_a_task(monkeypatch):
    found = [(f"/x/{i}.txt", 3000) for i in range(20_000)]
    monkeypatch.setattr(DocumentReader, "listed", lambda self: found)
    parts = lambda *names: DocumentReader({"path": "/x", "open": str(64 << 10)}, StructType([StructField(n, StringType()) for n in names])).partitions()
    named, opened = parts("path", "size"), parts("path", "content")
    assert len(named) == 1 and 10 < len(opened) < 40
    assert all([f for p in x for f in p.files] == found for x in (named, opened))


@pytest.mark.parametrize("lines", [[], [""], ["a", "é ü", "x" * 300], ["a\rb", "c"]])
def test_mail_is_what_the_library_writes(lines):
    from email.message import EmailMessage

    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "sender@example.org", "reader@example.org", "Document 12"
    mail.set_content("\n".join(lines) or "\n", cte="base64")
    assert encode.ENCODERS["eml"]("12", lines) == mail.as_bytes()
