"""One text as a file of each kind: the least that readers of the format need."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib
from email.message import EmailMessage
from xml.sax.saxutils import escape

#: Lines of a page, slide or chapter.
PAGE = 20


def paged(lines: list[str], size: int = PAGE) -> list[list[str]]:
    return [lines[i : i + size] for i in range(0, len(lines), size)]


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def txt(name: str, lines: list[str]) -> bytes:
    return "\n".join(lines).encode()


def html(name: str, lines: list[str]) -> bytes:
    body = "".join(f"<p>{escape(x)}</p>\n" for x in lines)
    return f"<html><head><style>p {{}}</style></head><body>{body}</body></html>".encode()


def epub(name: str, lines: list[str]) -> bytes:
    return _zip({f"page{i:06d}.xhtml": html(name, p).decode() for i, p in enumerate(paged(lines), 1)})


def docx(name: str, lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def pptx(name: str, lines: list[str]) -> bytes:
    space = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda i, p: f'<p:sld {space}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Part {i}</a:t></a:p></p:sp><p:sp>' + "".join(f"<a:p><a:t>{escape(x)}</a:t></a:p>" for x in p) + "</p:sp></p:sld>"
    return _zip({f"ppt/slides/slide{i}.xml": slide(i, p) for i, p in enumerate(paged(lines), 1)})


def xlsx(name: str, lines: list[str]) -> bytes:
    """A row for each line, a cell for each word."""
    row = lambda i, x: f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t>{escape(w)}</t></is></c>' for w in x.split(" ")) + "</row>"
    rows = "".join(row(i, x) for i, x in enumerate(lines, 1))
    return _zip({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'})


def eml(name: str, lines: list[str]) -> bytes:
    if name.isascii() and name.isalnum() and len(name) < 50:
        # what the library below makes of it, without its parsing of every header
        body = base64.encodebytes(b"\n".join(("\n".join(lines) or "\n").encode().splitlines()) + b"\n")
        head = f'From: sender@example.org\nTo: reader@example.org\nSubject: Document {name}\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\nMIME-Version: 1.0\n\n'
        return head.encode() + body
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "sender@example.org", "reader@example.org", f"Document {name}"
    mail.set_content("\n".join(lines) or "\n", cte="base64")
    return mail.as_bytes()


def pdf(name: str, lines: list[str]) -> bytes:
    """Objects in an object stream, a cross-reference stream, one font whose codes are the text's own characters in order."""
    codes = {c: i for i, c in enumerate(dict.fromkeys("".join(lines)), 1)}
    hexes = {ord(c): f"{i:04x}" for c, i in codes.items()}
    shown = lambda x: "<" + x.translate(hexes) + "> Tj T*"
    pages = paged(lines)
    first = 6
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>", 3: "<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /ToUnicode 4 0 R >>"}
    inner |= {first + 2 * i: f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R >>" for i in range(len(pages))}
    pairs = list(codes.items())
    table = "".join(f"{len(p)} beginbfchar\n" + "".join(f"<{i:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, i in p) + "endbfchar\n" for p in paged(pairs, 100))
    streams = {4: ("", f"1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n{table}".encode())}
    streams |= {first + 2 * i + 1: ("", ("BT /F1 12 Tf 14 TL 72 720 Td\n" + "\n".join(map(shown, p)) + "\nET").encode()) for i, p in enumerate(pages)}
    heads, body = [], b""
    for n, x in inner.items():
        heads.append(f"{n} {len(body)}")
        body += x.encode() + b"\n"
    head = (" ".join(heads) + "\n").encode()
    streams[5] = (f" /Type /ObjStm /N {len(inner)} /First {len(head)}", head + body)
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n in sorted(streams):
        extra, data = streams[n]
        data = zlib.compress(data)
        places[n] = len(out)
        out += f"{n} 0 obj\n<<{extra} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    size = first + 2 * len(pages) + 1
    order = {n: i for i, n in enumerate(inner)}
    rows = []
    for n in range(size):
        entry = (1, len(out), 0) if n == size - 1 else (2, 5, order[n]) if n in order else (1, places[n], 0) if n in places else (0, 0, 0)
        rows.append(bytes([entry[0]]) + entry[1].to_bytes(5, "big") + entry[2].to_bytes(4, "big"))
    # rows as differences from the one above, as most writers have them
    above, data = bytes(10), bytearray()
    for row in rows:
        data += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    data = zlib.compress(bytes(data))
    start = len(out)
    out += f"{size - 1} 0 obj\n<< /Type /XRef /Size {size} /Root 1 0 R /W [1 5 4] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 10 >> /Length {len(data)} >>\nstream\n".encode() + data
    return bytes(out) + f"\nendstream\nendobj\nstartxref\n{start}\n%%EOF\n".encode()


ENCODERS = {"txt": txt, "html": html, "epub": epub, "docx": docx, "pptx": pptx, "xlsx": xlsx, "eml": eml, "pdf": pdf}
