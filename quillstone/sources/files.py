"""Files as typed pages: binary scan, then one parser per format, from the standard library only."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.detect import LARGEST, document_type

Row = tuple[int, str, str]  # number, kind, content


def scan(spark: SparkSession, path: str, glob: str | None = None, largest: int = LARGEST) -> DataFrame:
    """path, size, kind, content of all files below a folder; larger ones have no content and kind oversize."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    kind = document_type(F.lit(None).cast("string"), F.col("path"), F.col("content"))
    marked = F.when(F.lower("path").rlike(r"\.x?html?$"), "html").when(F.lower("path").endswith(".epub"), "epub").otherwise(kind)
    # two scans: the length is pushed down, and a file over the source's 2 GB is never opened, as its content isn't asked for
    read = reader.load(path).where(F.col("length") <= largest).select("path", F.col("length").alias("size"), marked.alias("kind"), "content")
    big = reader.load(path).where(F.col("length") > largest).select("path", F.col("length").alias("size"), F.lit("oversize").alias("kind"), F.lit(None).cast("binary").alias("content"))
    return read.unionByName(big)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def txt(data: bytes) -> list[Row]:
    content = data.decode("utf-8", "replace").strip()
    return [(1, "text", content)] if content else []


def docx(data: bytes) -> list[Row]:
    """Paragraphs, then tables with cells joined by bars; numbers run on."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))[0]
    paragraphs = [t for x in body if _local(x.tag) == "p" and (t := _texts(x).strip())]
    tables = []
    for t in (x for x in body.iter() if _local(x.tag) == "tbl"):
        rows = [" | ".join(_texts(c).strip() for c in r if _local(c.tag) == "tc") for r in t if _local(r.tag) == "tr"]
        tables.append("\n".join(rows))
    return [(i, k, c) for i, (k, c) in enumerate([*(("paragraph", p) for p in paragraphs), *(("table", t) for t in tables)], 1)]


def pptx(data: bytes) -> list[Row]:
    """Per slide: title, text and tables as rows of their own."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: list[Row] = []
    for i, name in enumerate(names, 1):
        for shape in ElementTree.fromstring(book.read(name)).iter():
            kind = _local(shape.tag)
            if kind == "sp":
                holder = next((x.get("type", "body") for x in shape.iter() if _local(x.tag) == "ph"), "text")
                label = {"title": "title", "ctrTitle": "title", "subTitle": "subtitle"}.get(holder, "text")
                lines = [_texts(p) for p in shape.iter() if _local(p.tag) == "p"]
                if content := "\n".join(x for x in lines if x.strip()):
                    out.append((i, label, content))
            elif kind == "tbl":
                rows = [" | ".join(_texts(c).strip() for c in r if _local(c.tag) == "tc") for r in shape if _local(r.tag) == "tr"]
                out.append((i, "table", "\n".join(rows)))
    return out


def xlsx(data: bytes) -> list[Row]:
    """Each sheet with content as a markdown table; empty rows go."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    out: list[Row] = []
    for name in sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        rows: list[list[str]] = []
        for r in (x for x in ElementTree.fromstring(book.read(name)).iter() if _local(x.tag) == "row"):
            line: list[str] = []
            for c in r:
                if place := c.get("r", ""):
                    column = 0
                    for ch in re.match(r"[A-Z]*", place).group():
                        column = column * 26 + ord(ch) - 64
                    line += [""] * (column - 1 - len(line))
                value = text = ""
                for x in c.iter():
                    if x.text:
                        name = _local(x.tag)
                        if name == "v":
                            value += x.text
                        elif name == "t":
                            text += x.text
                value = value or text
                line.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(x.strip() for x in line):
                rows.append(line)
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(x + [""] * (width - len(x))) + " |" for x in rows]
            out.append((len(out) + 1, "sheet", "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])))
    return out


def eml(data: bytes) -> list[Row]:
    """A header chunk, then every plain part."""
    mail = email.message_from_bytes(data, policy=email.policy.default)
    header = "\n".join(f"{k}: {mail[k]}" for k in ("From", "To", "Subject", "Date") if mail[k])
    parts = [str(p.get_content()).strip() for p in mail.walk() if p.get_content_type() == "text/plain"]
    return [(i, k, c) for i, (k, c) in enumerate([("header", header), *(("body", p) for p in parts)], 1) if c]


def pdf(data: bytes) -> list[Row]:
    """Pages with text; in a file without a page tree, every content stream is one."""
    from quillstone.sources import pdf as P

    try:
        found = P.pages(data)
    except P.Unreadable as bad:
        if "encrypted" in str(bad):
            raise
        found = _loose_streams(data)
    return [(i, "page", x) for i, x in enumerate(found, 1) if x]


def _loose_streams(data: bytes) -> list[str]:
    from quillstone.sources import pdf as P

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            body = zlib.decompress(m.group(1))
        except zlib.error:
            body = m.group(1)
        if b"BT" in body:
            out.append(P.shown(body, {}))
    return [x for x in out if x]


def image(data: bytes) -> list[Row]:
    return [(1, "image", "[image]")]


def html(data: bytes) -> list[Row]:
    """The text of a page: scripts and styles go, block ends become lines."""
    s = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", data.decode("utf-8", "replace"))
    s = re.sub(r"(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6]|title)>", "\n", s)
    lines = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in s.split("\n")]
    content = "\n".join(x for x in lines if x)
    return [(1, "page", content)] if content else []


def epub(data: bytes) -> list[Row]:
    """The pages of a book in the order of its archive."""
    book = zipfile.ZipFile(io.BytesIO(data))
    pages = [html(book.read(n)) for n in book.namelist() if re.search(r"\.x?html?$", n)]
    return [(i, "page", p[0][2]) for i, p in enumerate((p for p in pages if p), 1)]


PARSERS = {"html": html, "epub": epub, "txt": txt, "docx": docx, "pptx": pptx, "xlsx": xlsx, "eml": eml, "pdf": pdf, "image": image}


def parsed(kind: str, data: bytes | None) -> list[tuple]:
    """(kind, number, part, content, error) of a file; what can't be read is one row with an error."""
    try:
        rows = [(kind, n, part, content, None) for n, part, content in PARSERS[kind](data or b"")]
        return rows or [(kind, None, None, None, "no content")]
    except (KeyError, ValueError, IndexError, TypeError, zipfile.BadZipFile, ElementTree.ParseError, LookupError, zlib.error) as bad:
        return [(kind, None, None, None, f"{type(bad).__name__}: {bad}")]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "kind", "number", "part", "content", "error"]
    for batch in batches:
        for path, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            cols = list(zip(*[(path, *row) for row in parsed(kind, data)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.string()) for i, c in enumerate(cols)], names=names)


def pages(files: DataFrame) -> DataFrame:
    """path, kind, number, part, content, error for scanned files; what can't be read has an error."""
    return files.select("path", "kind", "content").mapInArrow(_pages, "path string, kind string, number int, part string, content string, error string")


def page_batches(rows: DataFrame, workers: int) -> DataFrame:
    """Pages with the batch that a pool of workers would take: int(n / workers + 1) pages each."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("path"))
    return rows.withColumn("batch", F.floor((F.col("number") - 1) / F.floor(n / workers + 1)))


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, size and time of files by name pattern; nothing is read from them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("size"), "modificationTime")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole stripped content of text files."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return read.select(F.input_file_name().alias("path"), F.trim("value").alias("content"))


def append_text(rows: DataFrame, path: str) -> None:
    """Appends a column of lines to a folder of text files."""
    rows.select(F.col(rows.columns[0]).cast("string")).write.mode("append").text(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a service's answers; a broken one has all columns null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
