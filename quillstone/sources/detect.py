"""What a fetched document is and which way it goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1024 * 1024 * 1024
DIRECT = 512 * 1024
# --- fixed values: names of formats ---
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".zip": "zip", ".txt": "txt", ".text": "txt", ".eml": "eml"} | dict.fromkeys([".jpg", ".jpeg", ".png", ".gif", ".bmp"], "image")
HEADER_PARTS = [("text", "txt"), ("html", "txt"), ("pdf", "pdf"), ("wordprocessingml", "docx"), ("msword", "docx"), ("presentationml", "pptx"), ("powerpoint", "pptx"), ("spreadsheetml", "xlsx"), ("excel", "xlsx"), ("zip", "zip"), ("message/rfc822", "eml")]
IMAGE_MAGIC = ["FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D"]
DIRECT_MIME = ["application/json", "application/xml", "application/pdf", "application/javascript", "application/rtf"]
DIRECT_EXTENSIONS = [".txt", ".html", ".css", ".js", ".xml", ".json", ".md", ".csv", ".rtf", ".pdf", ".py"]
# --- end of fixed values ---


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))


def document_type(content_type: Column, name: Column, content: Column) -> Column:
    """By header, else extension, else first bytes, else txt."""
    kind = F.lower(content_type)
    head = F.upper(F.hex(F.substring(content, 1, 8)))
    inside = lambda s: F.contains(content, F.lit(bytearray(s.encode())))  # noqa: E731  of bytes, so never across a half of one
    zipped = F.when(inside("word/"), "docx").when(inside("ppt/"), "pptx").when(inside("xl/"), "xlsx").otherwise("zip")
    top = F.substring(content, 1, 1000)
    magic = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), zipped)
    for m in IMAGE_MAGIC:
        magic = magic.when(head.startswith(m), "image")
    magic = magic.when(F.contains(top, F.lit(bytearray(b"From:"))) | F.contains(top, F.lit(bytearray(b"To:"))), "eml").otherwise("txt")
    by_name = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension(name)]
    by_header = F.lit(None).cast("string")
    for part, found in reversed(HEADER_PARTS):
        by_header = F.when(kind.contains(part), found).otherwise(by_header)
        if part == "zip":  # images are told before archives
            by_header = F.when(kind.startswith("image/"), "image").otherwise(by_header)
    return F.coalesce(by_header, by_name, magic)


def direct(content_type: Column, name: Column) -> Column:
    """Text-like types, known extensions, or a web address without an extension."""
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    ext = extension(F.regexp_replace(name, r"[?#].*$", ""))
    return kind.isin(DIRECT_MIME) | kind.startswith("text/") | ext.isin(DIRECT_EXTENSIONS) | ((ext == "") & F.coalesce(name, F.lit("")).startswith("http"))


def route(size: Column, content_type: Column, name: Column, content: Column, cached: Column | None = None) -> Column:
    """oversize, image, direct, cached, zip_rejected or parse, in this order."""
    by_name = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension(name)]
    kind = F.coalesce(by_name, document_type(content_type, name, content))
    return (
        F.when(size > LARGEST, "oversize")
        .when(kind == "image", "image")
        .when(direct(content_type, name) & (size < DIRECT), "direct")
        .when(F.lit(False) if cached is None else cached, "cached")
        .when(kind == "zip", "zip_rejected")
        .otherwise("parse")
    )
