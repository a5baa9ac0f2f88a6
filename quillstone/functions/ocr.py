"""Scanned-page markdown: ordered clean-up, tables with their places, prompts chosen by content."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: The ordered rewrites of scanned markdown, pattern and replacement.
REWRITES = [
    (r"(?i)<!--\s*PageFooter\s*=\s*[\"']?[^\"']*[\"']?\s*-->", ""),
    (r"(?i)<!--\s*PageNumber\s*=\s*[\"']?[^\"']*[\"']?\s*-->", ""),
    (r"(?i)<strong[^>]*>(.*?)</strong>", r"**$1**"),
    (r"(?i)<b[^>]*>(.*?)</b>", r"**$1**"),
    (r"\*\*(.*?)\*\*", r"**$1**"),
    (r"__(.*?)__", r"**$1**"),
    (r"</?p[^>]*>", ""),
    (r"</?div[^>]*>", ""),
    (r"<br[^>]*/?>", "\n"),
    (r"(?m)^(\d+)\\\.(\s+)", r"$1.$2"),
    (r"(?m)^\\-(\s+)", r"-$1"),
    (r"(?m)^(\d+\.\d+(?:\.\d+)*+)\s+([A-Z][^.]*?)(?=\n|\z)", r"### $1 $2"),
    (r"(?m)^(\d+\.\s+[A-Z\s]+):?\s*$", r"## $1"),
    (r"(?im)^([a-z][\.\)])\s+", r"- **$1** "),
    (r"(?im)^([ivxlcdm]+[\.\)])\s+", r"- **$1** "),
    *[(p, "\n\n**$1**\n") for p in T.NOTES],
    (r"\n\s*\n\s*\n", "\n\n"),
    (r"[ \t]+", " "),
]
TABLE_TERMS = ["amount", "limit", "premium", "cost", "rate", "%", "$", "coverage", "maximum", "minimum"]
FOOTNOTE_TERMS = ["condition", "exception", "exclude", "requirement", "restriction", "limitation", "not covered", "unless", "provided"]
# --- end of fixed values ---


def clean_markdown(col: Column) -> Column:
    """The rewrites in order; page breaks stay, as pages are counted by them."""
    for pattern, by in REWRITES:
        col = F.regexp_replace(col, pattern, by)
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def page_index(before: Column) -> Column:
    """Page of a place: the page breaks in the text before it."""
    return F.size(F.split(before, "<!-- PageBreak -->")) - 1


def table_headers(table: Column, most: int = 5) -> Column:
    """The first cells of the header row, lower-cased."""
    cells = F.regexp_extract_all(table, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1))
    row = F.split(F.regexp_replace(F.regexp_extract(table, r"(?m)^\s*\|(.*)\|\s*$", 1), r"\s*\|\s*", "|"), r"\|")
    return F.slice(F.transform(F.when(F.size(cells) > 0, cells).otherwise(row), lambda c: F.lower(T.strip_html(c))), 1, most)


def prompt_kind(question: Column, tables: Column, footnotes: Column) -> Column:
    """table, footnote or structure: which instructions fit a question and what was found."""
    low = F.lower(question)
    return F.when(T.contains_any(low, TABLE_TERMS) & (tables >= 2), "table").when(T.contains_any(low, FOOTNOTE_TERMS) & (footnotes >= 1), "footnote").otherwise("structure")


_TABLES = [re.compile(p) for p in T.TABLES]


def take_tables(text: str) -> tuple[list[dict], str]:
    """Tables, the last of the text first, and the text with a placeholder for each.

    All kinds are looked for in the text as it came; where two finds overlap, the kind that
    is first in the list has the place. So equal tables keep places of their own.
    """
    claimed: list[tuple[int, int, int]] = []
    for kind, pattern in enumerate(_TABLES):
        for m in pattern.finditer(text):
            at = bisect.bisect(claimed, (m.start(),))
            if (at == 0 or claimed[at - 1][1] <= m.start()) and (at == len(claimed) or m.end() <= claimed[at][0]):
                claimed.insert(at, (m.start(), m.end(), kind))
    pages = [m.start() for m in re.finditer("<!-- PageBreak -->", text)]
    found = [
        {"id": f"table_{i}", "text": text[start:end], "start_pos": start, "end_pos": end, "page_index": bisect.bisect_left(pages, start), "pattern_type": kind}
        for i, (start, end, kind) in enumerate(reversed(claimed))
    ]
    edges = [0, *(x for start, end, _ in claimed for x in (start, end)), len(text)]
    kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    marks = [f"\n\n[TABLE_{t['id']}_PLACEHOLDER]\n\n" for t in reversed(found)]
    return found, "".join(x for pair in itertools.zip_longest(kept, marks, fillvalue="") for x in pair)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("id", pa.string()), ("text", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("page_index", pa.int32()), ("pattern_type", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("tables", pa.list_(item)), ("rest", pa.string())])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tables, rest = take_tables(text or "")
            rows.append({"doc_id": doc_id, "tables": tables, "rest": rest})
        yield pa.RecordBatch.from_pylist(rows, schema)


def extract_tables(docs: DataFrame) -> DataFrame:
    """doc_id, tables (with place, page and pattern), rest with placeholders."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    item = "struct<id:string,text:string,start_pos:int,end_pos:int,page_index:int,pattern_type:int>"
    return rows.mapInArrow(_extract, f"doc_id long, tables array<{item}>, rest string")
