"""HTML and pipe tables: cells with spans, grids, merged rows, pages stitched, text for a reader.

A table is sequential by nature (a cell's place depends on all before it), so a document's
tables are handled together in one Arrow batch row; documents are independent.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TABLE = re.compile(r"<table[^>]*>.*?</table>", re.S | re.I)
_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.S | re.I)
_CELL = re.compile(r"<(th|td)([^>]*)>(.*?)</\1>", re.S | re.I)
_BREAK = re.compile(r"<!--\s*PageBreak\s*-->", re.I)
_PIPE = re.compile(r"(?:^[ \t]*\|.*\|[ \t]*$\n?){2,}", re.M)

# --- fixed values: the row label pattern, names that stand for one column, words that mark a column's role ---
ROW_LABEL = r"^\s*\(?\s*(?:([ivxlcdm]{1,8})|([A-Za-z])|(\d{1,3}))\s*\)?\s*(?:\(\s*[a-zA-Z]\s*\))?\s*[\.)]?\s*$"
SAME_COLUMN = {
    "limits of covered expenses": {"covered", "expenses", "expense", "limits", "covered expenses"},
    "sum insured": {"sum insured", "insured amount", "sum assured"},
    "silver": {"silver", "silver plan", "silver variant", "silver option"},
    "gold": {"gold", "gold plan", "gold plus", "gold variant", "gold option"},
    "diamond": {"diamond", "diamond plan"},
    "platinum": {"platinum", "platinum plan", "platinum plus", "platinum variant"},
    "bronze": {"bronze", "bronze plan"},
    "elite": {"elite", "elite plan"},
    "supreme": {"supreme", "supreme plan"},
    "premium": {"premium", "premium plan"},
    "ultimate": {"ultimate", "ultimate plan"},
    "classic": {"classic", "classic plan"},
    "standard": {"standard plan"},
    "basic": {"basic plan"},
    "prime": {"prime", "prime plan"},
    "deluxe": {"deluxe", "deluxe plan"},
}
PLANS = ["SILVER", "GOLD", "DIAMOND", "PLATINUM"]
DESCRIPTIONS = [
    "expense", "benefit", "coverage", "covered", "description", "item", "particulars", "feature", "features",
    "service", "services", "treatment", "procedure", "head", "details", "clause",
]
# --- end of fixed values ---
_LABEL = re.compile(ROW_LABEL, re.I)


@dataclass
class Grid:
    headers: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    title: str | None = None


def clean(html: str) -> str:
    return re.sub(r"<[^>]+>", "", html).replace("&amp;", "&").replace("&nbsp;", " ").strip()


def is_label(cell: str) -> bool:
    return 0 < len(cell.strip()) <= 10 and bool(_LABEL.match(cell))


class Cell(NamedTuple):
    text: str
    down: int = 1
    across: int = 1
    heads: bool = False


def _html_cell(m: re.Match) -> Cell:
    spans = dict(re.findall(r"(rowspan|colspan)\s*=\s*[\"']?(\d+)", m[2].lower()))
    down, across = (max(1, int(spans.get(k, 1))) for k in ("rowspan", "colspan"))
    return Cell(clean(m[3]), down, across, m[1].lower() == "th")


def cells(table: str) -> list[list[Cell]]:
    """The rows of an HTML or pipe table that have a cell; of a pipe table the first row is its heading."""
    if "<tr" in table.lower():
        rows = ([_html_cell(m) for m in _CELL.finditer(row)] for row in _ROW.findall(table))
        return [r for r in rows if r]
    lines = [[c.strip() for c in x.strip().strip("|").split("|")] for x in table.splitlines() if x.strip()]
    lines = [x for x in lines if not all(re.fullmatch(r":?-+:?", c) for c in x)]
    return [[Cell(c, heads=i == 0) for c in x] for i, x in enumerate(lines)]


def grid(rows: list[list[Cell]]) -> list[list[str]]:
    """Every cell repeated over the places it spans: along its row, and down its first column.

    Places are taken in a map of (row, column), so a cell comes to lie in the first free
    column of its row, and what would lie beyond the widest row is left out.
    """
    width = max((sum(c.across for c in r) for r in rows), default=0)
    taken: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        free = 0
        for cell in row:
            while (y, free) in taken:
                free += 1
            across = [(y, x) for x in range(free, free + cell.across)]
            down = [(y + k, free) for k in range(1, cell.down)]
            taken |= dict.fromkeys(across + down, cell.text)
            free += cell.across
    return [[taken.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def merge_rows(rows: list[list[str]]) -> list[list[str]]:
    """Consecutive rows with one label become one row of their distinct values."""
    out = []
    for _, group in itertools.groupby(rows, key=lambda r: r[0].strip() if r else ""):
        first, *more = group
        if more:
            values = [dict.fromkeys(filter(None, (r[i].strip() for r in (first, *more) if i < len(r)))) for i in range(1, len(first))]
            first = first[:1] + [" ".join(v) for v in values]
        out.append(first)
    return out


#: What a row of the grid is, by the first rule that holds: (name, rule over the row's cells and values and the table so far).
_KINDS = (
    ("title", lambda raw, line, g: g.title is None and len(line) > 1 and line[0] != "" and len(set(line)) == 1),
    ("data", lambda raw, line, g: bool(g.headers or g.rows)),
    ("data", lambda raw, line, g: not any(c.heads for c in raw)),
    ("headers", lambda raw, line, g: _names_columns(line)),
    ("data", lambda raw, line, g: True),
)


def _names_columns(line: list[str]) -> bool:
    """Whether a row may be the headings: its first cell is no label, and not empty beside filled ones (a row that goes on from above)."""
    first, rest = line[0].strip(), any(x.strip() for x in line[1:])
    return not is_label(line[0]) and (bool(first) or not rest)


def parse(table: str) -> Grid:
    """Title row, headers and merged data rows of one table."""
    found, raw = Grid(), cells(table)
    for source, line in zip(raw, grid(raw), strict=True):
        kind = next(name for name, rule in _KINDS if rule(source, line, found))
        if kind == "title":
            found.title = line[0]
        elif kind == "headers":
            found.headers = line
        else:
            found.rows.append(line)
    if not found.headers and found.rows and _names_columns(found.rows[0]):
        found.headers, *found.rows = found.rows
    found.rows = merge_rows(found.rows)
    return found


def headers_alike(a: str, b: str) -> bool:
    """One's sorted words within the other's, names of one column, or half of all words in common."""
    low = a.lower(), b.lower()
    x, y = (frozenset(re.findall(r"[^\W_]+", h)) for h in low)
    if not (x and y):
        return False
    ordered = sorted((" ".join(sorted(w)) for w in (x, y)), key=len)
    named = ({k for k, names in SAME_COLUMN.items() if any(n in h for n in names)} for h in low)
    return ordered[0] in ordered[1] or bool(set.intersection(*named)) or 2 * len(x & y) >= len(x | y)


def continues(first: Grid, second: Grid) -> bool:
    """Whether the second table goes on with the first's columns."""
    a, b = (len(g.headers) or max(map(len, g.rows), default=0) for g in (first, second))
    if abs(a - b) > 1:
        return False
    if not first.headers or not second.headers or a != b:
        return True
    same = sum(x.lower().strip() == y.lower().strip() or headers_alike(x, y) for x, y in zip(first.headers, second.headers, strict=True))
    return same / a >= 0.75


def carries_suffixes(first: Grid, last: list[str], row: list[str]) -> bool:
    """Whether a page's first row only ends the plan cells of the row before the break: two of them filled, no label, next to no description."""
    at = description_column(first.headers)
    described = row[at].strip() if at is not None and at < len(row) else ""
    return not row[0].strip() and len(described) <= 2 and sum(bool(row[i].strip()) for i in plan_columns(first.headers).values() if i < len(row)) >= 2


def joined(parts: list[Grid]) -> Grid:
    """The tables of one group as one: headings that differ from the first table's are rows, suffix rows go to the row before."""
    first = parts[0]
    rows = [list(r) for r in first.rows]
    for g in parts[1:]:
        more = [list(r) for r in g.rows]
        if g.headers and first.headers and not all(x == y or headers_alike(x, y) for x, y in zip(g.headers, first.headers, strict=False)):
            more.insert(0, list(g.headers))
        if more and rows and first.headers and carries_suffixes(first, rows[-1], more[0]):
            suffix, *more = more
            for i in plan_columns(first.headers).values():
                if i < len(rows[-1]) and i < len(suffix):
                    rows[-1][i] = " ".join(x for x in (rows[-1][i].strip(), suffix[i].strip()) if x)
        rows += more
    return Grid(next((g.headers for g in parts if g.headers), []), merge_rows(rows), next((g.title for g in parts if g.title), None))


def stitch(text: str) -> list[Grid]:
    """The tables of a text; those that a page break splits are joined, judged by the group's first table."""
    found = sorted([m for pattern in (_TABLE, _PIPE) for m in pattern.finditer(text)], key=lambda m: m.start())
    groups: list[list[Grid]] = []
    end = 0
    for m in found:
        if m.start() < end:
            continue
        table = parse(m.group())
        if groups and _BREAK.search(text, end, m.start()) and continues(groups[-1][0], table):
            groups[-1].append(table)
        else:
            groups.append([table])
        end = m.end()
    return [joined(parts) for parts in groups]


def description_column(headers: list[str]) -> int | None:
    """The first heading with a describing word, else the first after column 0 that isn't mostly digits."""
    low = [h.lower() for h in headers]
    named = (i for i, h in enumerate(low) if any(w in h for w in DESCRIPTIONS))
    wordy = (i for i, h in enumerate(headers) if i and sum(map(str.isdigit, h)) <= sum(map(str.isalpha, h)))
    return next(itertools.chain(named, wordy), 1 if len(headers) > 1 else None)


def plan_columns(headers: list[str]) -> dict[str, int]:
    """Column by plan name (of several columns of one plan the last); without any, all columns but the first and the description, by heading."""
    named = ((next((p for p in PLANS if p in h.upper()), None), i) for i, h in enumerate(headers))
    plans = {p: i for p, i in named if p}
    others = [i for i in range(1, len(headers)) if i != description_column(headers)]
    return plans or {headers[i].strip().upper() or f"COLUMN {i + 1}": i for i in others}


def reader_text(g: Grid) -> str:
    """One line a row: label and description (never a plan's column), then each other column as name: value."""
    plans = {i for name, i in plan_columns(g.headers).items() if name in PLANS}
    at = description_column(g.headers)
    lines = [g.title] if g.title else []
    for r in filter(None, g.rows):
        label = r[0].strip() if is_label(r[0]) else ""
        own = at if at is not None and at not in plans and at < len(r) and r[at].strip() else min(bool(label), len(r) - 1)
        others = ((g.headers[i] if i < len(g.headers) else "", v) for i, v in enumerate(r) if i != own and not (i == 0 and label) and v.strip())
        lines.append(" | ".join([" ".join(x for x in (label, r[own]) if x.strip()), *(f"{name}: {v}" if name else v for name, v in others)]).strip(" |"))
    return "\n".join(lines)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("table_no", pa.int32()), ("title", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("normalised", pa.string())])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, g in enumerate(stitch(text or "")):
                rows.append({"doc_id": doc_id, "table_no": i, "title": g.title, "headers": g.headers, "rows": g.rows, "normalised": reader_text(g)})
        yield pa.RecordBatch.from_pylist(rows, schema)


def stitched(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, table_no, title, headers, rows, normalised for all tables of a column of HTML or markdown."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_tables, "doc_id long, table_no int, title string, headers array<string>, rows array<array<string>>, normalised string")


def row_chunks(tables: DataFrame) -> DataFrame:
    """A whole-table chunk and a chunk per row with its column_data map."""
    whole = tables.select("doc_id", "table_no", F.lit(-1).alias("row_no"), F.lit("complete_table").alias("element_type"), F.col("normalised").alias("content"), F.lit(None).cast("map<string,string>").alias("column_data"))
    each = tables.select("doc_id", "table_no", "headers", F.posexplode("rows").alias("row_no", "r"))
    n = F.least(F.size("headers"), F.size("r"))
    # a heading that stands twice is numbered from its second place on, as a map holds a name once
    own = F.slice("headers", F.lit(1), n)
    before = lambda h, i: F.size(F.filter(F.slice(own, F.lit(1), i), lambda x: x == h))
    names = F.transform(own, lambda h, i: F.when(before(h, i) > 0, F.concat(h, F.lit("#"), i)).otherwise(h))
    data = F.map_from_arrays(names, F.slice("r", F.lit(1), n))
    rows = each.select("doc_id", "table_no", "row_no", F.lit("table_row"), F.array_join("r", " | "), data)
    return whole.union(rows)
