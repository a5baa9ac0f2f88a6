"""License scan: exact phrases, and short notices with a bounded number of edits.

A notice may differ in up to k single-character edits. Cut into k + 1 pieces, at least
one piece then stands in the text unchanged. Plain searches for the pieces give small
windows; only there the regex library matches the whole notice with at most k errors
and reports the span, improved to its nearest fit, and its edits.

Words are runs of digits, letters and any character beyond ASCII, after A-Z have been
lower-cased; notices are compared with the words joined by single spaces. Places are
counted in words from 0.

Defined cases: null text counts as empty: no words, no places, null first and last
word, empty labels, score 0. Places may overlap and repeat; all count. Windows that
touch are searched as one, so very long texts with many seeds stay linear. Repeated
rows are scanned each on their own. Of notices that match the same words, all count (ties included). Empty
tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take

#: Phrases that label a text wherever they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int


#: Short notices of common licenses, with the edits they may have.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("artistic", "distributed under the artistic license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("cc0", "dedicated to the public domain under cc0", 3),
    Notice("cc-by", "licensed under cc by 4 0", 1),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 1),
    Notice("gpl", "this work is licensed under the gnu general public license", 5),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
)

#: Every byte that is no part of a word becomes a space.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(words: bytes, parts: int) -> list[tuple[int, bytes]]:
    """words in ``parts`` pieces of nearly equal length, each with where it starts."""
    edges = [len(words) * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Scanner:
    def __init__(self, notices: Sequence[Notice] = NOTICES, base: dict[str, str] = BASE):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.notices = []
        for n in notices:
            plain = n.words.encode()
            pattern = regex.compile(b"(?e)(?:" + regex.escape(plain) + b"){e<=%d}" % n.edits)
            self.notices.append((n, len(plain), pieces(plain, n.edits + 1), pattern))

    def words(self, text: str) -> bytes:
        """The words of a text with one space before, between and after them."""
        found = text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()
        return b" " + b" ".join(found) + b" " if found else b""

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """(word, label) of all places of the base phrases, in order."""
        out = []
        for phrase, label in self.base:
            at, word, seen = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                out.append((word, label))
                at = joined.find(phrase, at + 1)
        return sorted(out)

    def near(self, joined: bytes) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, edits, likeness) of notices matched with bounded errors."""
        out = []
        for notice, length, seeds, pattern in self.notices:
            starts = []
            for offset, seed in seeds:
                at = joined.find(seed)
                while at >= 0:
                    starts.append(at - offset)
                    at = joined.find(seed, at + 1)
            end = -1
            windows: list[list[int]] = []
            for s in sorted(starts):
                low, high = max(0, s - notice.edits), min(len(joined), s + length + notice.edits)
                if windows and low <= end:
                    windows[-1][1] = end = max(end, high)
                else:
                    windows.append([low, high])
                    end = high
            word = seen = 0
            for low, high in windows:
                for m in pattern.finditer(joined, low, high):
                    word += joined.count(b" ", seen, m.start() + 1)
                    seen = m.start() + 1
                    edits = sum(m.fuzzy_counts)
                    out.append((notice.label, max(0, word - 1), len(m.group().split()), edits, 1 - edits / length))
        return out


def _scan(notices: Sequence[Notice], base: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    joined = scanner.words(text or "")
                    exact, near = scanner.exact(joined), scanner.near(joined)
                    places = [w for w, _ in exact]
                    sure = {label for _, label in exact}
                    rows.append(
                        {
                            "doc_id": doc_id,
                            "n_words": joined.count(b" ") - 1 if joined else 0,
                            "n_base": len(exact),
                            "first_word": min(places, default=None),
                            "last_word": max(places, default=None),
                            "base_labels": ",".join(sorted(sure)),
                            "labels": ",".join(sorted(sure | {x[0] for x in near})),
                            "score": 1.0 if exact else max((x[4] for x in near), default=0.0),
                            "spans": [dict(zip(("label", "word", "words", "edits"), x, strict=False)) for x in near],
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


_SPAN = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())])
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: word and place counts, labels, score, and the spans of near notices."""
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<label:string,word:long,words:long,edits:long>>"
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {kind}"
    return rows.mapInArrow(_scan(notices, base), schema)
