"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document's ids (its text's, then one end id) are cut into pieces of 1024 as long as
they last and then by the binary digits of the rest, longest first. Each piece fills
one sequence of its own length. Pieces of equal length form a bucket; sequence ids run
through the buckets, longest first, without gaps, so a trainer can take batches of one
length as ranges of ids.

Numbering is in two steps: counts by (length, part) are summed to offsets on a table
of that size, then rows are numbered within their part. Parts are dealt by hash, or are
runs of bounded length along a given order of the documents (``along``), so neither a
length nor a document that holds a third of all pieces meets in one task.

Defined cases: null text counts as empty and gives one piece, the end id. Rows with a
null doc_id are packed like others. Repeated rows are packed each on their own. Very long texts are
packed whole: as many pieces of 1024 as they need, and their rest. Ties of the order go by id, start and the
ids' hash. Empty tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, even_parts, take

LONGEST = 1024
END_ID = 0
_SPECIAL = "<|endoftext|>"
_LONG_SPACE = re.compile(r"\s{2000}")  # the fast way's regular expressions run out of stack on such


class Encoder:
    """Ids of the byte-level vocabulary. The rank form of the same vocabulary is the fast way; a text that holds a special token's string, or thousands of spaces on end, goes through the tokenizers library."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and _SPECIAL not in text and not _LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def vocabulary() -> tuple[str, str]:
    """(json, ranks): where this machine keeps the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as a sum of powers of two of at most ``longest``, largest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def _pieces(paths: tuple[str, str] | None, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*(paths or vocabulary()))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, text, run_, place in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    ids = np.array([*encoder.ids(text or ""), END_ID], dtype="<u4")
                    start = 0
                    for n in piece_lengths(len(ids), longest):
                        piece = ids[start : start + n]
                        for col, value in zip(cols, (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), run_, place, piece.astype(np.int32) if with_ids else None), strict=True):
                            col.append(value)
                        start += n
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "run", "place", "ids"]
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
                keep = 8 if with_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds, strict=False)], names=names[:keep])

    return run


def pack(docs: DataFrame, longest: int = LONGEST, vocabulary_paths: tuple[str, str] | None = None, with_ids: bool = True, along: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for.

    ``vocabulary_paths``: (json, ranks) on the executors; None looks them up there.
    ``along``: two columns of whole numbers that order the documents (the first may stand for many
    rows); sequences of a length are then numbered in this order.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, run long, place long" + ", ids array<int>" * with_ids
    rows = take(docs, "doc_id", "text", *(along or ())).toDF("doc_id", "text", *["run", "place"] * bool(along))
    order = [F.col(c).cast("long").alias(c) if along else F.lit(0).cast("long").alias(c) for c in ("run", "place")]
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *order)
    pieces = cut(rows.mapInArrow(_pieces(vocabulary_paths, longest, with_ids), schema))
    total = pieces.count()
    if along:
        each = total // even_parts(total) + 1
        part = [F.col("run"), F.expr(f"place div {each}"), F.expr(f"start div {each * longest}")]
    else:
        part = [F.pmod(F.xxhash64("doc_id", "start"), F.lit(even_parts(total)))]
    dealt = pieces.withColumn("part", F.struct(*[c.cast("long").alias(f"p{i}") for i, c in enumerate(part)]))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each length and part: few, as the number of parts shows
    before = Window.orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "part").orderBy("run", "place", "doc_id", "start", "doc_tokens", "ids_crc32")
    numbered = dealt.join(offsets, ["length", "part"]).withColumn("sequence_id", F.col("base") + F.row_number().over(inside) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")]
    return numbered.select(*names, *["ids"] * with_ids)
