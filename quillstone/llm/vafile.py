"""Vector codes from small codebooks, looked up through a VA-file.

A vector of whole numbers is cut into equal parts; a part's code is its nearest codebook
entry. Each codebook is kept as a VA-file: every coordinate of an entry is quantised to
``BITS`` bits, so the entry is a handful of cells. For a part, one table per coordinate and
cell holds the least and the greatest squared difference to anything in that cell; their sums
are bounds of the distance to every entry. Only entries whose lower bound does not exceed the
least upper bound can be nearest, and only to these are distances worked out, as whole numbers.

Learning is rounds of assignment and means over all rows. A task sends the counts and sums of
its rows, one per entry and coordinate; they are summed by Spark, and what comes to the driver is
as large as the codebooks, whatever the table's size.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; an
empty vector counts as zeros. The width is that of the longest vector, rounded up to a multiple of the
number of parts; shorter ones are filled with zeros. Components are clamped where a row's distance would
not fit 64 bits (for 64 components from |x| of about 46,000 on). Rows with a null vec_id get codes but found no
entry. Repeated rows count as often as they stand, and equal ids are ordered by their vectors. With fewer rows
than entries there are as many entries as rows. Ties of distance go to the lower entry. Sums by label that exceed 64
bits are the largest long. Empty tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, take

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 2
#: Up to so many labels their sums are sent to every executor; beyond, they are joined by shuffle.
FEW_LABELS = 100_000
_AT_ONCE = 4096


def finite(vector: Column) -> Column:
    """The vector is there and every component is a finite number (NaN is greater than infinity here)."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def kept_vectors(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, the last one as a vector of doubles, where all its components are finite."""
    rows = take(df, *names)
    vector = F.col(names[-1]).cast("array<double>")
    return rows.select(*names[:-1], vector.alias(names[-1])).where(finite(F.col(names[-1])))


def whole_numbers(column: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """(rows, width) floors of scale * x, filled with zeros and clamped to +-most."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(flat * scale), -most, most)
    if (sizes == width).all():
        return scaled.reshape(len(column), width)
    out = np.zeros((len(column), width))
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - starts[row]] = scaled
    return out


class Cells:
    """The entries of one codebook as a VA-file."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries = np.asarray(entries, np.int64)
        m, self.width = entries.shape
        n = 1 << bits
        borders = np.sort(entries, axis=0)[np.arange(1, n) * m // n]  # equal shares of the entries in each cell
        self.cell = (entries[None] >= borders[:, None]).sum(axis=0)
        inside = self.cell[None] == np.arange(n)[:, None, None]
        self.low = np.where(inside, entries, np.iinfo(np.int64).max).min(axis=1)
        self.high = np.where(inside, entries, np.iinfo(np.int64).min).max(axis=1)
        empty = ~inside.any(axis=1)
        self.low[empty] = self.high[empty] = 0  # no entry looks there

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, rows) lower and upper bounds of the squared distances, from tables of each row by coordinate and cell."""
        x = rows.T[None]
        low, high = self.low[:, :, None], self.high[:, :, None]
        outside = np.maximum(np.maximum(low - x, x - high), 0)
        farthest = np.maximum(np.abs(x - low), np.abs(x - high))
        nearest, farthest = outside * outside, farthest * farthest
        at = np.arange(self.width)
        return np.stack([nearest[c, at].sum(axis=0) for c in self.cell]), np.stack([farthest[c, at].sum(axis=0) for c in self.cell])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of every row, and how many distances were worked out."""
        lower, upper = self.bounds(rows)
        entry, row = np.nonzero(lower <= upper.min(axis=0))
        off = rows[row] - self.entries[entry]
        distance = np.full(lower.shape, np.iinfo(np.int64).max)
        distance[entry, row] = np.einsum("ij,ij->i", off, off)
        best = distance.argmin(axis=0)
        return best, distance[best, np.arange(len(rows))], len(row)


class Codebooks:
    """One codebook per part: ``entries`` is (parts, entries, coordinates)."""

    def __init__(self, entries: np.ndarray, scale: int, most: int):
        self.entries, self.scale, self.most = entries, scale, most

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def codes(self, vectors: pa.Array, files: list[Cells]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows: (rows, parts, coordinates), entries and distances of each part."""
        for at in range(0, len(vectors), _AT_ONCE):
            numbers = whole_numbers(vectors.slice(at, _AT_ONCE), self.width, self.scale, self.most).astype(np.int64)
            parts = numbers.reshape(len(numbers), len(files), -1)
            found = [f.nearest(parts[:, p])[:2] for p, f in enumerate(files)]
            yield parts, np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        files = [Cells(e) for e in books.entries]
        for batch in batches:
            for numbers, chosen, _ in books.codes(batch.column(0), files):
                for p in range(parts):
                    counts[p * entries : (p + 1) * entries] += np.bincount(chosen[:, p], minlength=entries)
                    np.add.at(sums, p * entries + chosen[:, p], numbers[:, p])
        used = np.flatnonzero(counts)
        if len(used):
            at = np.repeat(used, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].ravel()), pa.array(counts[at])], names=["entry", "place", "total", "n"]
            )

    return run


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all rows of vectors (vec_id, embedding), as kept_vectors gives them; None where there are no rows."""
    most_long = vectors.agg(F.max(F.size("embedding"))).first()[0]
    first = [r["embedding"] for r in vectors.where("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).collect()]
    if not first:
        first = [r["embedding"] for r in vectors.orderBy("embedding").limit(entries).collect()]
    if not first:
        return None
    width = max(parts, -(-most_long // parts) * parts)
    most = math.isqrt(((1 << 63) - 1) // width) // 2 - 1
    seeds = whole_numbers(pa.array(first, pa.list_(pa.float64())), width, scale, most).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)), scale, most)
    for _ in range(rounds):
        sent = vectors.select("embedding").mapInArrow(_sums(books), "entry long, place long, total long, n long")
        whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
        after = books.entries.copy()
        flat = after.reshape(-1, after.shape[2])
        for r in sent.groupBy("entry", "place").agg(*whole).collect():  # a row for each coordinate of an entry
            flat[r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
        books = Codebooks(after, scale, most)
    return books


def _encode(books: Codebooks):
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(books.entries.shape[1])).encode(), np.uint8).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(e) for e in books.entries]
        for batch in batches:
            codes, errors = [], []
            for _, chosen, far in books.codes(batch.column(2), files):
                text = np.ascontiguousarray(digits[chosen].reshape(len(chosen), -1))
                codes += [bytes(t).decode() for t in text]
                errors.append(far.sum(axis=1))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of every row of vectors (vec_id, label, embedding)."""
    kind = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(_encode(books), f"vec_id long, label {kind}, code string, error long")


def compress(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of df (vec_id, embedding, label) that is kept."""
    vectors = kept_vectors(df, "vec_id", "label", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    books = learn(vectors.select("vec_id", "embedding"))
    if books is None:
        none = F.lit(None).cast("string")
        return vectors.select("vec_id", none.alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], none.alias("codebooks_sha256"))
    coded = cut(encode(vectors, books))
    largest = F.lit((1 << 63) - 1)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest.cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = cut(by_label)
    if by_label.count() <= FEW_LABELS:
        by_label = F.broadcast(by_label)
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle() -> str:
    """The same as SQL: every round is a step over all parts and entries."""
    steps = [
        f"""kept as materialized (select row_number() over (order by vec_id) as place, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"wide as (select place, vec_id, label, v, len(v) // {PARTS} as d from kept)",
        f"comp as materialized (select place, p, j, v[p * d + j + 1] as x from wide, range({PARTS}) a(p), range(64) b(j) where j < d)",
        f"c0 as materialized (select p, place - 1 as e, j, x from comp where place <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} as (select place, p, e, cast(sum((m.x - c.x) * (m.x - c.x)) as bigint) as far from comp m join c{r} c using (p, j) group by place, p, e)")
        steps.append(f"n{r} as materialized (select place, p, e, far from d{r} qualify row_number() over (partition by place, p order by far, e) = 1)")
        if r < ROUNDS:
            steps.append(f"s{r} as (select p, e, j, cast(floor(sum(x)::double / count(*)) as bigint) as x from n{r} join comp using (place, p) group by p, e, j)")
            steps.append(f"c{r + 1} as materialized (select c.p, c.e, c.j, coalesce(s.x, c.x) as x from c{r} c left join s{r} s on c.p = s.p and c.e = s.e and c.j = s.j)")
    steps.append(f"code as (select place, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(far) as bigint) as error from n{ROUNDS} group by place)")
    steps.append(f"sha as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) as codebooks_sha256 from c{ROUNDS})")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join code using (place), sha"
