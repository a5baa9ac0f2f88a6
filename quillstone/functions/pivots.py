"""Exact nearest rows by cosine, with pivots that save comparing every query with every row.

The angle between vectors is a metric. Some pivots are fitted on a bounded sample; every row goes to the block of
its nearest pivot, and of each block the least and the greatest angle to every pivot are kept. By the triangle
inequality a query's angle to anything in a block is at least what its own angles to the pivots exceed these
bounds by. A query first meets its two most promising blocks; then, knowing its k-th score so far, only the blocks
whose bound could still beat it. Results are those of comparing all pairs; how much is saved depends on the
data (little where vectors have many independent dimensions) and is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.session import cut, ship

#: Scores are compared by 6 places, so a bound must miss by more than this to rule a block out.
SLACK = 2e-6
FIRST = 2
PACKS, _BATCH = 16, "spark.sql.execution.arrow.maxRecordsPerBatch"


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, pivots: int = 32, sample: int = 4096, rounds: int = 8) -> np.ndarray:
    """Unit vectors that spread over a sample of rows (id, v): those with the least hashes, at most ``sample``."""
    picked = rows.where("v is not null").select(F.xxhash64("id").alias("h"), "id", F.col("v").cast("array<double>").alias("v")).orderBy("h", "id").limit(sample).toArrow()
    own = unit(np.array(picked.column("v").to_pylist(), float)) if picked.num_rows else np.zeros((0, 1))
    own = own[np.linalg.norm(own, axis=1) > 0] if len(own) else own
    if not len(own):
        return own
    at = [0]
    near = own @ own[0]
    while len(at) < min(pivots, len(own)) and near.min() < 1 - 1e-12:  # the farthest from those chosen is next
        at.append(int(near.argmin()))
        near = np.maximum(near, own @ own[at[-1]])
    centres = own[at]
    for _ in range(rounds):
        of = (own @ centres.T).argmax(axis=1)
        centres = np.array([unit(own[of == i].sum(axis=0)) if (of == i).any() else c for i, c in enumerate(centres)])
    return centres


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(m) @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(m), 0))


def _dealt(pivots: np.ndarray):
    """Rows (id, grp, v) with the block of their nearest pivot; vectors of length zero, which have no angle, are in a block behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2))
            block = np.where(np.linalg.norm(m, axis=1) > 0, angles(m, pivots).argmin(axis=1) if len(m) else 0, len(pivots))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], names=["id", "grp", "v", "block"])

    return run


def _ranges(pivots: np.ndarray):
    """(at, least, greatest, n) of the angles between the rows of a block and each pivot; at is block * pivots + pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots)
        least, greatest, count = np.full((n + 1, n), np.inf), np.full((n + 1, n), -np.inf), np.zeros(n + 1, np.int64)
        for batch in batches:
            block, far = batch.column(1).to_numpy(), angles(_matrix(batch.column(0)), pivots)
            np.minimum.at(least, block, far)
            np.maximum.at(greatest, block, far)
            count += np.bincount(block, minlength=n + 1)
        at = np.flatnonzero(np.repeat(count, n))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least.ravel()[at]), pa.array(greatest.ravel()[at]), pa.array(np.repeat(count, n)[at])], names=["at", "least", "greatest", "n"])

    return run


@dataclass
class Ranges:
    """Pivots, the range of angles of each block to each pivot, and the rows of each block."""

    pivots: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    counts: np.ndarray

    def bounds(self, m: np.ndarray) -> np.ndarray:
        """(queries, blocks): the greatest cosine that a row of the block can have; -inf for empty blocks."""
        t = angles(m, self.pivots)[:, None]
        apart = np.maximum(self.least[None] - t, t - self.greatest[None]).max(axis=2, initial=0)
        apart[np.linalg.norm(m, axis=1) == 0] = 0
        best = np.cos(np.minimum(apart, np.pi))
        best[:, len(self.pivots)] = 0  # rows of length zero: their cosine is 0
        best[np.linalg.norm(m, axis=1) == 0] = 0
        return np.where(self.counts > 0, best, -np.inf)


@dataclass
class Index:
    """What tasks rule blocks out by, and the rows of each block in packs of bounded size."""

    ranges: Ranges
    packs: DataFrame


def build(rows: DataFrame, pivots: np.ndarray | None = None) -> Index:
    """An index of rows (id, v[, grp]); rows with a null vector are left out."""
    ship(rows.sparkSession)
    group = F.col("grp") if "grp" in rows.columns else F.lit(0).cast("long")
    plain = rows.where("v is not null").select("id", group.cast("long").alias("grp"), F.col("v").cast("array<double>").alias("v"))
    pivots = fit(rows) if pivots is None else unit(pivots)
    dealt = plain.mapInArrow(_dealt(pivots), "id long, grp long, v array<double>, block long") if len(pivots) else plain.withColumn("block", F.lit(0).cast("long"))
    n = len(pivots)
    least, greatest, counts = np.full((n + 1, n), np.inf), np.full((n + 1, n), -np.inf), np.zeros(n + 1, np.int64)
    if n:
        whole = dealt.select("v", "block").mapInArrow(_ranges(pivots), "at long, least double, greatest double, n long")
        for r in whole.groupBy("at").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n")).collect():  # (pivots + 1) * pivots rows
            least.ravel()[r["at"]], greatest.ravel()[r["at"]], counts[r["at"] // n] = r["least"], r["greatest"], r["n"]
    else:
        counts[0] = dealt.count()
    packs = F.element_at(F.array(*[F.lit(int(max(1, -(-c // V.ROW_BLOCK)))) for c in counts]), (F.col("block") + 1).cast("int"))
    packed = dealt.groupBy("block", F.pmod(F.xxhash64("id"), packs).alias("pack")).agg(F.collect_list(F.struct("id", "grp", "v")).alias("x"))
    packed = packed.select("block", F.col("x.id").alias("r_ids"), F.col("x.grp").alias("r_groups"), F.flatten("x.v").alias("r_flat"))
    return Index(Ranges(pivots, least, greatest, counts), cut(packed))


def _picked(ranges: Ranges, later: bool, first: int):
    """Packs of queries (q_ids, q_groups, q_flat, q_reach) to (block, the same of the queries that meet it): the first blocks of each, or those others whose bound is not under its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, groups, flat, reach = (batch.column(j)[i].values for j in range(4))
                m = np.asarray(flat, np.float64).reshape(len(ids), -1)
                best = ranges.bounds(m)
                # blocks in order of their bounds, ties by number: the same in both rounds
                order = np.argsort(-best, axis=1, kind="stable")
                early = np.zeros(best.shape, bool)
                np.put_along_axis(early, order[:, :first], True, axis=1)
                early &= best > -np.inf
                take = ~early & (best >= np.nan_to_num(np.asarray(reach), nan=-2.0)[:, None] - SLACK) if later else early
                for block in np.flatnonzero(take.any(axis=0)):
                    at = np.flatnonzero(take[:, block])
                    values = [ids.take(pa.array(at)), groups.take(pa.array(at)), pa.array(m[at].ravel()), reach.take(pa.array(at))]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names=["block", "q_ids", "q_groups", "q_flat", "q_reach"])

    return run


def _met(ranges: Ranges, later: bool, first: int):
    """How many queries of packs meet how many blocks."""
    picked = _picked(ranges, later, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(batch.column(1).flatten()) for batch in picked(batches))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


@contextmanager
def few_a_batch(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send ``PACKS`` rows at a time to Python: a row of packs is megabytes, and else thousands would be one batch."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(PACKS, int(before)) if int(before) > 0 else PACKS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


@dataclass
class Search:
    """``found`` (qid, id, score, rank); how many of all pairs of a query and a block were compared, counted when asked for."""

    found: DataFrame
    _counted: Callable[[], int]
    _all: Callable[[], int]

    @property
    def compared(self) -> int:
        return self._counted()

    @property
    def pairs(self) -> int:
        return self._all()


def search(queries: DataFrame, index: Index, k: int, same_group: bool = False, skip_self: bool = False, first: int = FIRST) -> Search:
    """The k rows nearest each query (id, v[, grp]) as vectors.top_k has them: cosine to 6 places, ties by id.

    Queries are packed with others of the same nearest pivot, so packs meet few blocks; a pack is copied once for each block that some of it meets.
    """
    group = F.col("grp") if "grp" in queries.columns else F.lit(0)
    plain = queries.where("v is not null").select("id", group.cast("long").alias("grp"), F.col("v").cast("array<double>").alias("v"))
    pivots = index.ranges.pivots
    dealt = plain.mapInArrow(_dealt(pivots), "id long, grp long, v array<double>, block long") if len(pivots) else plain.withColumn("block", F.lit(0).cast("long"))
    own = cut(dealt.select(F.col("id").alias("qid"), "grp", "v", F.col("block").alias("home")))
    counts = {r["home"]: r["n"] for r in own.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row for each block
    parts = F.element_at(F.array(*[F.lit(int(max(1, -(-counts.get(b, 0) // (4 * V.QUERY_BLOCK))))) for b in range(len(index.ranges.counts))]), (F.col("home") + 1).cast("int"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    schema = "block long, q_ids array<long>, q_groups array<long>, q_flat array<double>, q_reach array<double>"

    def packed(rows: DataFrame) -> DataFrame:
        packs = rows.groupBy("home", F.pmod(F.xxhash64("qid"), parts).alias("part")).agg(F.collect_list(F.struct("qid", "grp", "v", "reach")).alias("x"))
        return packs.select(F.col("x.qid").alias("q_ids"), F.col("x.grp").alias("q_groups"), F.flatten("x.v").alias("q_flat"), F.col("x.reach").alias("q_reach"))

    def compare(packs: DataFrame, later: bool) -> DataFrame:
        # a sort-merge join holds the right side's rows of a key: a block's own rows, not the queries that meet it
        pairs = packs.mapInArrow(_picked(index.ranges, later, first), schema).join(index.packs, "block").select("r_ids", "r_groups", "r_flat", "q_ids", "q_groups", "q_flat", "q_reach")
        scored = pairs.mapInArrow(V._scores(k, same_group, skip_self, -2.0), "qid long, id long, score double")
        with few_a_batch(own.sparkSession):
            return cut(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))

    fresh = packed(own.withColumn("reach", F.lit(float("nan"))))
    early = compare(fresh, False)
    # the k-th score so far; a query with fewer rows than k has no reach yet and meets every block
    reach = early.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("reach")).where(F.col("n") >= k).drop("n")
    known = packed(own.join(reach, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("nan")))))
    late = compare(known, True)
    found = early.union(late).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    met = lambda packs, later: packs.mapInArrow(_met(index.ranges, later, first), "n long").agg(F.sum("n")).first()[0] or 0
    return Search(found, lambda: met(fresh, False) + met(known, True), lambda: sum(counts.values()) * int((index.ranges.counts > 0).sum()))
