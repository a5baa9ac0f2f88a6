"""Hard negatives by blocked products of anchors and candidates.

Scores are inner products of vectors of whole numbers held as float64, which are exact below
2**53. Anchors go to the tasks in blocks of bounded size; every task multiplies them with the
batches of candidates that it reads, and keeps what can still be among the first:

1. of each anchor the best rows of its own label (its positives). What tasks keep is mergeable: the
   best of the parts' best are the best of all;
2. of each anchor and positive the best rows of other labels whose score lies in the positive's
   window (from 80 % of the positive's score up to the score itself).

A task holds a block of anchors, a batch of candidates and the rows kept so far, and sends at most a
few rows for each anchor; candidates are never moved. Where anchors exceed one block, the candidates are
read again for each block, so time grows with anchors times candidates, as exact search must.

Defined cases: rows with a null id, a null label, a null vector or a component that is null, NaN or infinite
take no part; an empty vector counts as zeros, shorter vectors are filled with zeros. Components are clamped where a
product could reach 2**53 (for 64 components from |x| of about 46,000 on). Ids are what tells rows apart: "another"
row has another id. Where rows repeat an id, the anchor is the one with the least label and then the least
vector, and candidates count as often as they stand. Ties of scores go to the smaller id. Anchors
without positives, and positives without negatives, give no rows. Empty tables give none. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vafile import kept_vectors, whole_numbers

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Bytes of anchors in a block that is sent to the executors, and anchors multiplied at once.
BLOCK_BYTES, AT_ONCE = 16 << 20, 256
_CANDIDATES = 4096


@dataclass
class Block:
    """Anchors of one block: ids, labels, vectors; in the second pass also their positives, best first, with the number of each anchor's."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    most: int
    positive_ids: np.ndarray | None = None
    positive_scores: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.vectors.shape[1]


class Best:
    """The first k rows of each key by greatest score and then smallest id; adding parts in any order gives the same."""

    def __init__(self, k: int):
        self.k = k
        self.keys, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keys, ids, scores = (np.concatenate(x) for x in ((self.keys, keys), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, keys))
        keys = keys[order]
        starts = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        place = np.arange(len(keys)) - np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
        first = place < self.k
        self.keys, self.ids, self.scores = keys[first], ids[order][first], scores[order][first]


def _add_best(best: Best, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, fit: np.ndarray) -> None:
    """Adds of each row of scores (keys x ids), where they fit, those that reach its k-th best."""
    masked = np.where(fit, scores, -np.inf)
    if masked.shape[1] > best.k:
        reach = np.partition(masked, -best.k, axis=1)[:, -best.k]
        fit = fit & (masked >= reach[:, None])
    row, column = np.nonzero(fit)
    best.add(keys[row], ids[column], scores[row, column])


def _products(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(anchors from, to, candidate ids, candidate labels, scores) of every pair of blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, _CANDIDATES):
            part = batch.slice(at, _CANDIDATES)
            ids, labels = (np.asarray(part.column(i), np.int64) for i in (0, 1))
            vectors = whole_numbers(part.column(2), block.width, SCALE, block.most)
            for a in range(0, len(block.ids), AT_ONCE):
                b = min(a + AT_ONCE, len(block.ids))
                yield a, b, ids, labels, block.vectors[a:b] @ vectors.T


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, Best(k)
        for a, b, ids, labels, scores in _products(block, batches):
            fit = (block.labels[a:b, None] == labels) & (block.ids[a:b, None] != ids)
            _add_best(best, np.arange(a, b), ids, scores, fit)
        yield pa.RecordBatch.from_arrays([pa.array(best.keys), pa.array(best.ids), pa.array(best.scores.astype(np.int64))], names=["anchor", "id", "score"])

    return run


def _negatives(shared, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, Best(k)
        each = block.positive_ids.shape[1]
        there = np.isfinite(block.positive_scores)
        whole = np.where(there, block.positive_scores, 0).astype(np.int64)
        # windows in whole numbers: low * positive <= 100 * negative <= high * positive
        least, greatest = -((-low * whole) // 100), (high * whole) // 100
        for a, b, ids, labels, scores in _products(block, batches):
            other = block.labels[a:b, None] != labels
            for i in range(each):
                rows = np.flatnonzero(there[a:b, i])
                if len(rows):
                    fit = other[rows] & (scores[rows] >= least[a + rows, i, None]) & (scores[rows] <= greatest[a + rows, i, None])
                    _add_best(best, (a + rows) * each + i, ids, scores[rows], fit)
        yield pa.RecordBatch.from_arrays([pa.array(best.keys), pa.array(best.ids), pa.array(best.scores.astype(np.int64))], names=["key", "id", "score"])

    return run


def _first(found: DataFrame, key: str, k: int) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (80, 100), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding).

    ``anchor`` is a condition on vec_id. ``window``: per cent of the positive's score that a negative's may have.
    """
    spark = vectors.sparkSession
    one = vectors.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding")
    anchors = cut(one)
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    width = max(1, size or 1)
    most = math.isqrt(((1 << 53) - 1) // width)
    blocks = -(-anchors.count() * width * 8 // block_bytes)
    out = vectors.where("false").select(*[F.lit(0).cast(t).alias(c) for c, t in zip(("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), ("long", "long", "int", "long", "long", "long"), strict=True)])
    context = spark.sparkContext
    for i in range(blocks):
        # by hash, so a block is near its share; at most block_bytes, a few more by chance, come to the driver
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, labels = (own.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        list_of = own.column("embedding").combine_chunks()
        numbers = whole_numbers(list_of.chunk(0) if isinstance(list_of, pa.ChunkedArray) else list_of, width, SCALE, most)
        block = Block(ids, labels, numbers, most)
        rows = vectors.select("vec_id", "label", "embedding")
        found = _first(rows.mapInArrow(_positives(context.broadcast(block), positives), "anchor long, id long, score long"), "anchor", positives)
        block.positive_ids = np.full((len(ids), positives), -1, np.int64)
        block.positive_scores = np.full((len(ids), positives), -np.inf)
        for r in found.toArrow().to_pylist():  # a few rows for each anchor of the block
            block.positive_ids[r["anchor"], r["rank"] - 1], block.positive_scores[r["anchor"], r["rank"] - 1] = r["id"], r["score"]
        second = Block(ids, labels, numbers, most, block.positive_ids, block.positive_scores)
        hard = _first(rows.mapInArrow(_negatives(context.broadcast(second), negatives, *window), "key long, id long, score long"), "key", negatives)
        anchor_at, place = np.nonzero(np.isfinite(second.positive_scores))
        columns = ids[anchor_at], second.positive_ids[anchor_at, place], second.positive_scores[anchor_at, place].astype(np.int64), anchor_at * positives + place
        names = spark.createDataFrame(pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "key"), map(pa.array, columns), strict=True))))
        part = hard.join(F.broadcast(names), "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if blocks == 1 else out.union(cut(part))
    return out


def hard_negatives(df: DataFrame) -> DataFrame:
    """The negatives of every hundredth id of df (vec_id, embedding, label); every seventh id's label is moved on first."""
    rows = kept_vectors(df, "vec_id", "label", "embedding")
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.where(vec_id.isNotNull() & label.isNotNull()).select(vec_id.alias("vec_id"), moved.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


def oracle() -> str:
    return f"""with kept as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from kept a, kept r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}),
n as (select p.anchor_id, positive_id, positive_score, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
