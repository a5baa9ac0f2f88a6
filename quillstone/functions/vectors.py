"""Vector search: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 512, 4096


def angular(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _packed(df: DataFrame, per: int, prefix: str, with_group: bool) -> DataFrame:
    """Rows of up to about ``per`` vectors: ids, groups and one flat array."""
    n = max(1, -(-df.select(F.count("*")).first()[0] // per))
    cols = [F.col("id"), F.col("grp") if with_group else F.lit(0).alias("grp"), F.col("v").cast("array<double>").alias("v")]
    dealt = df.select(*cols).where("v is not null").groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "grp", "v")).alias("x"))
    return dealt.select(
        F.col("x.id").alias(f"{prefix}_ids"), F.col("x.grp").alias(f"{prefix}_groups"), F.flatten(F.col("x.v")).alias(f"{prefix}_flat")
    )


#: Scores are rounded to 6 places: what lies further than this under a rounded score stays under it.
STEP = 1.1e-6


def _scores(k: int, same_group: bool, skip_self: bool, smallest: float):
    """Pairs of packs (r_ids, r_groups, r_flat, q_ids, q_groups, q_flat[, q_reach]) to the k best rows of each query.

    ``q_reach``: a score of each query that k other rows have reached, so lower ones are left out; NaN: none yet.
    """

    def unit(flat, n: int) -> np.ndarray:
        m = np.asarray(flat, np.float64).reshape(n, -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(ids, groups, rows, q_ids, q_groups, queries, reach) -> tuple[np.ndarray, ...]:
        s = queries @ rows.T
        if not (np.isfinite(rows).all() and np.isfinite(queries).all()):
            s[np.isnan(s)] = -np.inf
        if same_group:
            s[q_groups[:, None] != groups[None, :]] = -np.inf
        if skip_self:
            s[q_ids[:, None] == ids[None, :]] = -np.inf
        least = np.full(len(s), smallest)
        if reach is not None:
            least = np.fmax(least, reach)
        open_ = np.flatnonzero(np.isnan(reach)) if reach is not None else np.arange(len(s))
        if k and len(ids) > k and len(open_):
            part = s if len(open_) == len(s) else s[open_]
            least[open_] = np.maximum(least[open_], np.partition(part, len(ids) - k, axis=1)[:, len(ids) - k])
        at, to = np.divmod(np.flatnonzero((s >= (least - STEP)[:, None]).ravel()), len(ids))
        score = np.round(s[at, to], 6) + 0.0
        kept = (score >= smallest) & (score > -np.inf)
        at, to, score = at[kept], to[kept], score[kept]
        if k:
            order = np.lexsort((ids[to], -score, at))
            at, to, score = at[order], to[order], score[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, to, score = at[kept], to[kept], score[kept]
        return q_ids[at], ids[to], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, groups, flat, q_ids, q_groups, q_flat, *more = (np.asarray(batch.column(j)[i].values) for j in range(batch.num_columns))
                rows, queries = unit(flat, len(ids)), unit(q_flat, len(q_ids))
                for j in range(0, len(q_ids), QUERY_BLOCK):
                    part = slice(j, j + QUERY_BLOCK)
                    found = best(ids, groups, rows, q_ids[part], q_groups[part], queries[part], more[0][part] if more else None)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "id", "score"])

    return run


def similar(queries: DataFrame, rows: DataFrame, k: int = 0, same_group: bool = False, skip_self: bool = False, smallest: float = -2.0) -> DataFrame:
    """(qid, id, score): cosine to 6 places of queries (id, v[, grp]) and rows (id, v[, grp]).

    Both sides are packed into blocks of bounded size; a task takes one pair of blocks
    as one matrix product and keeps its k best a query, so only k rows a block go on.
    """
    left = _packed(rows, ROW_BLOCK, "r", same_group)
    right = _packed(queries, QUERY_BLOCK, "q", same_group)
    return left.crossJoin(right).select("r_ids", "r_groups", "r_flat", "q_ids", "q_groups", "q_flat").mapInArrow(_scores(k, same_group, skip_self, smallest), "qid long, id long, score double")


def top_k(queries: DataFrame, rows: DataFrame, k: int, **kind) -> DataFrame:
    """(qid, id, score, rank from 1): best first, ties by id."""
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return similar(queries, rows, k, **kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
