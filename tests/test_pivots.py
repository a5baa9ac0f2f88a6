"""Pivot search finds what comparing all pairs finds, and saves comparisons where vectors form clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import pivots
from quillstone.functions import vectors as V

SCHEMA = "id long, v array<double>, grp long"


def rows_of(seed, n=400, width=8, spread=0.05, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width))
    out = [(int(i), (centres[i % clusters] + rng.standard_normal(width) * spread).tolist(), int(i % 3)) for i in range(n)]
    out += [(n + j, out[5][1], 1) for j in range(30)]  # copies: ties go by id
    out += [(n + 50, [0.0] * width, 0), (n + 51, None, 0), (n + 52, (-centres[0]).tolist(), 2)]
    return out


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 1.0), (3, 3.0)])
@pytest.mark.parametrize("kind", [{}, {"same_group": True, "skip_self": True}])
def test_same_rows_as_all_pairs(spark, seed, spread, kind):
    rows = spark.createDataFrame(rows_of(seed, spread=spread), SCHEMA).repartition(5)
    queries = rows.where("id % 7 = 0 or id >= 450")
    index = pivots.build(rows)
    got = pivots.search(queries, index, 9, **kind)
    want = V.top_k(queries, rows, 9, **kind)
    assert sorted(map(tuple, got.found.select("qid", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "id", "score", "rank").collect()))
    assert 0 < got.compared <= got.pairs
    if spread < 0.1 and not kind:
        assert got.compared < 0.5 * got.pairs


def test_bounds_are_never_under_a_cosine(spark):
    given = [r for r in rows_of(9, 300, 6, 0.5) if r[1]]
    index = pivots.build(spark.createDataFrame(given, SCHEMA))
    m = np.array([v for _, v, _ in given])
    best = index.ranges.bounds(m)
    cosine = pivots.unit(m) @ pivots.unit(m).T
    packs = index.packs.select("block", "r_ids").collect()
    at = {i: x for x, (i, _, _) in enumerate(given)}
    assert sum(len(p["r_ids"]) for p in packs) == len(given)
    for p in packs:
        own = [at[i] for i in p["r_ids"]]
        assert (cosine[:, own].max(axis=1) <= best[:, p["block"]] + 1e-9).all()


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0)], SCHEMA)
    got = pivots.search(rows, pivots.build(rows), 5).found
    assert sorted((r["qid"], r["id"], r["score"]) for r in got.collect()) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    zeros = rows.where("id = 2")
    assert pivots.search(zeros, pivots.build(zeros), 5).found.count() == 1
    assert pivots.search(rows, pivots.build(rows.limit(0)), 5).found.count() == 0
    assert pivots.search(rows.limit(0), pivots.build(rows), 5).found.count() == 0


def test_packs_are_bounded_however_large_a_block(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 50)
    rows = spark.range(600).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"), F.lit(0).cast("long").alias("grp"))
    index = pivots.build(rows)
    sizes = [len(p["r_ids"]) for p in index.packs.collect()]
    assert sum(sizes) == 600 and max(sizes) < 110
    got = pivots.search(rows.where("id < 3"), index, 4).found
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == [(q, i) for q in range(3) for i in range(4)]


def test_best_rows_of_a_pair_of_packs(monkeypatch):
    """Against a full sort: ties by id, values without a number, a reach, groups; a whole pack is no sort of all its pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids, own = rng.permutation(900), rng.integers(-1, 2, (900, 3)).astype(float)
    own[7, 1], own[8] = np.nan, 0.0
    groups = ids % 2
    q_ids, q_groups, asked = ids[:40], groups[:40], own[:40]
    reach = np.where(q_ids % 3 == 0, 0.5, np.nan)
    lists = [pa.array([x.ravel().tolist()]) for x in (ids, groups, own, q_ids, q_groups, asked, reach)]
    batch = pa.RecordBatch.from_arrays(lists, names=list("abcdefg"))
    sorted_rows = []
    monkeypatch.setattr(V.np, "lexsort", lambda keys, real=np.lexsort: sorted_rows.append(len(keys[0])) or real(keys))
    for same, skip, smallest in ((False, False, -2.0), (True, True, 0.2)):
        out = list(V._scores(6, same, skip, smallest)(iter([batch])))
        got = sorted((q, -s, i) for b in out for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
        want = []
        for q, g, x, least in zip(q_ids.tolist(), q_groups, asked, reach, strict=True):
            score = np.round(pivots.unit(x) @ pivots.unit(own).T, 6) + 0.0
            rows = [(-s, i) for s, i, h in zip(score.tolist(), ids.tolist(), groups, strict=True) if s >= max(smallest, np.nan_to_num(least, nan=-2.0)) and (not same or g == h) and not (skip and i == q)]
            want += [(q, s, i) for s, i in sorted(rows)[:6]]
        assert got == sorted(want)
    plain = rng.standard_normal((4000, 16))
    lists = [pa.array([x.ravel().tolist()]) for x in (np.arange(4000), np.zeros(4000, int), plain, np.arange(100), np.zeros(100, int), plain[:100])]
    sorted_rows.clear()
    list(V._scores(10, False, False, -2.0)(iter([pa.RecordBatch.from_arrays(lists, names=list("abcdef"))])))
    assert sum(sorted_rows) < 100 * 20
