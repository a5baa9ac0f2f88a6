"""Vector codes and hard negatives against plain versions in whole numbers, and over odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import negatives, registry, vafile
from quillstone.llm.common import documents

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def table(spark, seed, n=300, width=16, spread=1.0):
    """Clusters, copies, one vector that a third of the rows hold, nulls and non-finite components."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = centres[0] if rng.random() < 0.33 else [x + rng.gauss(0, 0.2) for x in c]
        rows.append((i, [float(np.float32(x)) for x in v], rng.choice([0, 1, 2, 9, None]) if rng.random() < 0.9 else 1))
    rows += [(n, None, 1), (n + 1, [1.0] * (width - 1) + [None], 1), (n + 2, [NAN] * width, 2), (n + 3, [INF] + [0.0] * (width - 1), None), (n + 4, [-INF] * width, 3)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: r[0])
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    d = len(whole[0]) // parts
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[list(cut[e][p]) for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(book)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            for e, members in own.items():
                books[p][e] = [sum(m[j] for m in members) // len(members) for j in range(d)]
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, code, err, by_label[label], sha) for i, code, err, label in out)


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 1.0), (2, 120, 40.0), (3, 9, 1.0), (4, 17, 0.001)])
def test_codes_are_those_of_a_plain_version(spark, seed, n, spread):
    rows = table(spark, seed, n, 16, spread)
    got = vafile.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == plain_codes(rows)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3000, 3000, (16, 8))
    entries[5] = entries[3]  # a tie goes to the lower entry
    rows = np.concatenate([rng.integers(-3000, 3000, (400, 8)), entries + rng.integers(-40, 40, (16, 8)), entries])
    far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    file = vafile.Cells(entries)
    lower, upper = file.bounds(rows)
    assert (lower.T <= far).all() and (far <= upper.T).all()
    best, distance, refined = file.nearest(rows)
    assert (best == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    assert len(rows) <= refined < 0.6 * far.size


def test_odd_vectors(spark):
    rows = [(3, [1.0, 2.0, 3.0], 1), (1, [], None), (1, [], None), (2, [3e38, -3e38] * 5, None), (None, [0.5] * 9, 7), (9, None, 1)]
    got = {r["vec_id"]: r for r in vafile.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, None} and all(len(r["code"]) == 16 and r["error"] >= 0 for r in got.values())
    assert got[1]["label_error"] == got[2]["label_error"] >= got[2]["error"] + 2 * got[1]["error"]
    ragged = [(4, [0.5], 1), (1, [1.0, -2.0, 3.0], 1), (2, [], 2), (3, [0.25] * 9, None), (3, [0.25] * 9, None)]
    padded = [(i, v + [0.0] * (16 - len(v)), label) for i, v, label in ragged]
    assert sorted(map(tuple, vafile.compress(spark.createDataFrame(ragged, SCHEMA)).collect())) == plain_codes(padded)
    only_null = vafile.compress(spark.createDataFrame([(None, [1.0], 1)], SCHEMA)).collect()
    assert [(r["code"], r["error"]) for r in only_null] == [("00" * 8, 0)]


@pytest.mark.parametrize("run", [vafile.compress, negatives.hard_negatives])
def test_no_rows_and_clashing_columns(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark.createDataFrame([(100, None, 1), (200, [NAN], 1)], SCHEMA)).collect() == []
    df = spark.createDataFrame(table(spark, 5, 210), SCHEMA)
    extra = "code error place total rank score key anchor id Label VEC_ID _label".split()
    more = df.select("*", *[F.lit("z").alias(f"x{i}") for i in range(len(extra))]).toDF(*df.columns, *extra)
    assert sorted(map(tuple, run(df).collect())) == sorted(map(tuple, run(more).collect()))


def plain_negatives(rows):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]
    out = []
    anchors = {}
    for i, label, v in kept:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in kept if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(-t, i) for t, i, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,n,block_bytes", [(1, 700, 1 << 24), (2, 1200, 300), (3, 101, 1 << 24)])
def test_negatives_are_those_of_a_plain_version(spark, monkeypatch, seed, n, block_bytes):
    """With several blocks of anchors too; a third of the rows hold one vector, so scores tie."""
    rows = table(spark, seed, n, 12)
    monkeypatch.setattr(negatives.mine, "__defaults__", (*negatives.mine.__defaults__[:-1], block_bytes))
    got = sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()))
    assert got == plain_negatives(rows) and len(got) > 5


def test_repeated_ids_and_odd_rows(spark):
    rows = table(spark, 8, 320, 8)
    rows += [(100, [2.0] * 8, 1), (100, [1.5] * 8, 1), (150, [1.0] * 8, 1), (151, [1.0] * 8, 4), (151, [1.0] * 8, 4), (None, [1.0] * 8, 1), (7, [1.0] * 8, None), (200, [], 1)]
    got = sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()))
    padded = [(i, v + [0.0] * (8 - len(v)) if v is not None else v, label) for i, v, label in rows]
    # an empty vector counts as zeros, but is less than any other where ids repeat
    assert len(got) > 5 and {r[0] for r in got} <= {0, 100, 200, 300}
    assert [r for r in got if r[0] != 200] == [r for r in plain_negatives(padded) if r[0] != 200]
    huge = [(i, [3e38 * (-1) ** i] * 4, i % 2) for i in range(0, 300, 50)]
    assert all(abs(r["negative_score"]) < 2**53 for r in negatives.hard_negatives(spark.createDataFrame(huge, SCHEMA)).collect())


def test_queries_cover_the_whole_table(spark):
    rows = documents(spark, "/root/testdata/sf0.001", "embeddings")
    assert registry.op11_va_file(spark, "/root/testdata/sf0.001").count() == rows.count()
    found = registry.op13_hard_negatives(spark, "/root/testdata/sf0.001").select("anchor_id").distinct().count()
    assert found == rows.where("vec_id % 100 = 0").count()
