"""Eigenvectors, harmonic functions and Poisson equations on graphs against dense numpy."""

import numpy as np
import pytest

from quillstone.operators import graph as G
from quillstone.operators import solvers


def knn_graph(n, seed, clusters=4, k=6, isolated=0):
    rng = np.random.default_rng(seed)
    points = rng.standard_normal((clusters, 5))[rng.integers(0, clusters, n)] * 2 + rng.standard_normal((n, 5)) * 0.7
    far = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    near = np.argsort(far, axis=1)[:, 1 : k + 1]
    w = np.zeros((n + isolated, n + isolated))
    for i in range(n):
        w[i, near[i]] = np.exp(-4 * far[i, near[i]] / far[i, near[i, -1]])
    return np.maximum(w, w.T)


def as_edges(spark, w):
    a, b = np.nonzero(w)
    rows = [(int(i) * 3 + 1, int(j) * 3 + 1, float(w[i, j])) for i, j in zip(a, b) if i < j or (i + j) % 2]
    rows += [(1, 1, 5.0), (1, 4, 0.0)]  # a loop and an empty edge count for nothing
    return spark.createDataFrame(rows, "a long, b long, weight double").repartition(5)


def node_table(spark, n):
    return spark.createDataFrame([(3 * i + 1,) for i in range(n)], "node long")


def dense(w, form):
    d = w.sum(axis=1)
    lap = np.diag(d) - w
    if form == "combinatorial":
        return lap
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(w)) - root[:, None] * w * root


def matrix_of(df, column="v"):
    rows = sorted((r["node"], r[column]) for r in df.collect())
    return np.array([v for _, v in rows])


@pytest.mark.parametrize("form,n,isolated,clusters", [("normalized", 500, 0, 4), ("combinatorial", 60, 2, 3), ("randomwalk", 60, 2, 3)])
def test_eigenvectors_are_those_of_dense_numpy(spark, form, n, isolated, clusters):
    w = knn_graph(n, n, clusters, isolated=isolated)
    k = 4 if n == 500 else 7
    with solvers.Graph(as_edges(spark, w), node_table(spark, n + isolated)) as graph:
        got = solvers.eigenvectors(graph, k, form)
        vectors = matrix_of(got.vectors)
    lap = dense(w, form)
    want = np.linalg.eigvalsh(lap)[:k]
    scale = w.sum(axis=1).max() if form == "combinatorial" else 1.0
    assert got.values == pytest.approx(want, abs=1e-8 * scale) and got.residuals.max() < 1e-6 * scale
    assert vectors.shape == (n + isolated, k)
    if form == "randomwalk":
        d = w.sum(axis=1)
        assert np.linalg.norm(vectors, axis=0) == pytest.approx(np.ones(k))
        off = d[:, None] * vectors - w @ vectors - d[:, None] * vectors * got.values
        assert np.abs(off).max() < 1e-5 * d.max()
    else:
        assert vectors.T @ vectors == pytest.approx(np.eye(k), abs=1e-8)
        assert np.linalg.norm(lap @ vectors - vectors * got.values, axis=0).max() < 1.1e-6 * scale
        # the spaces agree, not only the values: the gap behind the last one decides how closely
        rest = np.linalg.eigvalsh(lap)[k] - want[-1]
        basis = np.linalg.eigh(lap)[1][:, :k]
        assert np.linalg.norm(vectors - basis @ (basis.T @ vectors)) < 1e-5 * scale / max(rest, 1e-3)


def test_values_close_to_each_other_take_few_steps(spark):
    """A neighbour graph of points without clusters, whose values have small gaps."""
    rng = np.random.default_rng(8)
    points = rng.standard_normal((700, 24))
    far = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    near = np.argsort(far, axis=1)[:, 1:9]
    w = np.zeros((700, 700))
    np.put_along_axis(w, near, rng.uniform(0.2, 1, near.shape), axis=1)
    w = np.maximum(w, w.T)
    with solvers.Graph(as_edges(spark, w)) as graph:
        got = solvers.eigenvectors(graph, 13, "normalized", tolerance=1e-3, steps=4, restarts=5)
        vectors = matrix_of(got.vectors)
    lap = dense(w, "normalized")
    assert got.residuals.max() < 1e-3
    assert got.values == pytest.approx(np.linalg.eigvalsh(lap)[:13], abs=1e-3)
    assert vectors.T @ vectors == pytest.approx(np.eye(13), abs=1e-8)
    assert np.linalg.norm(lap @ vectors - vectors * got.values, axis=0).max() < 1.1e-3


def test_more_vectors_than_nodes_and_none(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0)], "a long, b long, weight double")
    with solvers.Graph(edges) as graph:
        got = solvers.eigenvectors(graph, 9, "combinatorial")
    w = np.array([[0, 1, 0], [1, 0, 2], [0, 2, 0]], float)
    assert got.values == pytest.approx(np.linalg.eigvalsh(dense(w, "combinatorial")), abs=1e-9)
    with solvers.Graph(edges.limit(0)) as graph:
        assert solvers.eigenvectors(graph, 3).vectors.collect() == []


@pytest.mark.parametrize("n,isolated", [(120, 3)])
def test_harmonic_functions(spark, n, isolated):
    """Each column with given nodes of its own."""
    rng = np.random.default_rng(n)
    w = knn_graph(n, n + 1, 3, isolated=isolated)
    given = {c: {int(i): float(rng.integers(0, 3)) for i in rng.choice(n, 12 + 5 * j, replace=False)} for j, c in enumerate("abc")}
    rows = [(3 * i + 1, *[given[c].get(i) for c in "abc"]) for i in range(n + isolated) if any(i in given[c] for c in "abc")]
    with solvers.Graph(as_edges(spark, w), node_table(spark, n + isolated)) as graph:
        got = solvers.harmonic(graph, spark.createDataFrame(rows, "node long, a double, b double, c double"), ["a", "b", "c"], 1e-10)
        found = {c: matrix_of(got.values, c) for c in "abc"}
    lap = dense(w, "combinatorial")
    for c in "abc":
        fixed = np.array(sorted(given[c]))
        values = np.array([given[c][i] for i in fixed])
        reached = _reached(w, fixed)
        free = np.array([i for i in range(len(w)) if reached[i] and i not in given[c]])
        want = np.zeros(len(w))
        want[fixed] = values
        want[free] = np.linalg.solve(lap[np.ix_(free, free)], -lap[np.ix_(free, fixed)] @ values)
        assert found[c] == pytest.approx(want, abs=1e-6)
    assert max(got.residuals.values()) <= 1e-10


def _reached(w, start):
    seen = np.zeros(len(w), bool)
    seen[start] = True
    while True:
        more = seen | (w[seen] > 0).any(axis=0)
        if (more == seen).all():
            return seen
        seen = more


@pytest.mark.parametrize("n", [80])
def test_poisson_equations(spark, n):
    w = knn_graph(n, n + 2, 1, k=8)
    rng = np.random.default_rng(5)
    s = np.zeros((n, 2))
    at = rng.choice(n, 10, replace=False)
    s[at] = rng.standard_normal((10, 2))
    s[at] -= s[at].mean(axis=0)
    rows = [(3 * int(i) + 1, *map(float, s[i])) for i in at]
    with solvers.Graph(as_edges(spark, w)) as graph:
        got = solvers.poisson(graph, spark.createDataFrame(rows, "node long, x double, y double"), ["x", "y"], 1e-11)
        found = np.stack([matrix_of(got.values, c) for c in "xy"], axis=1)
    lap, d = dense(w, "combinatorial"), w.sum(axis=1)
    want = np.linalg.pinv(lap) @ s
    want -= (d @ want) / d.sum()
    assert found == pytest.approx(want, abs=1e-6 * np.abs(want).max()) and d @ found == pytest.approx(0, abs=1e-6)


def test_parts(spark):
    """Chains in an order that lets least labels move one step a round, a loner, a pair."""
    edges = [(i, i + 1, 1.0) for i in range(100, 160)] + [(500 - i, 501 - i, 1.0) for i in range(50)] + [(7, 9, 1.0)]
    with solvers.Graph(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([(3,), (7,)], "node long")) as graph:
        got = {r["node"]: r["part"] for r in graph.parts(20).collect()}
    assert got == {3: 3, 7: 7, 9: 7} | {i: 100 for i in range(100, 161)} | {i: 451 for i in range(451, 502)}


def test_nothing_given(spark):
    w = knn_graph(30, 1, 1)
    with solvers.Graph(as_edges(spark, w)) as graph:
        got = solvers.harmonic(graph, spark.createDataFrame([], "node long, a double"), ["a"])
        assert {r["a"] for r in got.values.collect()} == {0.0} and got.steps == 0
        got = solvers.poisson(graph, spark.createDataFrame([], "node long, a double"), ["a"])
        assert {r["a"] for r in got.values.collect()} == {0.0}


def planted(n=48):
    """Three groups that few weak edges join, and which node is in which."""
    rng = np.random.default_rng(4)
    own = np.arange(n) % 3
    w = np.where(own[:, None] == own, rng.uniform(0.5, 1, (n, n)), 0.0) * (rng.random((n, n)) < 0.4)
    for i in range(0, n, 9):
        w[i, (i + 1) % n] = 0.01
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, 0)
    return w, own


def test_planted_groups_are_found(spark):
    w, own = planted()
    with solvers.Graph(as_edges(spark, w)) as graph:
        got = {(r["id"] - 1) // 3: r["cluster"] for r in G.spectral_clusters(graph, 3, "normalized", extra=0).collect()}
    assert len(got) == len(own) and len({(got[i], own[i]) for i in got}) == 3


@pytest.mark.parametrize("method", ["laplace", "poisson"])
def test_labels_from_a_few_seeds(spark, method):
    """As dense linear algebra has them, in two runs of columns; the label of a node with several is the least."""
    w, own = planted()
    seeds = [(3 * i + 1, int(own[i]) + 5) for i in (0, 1, 2, 3, 10, 20)] + [(1, 9), (7, None), (10**6, 5)]
    with solvers.Graph(as_edges(spark, w)) as graph:
        got = {(r["node"] - 1) // 3: (r["label"], r["u"]) for r in G.learn_labels(graph, spark.createDataFrame(seeds, "node long, label long"), method, at_once=2).collect()}
        assert G.learn_labels(graph, spark.createDataFrame([], "node long, label long"), method).count() == 0
    fixed = np.array([0, 1, 2, 3, 10, 20])
    onehot = (own[fixed][:, None] == np.arange(3)).astype(float)
    lap, d = dense(w, "combinatorial"), w.sum(axis=1)
    want = np.zeros((len(w), 3))
    if method == "laplace":
        free = np.setdiff1d(np.arange(len(w)), fixed)
        want[fixed], want[free] = onehot, np.linalg.solve(lap[np.ix_(free, free)], -lap[np.ix_(free, fixed)] @ onehot)
    else:
        want[fixed] = onehot - onehot.mean(axis=0)
        want = np.linalg.pinv(dense(w, "normalized"), rcond=1e-9) @ (want / np.sqrt(d)[:, None]) / np.sqrt(d)[:, None]
    assert {i: label for i, (label, _) in got.items()} == {i: int(x) + 5 for i, x in enumerate(want.argmax(axis=1))}
    assert [got[i][1] for i in range(len(w))] == pytest.approx(want.max(axis=1).tolist(), abs=1e-6)


def test_trusted_keywords_by_hand(spark):
    """Ten texts: `every` stands in all, `third` in three, `paired` in two, `alone` in one; short words never count."""
    texts = [(i, " ".join(["every", "tiny", *["third"] * (i < 3) * 2, *["paired"] * (i in (2, 5)), *["alone"] * (i == 7), f"single{i}"])) for i in range(10)] + [(11, None)]
    df = spark.createDataFrame(texts, "text_id long, text string")
    of = lambda **kind: sorted((r["text_id"], r["k"], r["r"]) for r in G.trusted_keywords(df, **kind).collect())
    assert of() == [(2, "paired", 1), (5, "paired", 1)]  # a fifth of ten is two
    assert of(share=0.3) == [(0, "third", 1), (1, "third", 1), (2, "paired", 2), (2, "third", 1), (5, "paired", 1)]
    assert of(share=0.3, each=1) == [(0, "third", 1), (1, "third", 1), (2, "third", 1), (5, "paired", 1)]
    assert [x for x in of(share=1.0, each=1)] == [(i, "every", 1) for i in range(10)]
    assert of(share=0.0) == [(2, "paired", 1), (5, "paired", 1)] and of(least=3) == [(0, "third", 1), (1, "third", 1), (2, "third", 1)]
    assert of(least=1, share=0.1, shortest=7) == [(i, f"single{i}", 1) for i in range(10)]


def test_a_value_moves_once_for_each_block_that_needs_it(spark, monkeypatch):
    """A product with the graph in several blocks: packs hold the edges whole, and systems have their answers, also where a hub meets all and a node is alone."""
    monkeypatch.setattr(solvers, "LEAST_BLOCK", 16)
    monkeypatch.setattr(solvers, "BLOCKS", 4)
    rng = np.random.default_rng(12)
    w = np.triu(rng.uniform(0.1, 1, (150, 150)) * (rng.random((150, 150)) < 0.05), 1)
    w[0, 1:140] = 0.3
    w = w + w.T
    w[149], w[:, 149] = 0, 0
    nodes = spark.createDataFrame([(int(i),) for i in range(150)], "node long")
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "a long, b long, weight double")
    with solvers.Graph(edges, nodes) as graph:
        assert graph.blocks.count == 4
        block = {r["node"]: r["block"] for r in graph.blocks.nodes.collect()}
        packs = graph.blocks.packs.collect()
        assert len({(r["block"], r["other"]) for r in packs}) == len(packs) <= 16
        assert sum(len(r["weight"]) // 8 for r in packs) == np.count_nonzero(w)
        assert sum(len(r["rows"]) // 4 for r in packs) == len({(i, block[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(w)), strict=True)})
        given = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 2.0), (77, None, -1.0)], "node long, a double, b double")
        got = {r["node"]: (r["a"], r["b"]) for r in solvers.harmonic(graph, given, ["a", "b"], 1e-9).values.collect()}
    assert len(got) == 150
    for column, fixed in enumerate(({1: 1.0, 2: 0.0}, {2: 2.0, 77: -1.0})):
        lap, right = np.diag(w.sum(axis=1)) - w, np.zeros(150)
        lap[149, 149] = 1
        for at, value in fixed.items():
            lap[at], lap[at, at], right[at] = 0, 1, value
        assert [got[i][column] for i in range(150)] == pytest.approx(np.linalg.solve(lap, right), abs=1e-7)


@pytest.mark.parametrize("form", ["combinatorial", "randomwalk", "normalized"])
def test_eigenvectors_over_several_blocks_take_a_step_a_product(spark, monkeypatch, form):
    """Before, a product made a row for each edge, and a subspace that was full was filtered in dozens of further products."""
    monkeypatch.setattr(solvers, "LEAST_BLOCK", 16)
    monkeypatch.setattr(solvers, "BLOCKS", 4)
    taken, real = [], solvers.Blocks.step
    monkeypatch.setattr(solvers.Blocks, "step", lambda self, *a: (taken.append(a), real(self, *a))[1])
    rng = np.random.default_rng(21)
    w = np.triu(rng.uniform(0.1, 1, (160, 160)) * (rng.random((160, 160)) < 0.06), 1)
    w[0, 1:150] = 0.3
    w = w + w.T
    w[158:], w[:, 158:] = 0, 0
    with solvers.Graph(as_edges(spark, w), node_table(spark, 160)) as graph:
        assert graph.blocks.count == 4
        got = solvers.eigenvectors(graph, 5, form, tolerance=1e-7, steps=3, restarts=30)
        vectors = matrix_of(got.vectors)
    scale = w.sum(axis=1).max() if form == "combinatorial" else 1.0
    assert len(taken) == got.products and got.residuals.max() < 1e-7 * scale
    assert got.values == pytest.approx(np.linalg.eigvalsh(dense(w, form))[:5], abs=1e-9 * scale)
    if form == "randomwalk":
        d = w.sum(axis=1)
        assert np.abs(d[:, None] * vectors - w @ vectors - d[:, None] * vectors * got.values).max() < 1e-6 * d.max()
    else:
        assert vectors.T @ vectors == pytest.approx(np.eye(5), abs=1e-8)
        assert np.linalg.norm(dense(w, form) @ vectors - vectors * got.values, axis=0).max() < 1.1e-7 * scale


def test_a_block_stays_small_however_large_the_graph(spark):
    """Before, blocks grew to 32,768 nodes, whose states and messages filled an executor."""
    edges = spark.range(110_000).selectExpr("id a", "id + 1 b", "1.0 weight")
    with solvers.Graph(edges) as graph:
        sizes = [r["count"] for r in graph.blocks.nodes.groupBy("block").count().collect()]
    assert sum(sizes) == 110_001 and max(sizes) < 8192 * 1.05
