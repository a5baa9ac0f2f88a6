"""The neighbours that labels spread over are searched once, before the rounds."""

import numpy as np

from quillstone.operators import graph
from quillstone.plans import graphs


def test_rounds_read_found_neighbours(spark, monkeypatch):
    seen, real = [], graph.propagate_labels
    monkeypatch.setattr(graph, "propagate_labels", lambda edges, seeds: (seen.append(edges), real(edges, seeds))[1])
    assert graphs.label_propagation(spark, "/root/testdata/sf0.001").columns == ["node", "label"]
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_every_row_has_its_neighbours_in_the_graph(spark, monkeypatch):
    """Before, only every 20th row was asked for neighbours, and rows that none of those met had no label."""
    seen, real = [], graph.propagate_labels
    monkeypatch.setattr(graph, "propagate_labels", lambda edges, seeds: (seen.append(edges), real(edges, seeds))[1])
    rows = graphs._vectors(spark, "/root/testdata/sf0.001").collect()
    got = {r["node"]: r["label"] for r in graphs.label_propagation(spark, "/root/testdata/sf0.001").collect()}
    ids = np.array([r["id"] for r in rows])
    m = np.array([r["v"] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(m @ m.T, 6)
    np.fill_diagonal(score, -9)
    near = np.array([np.lexsort((ids, -s))[:8] for s in score])
    far = 1 - np.take_along_axis(score, near, axis=1)
    w = np.zeros(score.shape)
    np.put_along_axis(w, near, np.exp(-4 * far**2 / far.max(axis=1, keepdims=True) ** 2), axis=1)
    w = np.maximum(w, w.T)
    assert {(r["a"], r["b"]) for r in seen[0].collect()} == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(w), strict=True)}
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    names = sorted(set(labels.values()))
    seeds = np.array([[float(i % 20 == 0 and labels[i] == x) for x in names] for i in ids])
    now = seeds
    for _ in range(10):
        now = 0.5 * seeds + 0.5 * (w / w.sum(axis=0)).T @ now
    reached = now.sum(axis=1) > 0
    want = {int(i): names[x] for i, x, some in zip(ids, np.round(now, 9).argmax(axis=1), reached, strict=True) if some}
    assert got == want and len(got) > 450
