"""Linear algebra on large weighted graphs: eigenvectors of their Laplacians, harmonic functions, Poisson equations.

A graph is an edge table; a vector is a table with a row for each node. For products with many vectors or in
many steps, nodes are dealt to blocks, and the edges between two blocks are small matrices: a step is one exchange of what
blocks need of each other, and its inner products are sums of a fixed number of values a block. The driver holds
matrices whose size is the number of vectors, never a vector. Every step's vectors are
written to the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import cut, remove, shared_dir, ship, sweep


class Graph:
    """A symmetric weighted graph (a, b, weight) over nodes; loops and weights of zero or less are left out, repeated edges keep the greatest weight.

    Use as a context: the edges are kept in memory and on disk by node until it ends. ``nodes`` may name isolated ones.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        ship(edges.sparkSession)
        both = edges.select("a", "b", "weight").where("a <> b and weight > 0")
        both = both.union(both.select("b", "a", "weight")).groupBy("a", "b").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        self.edges = both.repartition("b").persist(StorageLevel.MEMORY_AND_DISK)
        degree = self.edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
        if nodes is not None:
            degree = nodes.select("node").distinct().join(degree, "node", "outer").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
        self.degrees = cut(degree)

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *_) -> None:
        self.edges.unpersist()
        if "blocks" in self.__dict__:
            self.blocks.packs.unpersist()

    @cached_property
    def blocks(self) -> Blocks:
        """The graph in blocks, made when the first product needs it."""
        return Blocks(self)

    def times(self, vectors: DataFrame, columns: list[str]) -> DataFrame:
        """(node, columns): the weight matrix times each column of vectors; nodes without neighbours have no row."""
        sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]
        return self.edges.join(vectors.select(F.col("node").alias("b"), *columns), "b").groupBy(F.col("a").alias("node")).agg(*sums)


    def parts(self, most: int = 200) -> DataFrame:
        """(node, part): the least node that can be reached. Least labels go to neighbours, and each label to its own label, so that long ways take few rounds."""
        now = cut(self.degrees.select("node", F.col("node").alias("part")))
        for _ in range(most):
            near = self.edges.join(now.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
            after = now.join(near, "node", "left").select("node", "part", F.least("part", F.coalesce("near", "part")).alias("next"))
            jump = now.select(F.col("node").alias("next"), F.col("part").alias("further"))
            after = cut(after.join(jump, "next").select("node", "part", F.least("next", "further").alias("next")))
            moved = not after.where("next <> part").isEmpty()
            now = after.select("node", F.col("next").alias("part"))
            if not moved:
                return now
        raise RuntimeError(f"no end of parts after {most} rounds")


# --- the graph in blocks ---

#: Blocks of nodes that a graph is cut into, if that many are of a size between the least and the greatest number of nodes. A task holds
#: several times a block's state and all that comes to it, in the JVM and in Python, so larger graphs have more blocks, not larger ones.
BLOCKS, LEAST_BLOCK, GREATEST_BLOCK = 12, 2048, 8192
#: Bytes that steps move before the shuffle files behind them are let go.
SWEEP = 1 << 28


def _pack(key: tuple, ways: pa.Table) -> pa.Table:
    """The edges (i, j, weight) from one block to another: the rows i that have any, where each one's edges start, and of each edge the place of j among the j that occur."""
    i, j, weight = (ways.column(c).to_numpy() for c in ("i", "j", "weight"))
    order = np.lexsort((j, i))
    rows, starts = np.unique(i[order], return_index=True)
    place = np.unique(j, return_inverse=True)[1].ravel()[order]
    data = [rows.astype("<i4"), starts.astype("<i8"), place.astype("<i4"), weight[order].astype("<f8")]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], names=["block", "other", "rows", "starts", "place", "weight"])


class Blocks:
    """A graph in blocks: ``nodes`` (node, block, at), each block's places from 0, and ``packs``, the edges of a row's block with one other block.

    As edges stand both ways, the rows of a pack are also the values that the other block needs from this one: a value moves once for each block that
    needs it, and at most once for each edge. A pack is small matrices for numpy, so a product makes no row for an edge.
    """

    def __init__(self, graph: Graph):
        count = graph.degrees.count()
        each = min(max(-(-count // BLOCKS), LEAST_BLOCK), GREATEST_BLOCK)
        self.count = max(1, -(-count // each))
        dealt = graph.degrees.select("node", F.pmod(F.xxhash64("node"), F.lit(self.count)).cast("long").alias("block"))
        self.nodes = cut(dealt.withColumn("at", (F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).cast("long")))
        ends = [self.nodes.select(F.col("node").alias(x), F.col("block").alias(name), F.col("at").alias(at)) for x, name, at in (("a", "block", "i"), ("b", "other", "j"))]
        ways = graph.edges.join(ends[1], "b").join(ends[0], "a").select("block", "other", "i", "j", "weight")
        packs = ways.groupBy("block", "other").applyInArrow(_pack, "block long, other long, rows binary, starts binary, place binary, weight binary")
        self.moved = 0
        self.packs = packs.repartition(self.count, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)

    def step(self, state: DataFrame, stepped: Callable, multiplied: Callable, path: str) -> tuple[DataFrame, np.ndarray]:
        """One product: each block's (packs, state) to what it sends, then its (packs, what came) to its next state, written to ``path``, and the sum of all blocks' sums."""
        spark, packs = state.sparkSession, self.packs.groupBy("block")
        needs = self.packs.select("block", "other", "rows").groupBy("block")
        sent = needs.cogroup(state.groupBy("block")).applyInArrow(stepped, "block long, other long, data binary")
        packs.cogroup(sent.groupBy("block")).applyInArrow(multiplied, "block long, data binary, moved long, sums binary").write.option("compression", "none").parquet(path)
        table = spark.read.schema("block long, data binary, moved long, sums binary").parquet(path)
        got = sorted(table.select("block", "moved", "sums").collect())  # a row for each block, in one order, so that sums don't depend on how rows arrive
        self.moved += sum(r["moved"] for r in got)
        if self.moved > SWEEP:
            self.moved = 0
            sweep(spark)
        return table, np.sum([np.frombuffer(r["sums"], "<f8") for r in got], axis=0)


def _sent(block: int, own: np.ndarray, values: np.ndarray, packs: pa.Table) -> pa.Table:
    """(block, other, data): a block's own state under -1, and of the values of its nodes those that each other block needs."""
    blocks, others, data = [block], [-1], [own.tobytes()]
    for other, rows in zip(packs.column("other").to_pylist(), packs.column("rows"), strict=True):
        blocks.append(other)
        others.append(block)
        data.append(values[np.frombuffer(rows.as_buffer(), "<i4")].tobytes())
    return pa.table([pa.array(blocks, pa.int64()), pa.array(others, pa.int64()), pa.array(data, pa.binary())], names=["block", "other", "data"])


def _neighbours_sum(packs: pa.Table, came: dict[int, pa.Scalar], count: int, width: int) -> np.ndarray:
    """The weight matrix times what came to a block of so many nodes."""
    y, of = np.zeros((count, width)), packs.column("other").to_numpy()
    for k in np.argsort(of):  # in one order, so that sums don't depend on how rows arrive
        rows, starts, place, weight = (np.frombuffer(packs.column(c)[int(k)].as_buffer(), t) for c, t in (("rows", "<i4"), ("starts", "<i8"), ("place", "<i4"), ("weight", "<f8")))
        values = np.frombuffer(came[int(of[k])].as_buffer(), "<f8").reshape(-1, width)
        y[rows] += np.add.reduceat(weight[:, None] * values[place], starts, axis=0)
    return y


def _kept(sent: pa.Table, state: np.ndarray, sums: np.ndarray, came: dict[int, pa.Scalar]) -> pa.Table:
    """(block, data, moved, sums): a block's next state, the bytes that came to it and its part of the sums."""
    moved = sum(len(x.as_buffer()) for x in came.values())
    return pa.table([pa.array([sent.column("block")[0].as_py()], pa.int64()), pa.array([state.tobytes()], pa.binary()), pa.array([moved], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["block", "data", "moved", "sums"])


# --- eigenvectors ---

FORMS = ("combinatorial", "randomwalk", "normalized")


@dataclass
class Eigen:
    """``vectors`` (node, v): the coordinates of every node, one for each of ``values`` in ascending order; ``residuals`` are their norms of (L - value) v."""

    values: np.ndarray
    vectors: DataFrame
    residuals: np.ndarray
    products: int


def _inverse_root(gram: np.ndarray, least: float) -> np.ndarray:
    """A matrix that makes columns with this Gram matrix orthonormal; directions shorter than ``least`` (squared) are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(least, 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


# A block's state is one matrix with a row for a node: its scale, or its degree for D - W, the basis, and the product with the newest columns of the basis.


def _drawn(width: int):
    """Rows (block, at, scale, start) of a block to its state, with ``start`` for the product."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("at").to_numpy())
        start = np.asarray(rows.column("start").combine_chunks().flatten(), np.float64).reshape(-1, width)
        own = np.concatenate([rows.column("scale").to_numpy()[:, None], start], axis=1)[order]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["block", "data"])

    return run


def _turned(turn: np.ndarray, fresh: int, combinatorial: bool):
    """(block, other, data) of a block's packs and its state: the basis and the product times ``turn``, which is the next basis, and of its ``fresh`` last columns what each other block needs."""

    def run(packs: pa.Table, states: pa.Table) -> pa.Table:
        block = states.column("block")[0].as_py()
        was = np.frombuffer(states.column("data")[0].as_buffer(), "<f8").reshape(-1, 1 + len(turn))
        own = np.concatenate([was[:, :1], was[:, 1:] @ turn], axis=1)
        return _sent(block, own, own[:, -fresh:] * (1.0 if combinatorial else own[:, :1]), packs)

    return run


def _projected(width: int, fresh: int, combinatorial: bool, values: np.ndarray):
    """(block, data, sums) of a block's packs and what was sent to it: its state with the product y of the basis' last columns x, and (basis, y) times (x, y), and how far y is from x times the values."""

    def run(packs: pa.Table, sent: pa.Table) -> pa.Table:
        came = dict(zip(sent.column("other").to_pylist(), sent.column("data"), strict=True))
        own = np.frombuffer(came[-1].as_buffer(), "<f8").reshape(-1, 1 + width)
        scale, x = own[:, :1], own[:, -fresh:]
        y = _neighbours_sum(packs, came, len(own), fresh)
        y = y - scale * x if combinatorial else scale * y
        whole = np.concatenate([own, y], axis=1)
        sums = np.concatenate([(whole[:, 1:].T @ np.concatenate([x, y], axis=1)).ravel(), ((y - x * values) ** 2).sum(axis=0)])
        return _kept(sent, whole, sums, came)

    return run


def _coordinates(width: int):
    """(block, at, scale, v) of states: the first ``width`` columns of the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(data.as_buffer(), "<f8").reshape(-1, 1 + 2 * width)
                flat = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * width, pa.array(own[:, 1 : 1 + width].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own))), pa.array(own[:, 0]), flat], names=["block", "at", "scale", "v"])

    return run


#: Blocks of columns that stay when a subspace is full.
KEPT = 4


def eigenvectors(graph: Graph, k: int, form: str = "normalized", tolerance: float = 1e-6, steps: int = 12, restarts: int = 20, seed: int = 7) -> Eigen:
    """The k smallest eigenvalues and vectors of a graph's Laplacian, by block Krylov subspaces that restart with their best Ritz vectors.

    A step is one product of the matrix with the newest columns of the basis, one table and one sum, over the graph in blocks. The driver has the
    basis' Gram matrix and its products with the matrix, summed afresh for the newest columns, so rounding in the basis does not build up.
    A full subspace is turned to its ``KEPT`` blocks of best vectors together with the next columns, so a restart costs no step and the subspace goes on.

    ``form``: D - W; "randomwalk", D**-1 (D - W), whose vectors have length one; "normalized", with D**-1/2 on
    both sides. A node without neighbours is an eigenvector of its own, with value 0 in D - W and 1 in the other forms.
    Ends when the residuals of all k are below the tolerance (times the greatest degree for D - W), else after ``restarts``
    times ``steps`` products. The residuals returned are measured, those of "normalized" for "randomwalk".
    """
    if form not in FORMS:
        raise ValueError(f"unknown form {form!r}; known: {FORMS}")
    combinatorial, spark = form == "combinatorial", graph.degrees.sparkSession
    stats = graph.degrees.agg(F.count("*").alias("n"), F.max("degree").alias("most")).first()
    n, k = stats["n"], min(k, stats["n"])
    if not k:
        return Eigen(np.zeros(0), graph.degrees.select("node", F.array().cast("array<double>").alias("v")), np.zeros(0), 0)
    bound = tolerance * ((stats["most"] or 1.0) if combinatorial else 1.0)
    size, blocks = min(n, k + 2), graph.blocks
    # numbers by hash of node and place, so that the start does not depend on the partitioning
    draw = lambda i: (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 29) - 1) * float((3 / n) ** 0.5)
    scale = F.col("degree") if combinatorial else F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(F.lit(0.0))
    start = graph.degrees.select("node", scale.alias("scale"), F.array(*[draw(i) for i in range(size)]).alias("start"))
    state = start.join(blocks.nodes, "node").select("block", "at", "scale", "start").groupBy("block").applyInArrow(_drawn(size), "block long, data binary")
    top = f"{shared_dir(spark)}/eigenvectors-{uuid.uuid4().hex}"
    turn, fresh, kept, values, products = np.eye(size), size, np.zeros((2, 0, 0)), None, 0
    while True:
        width = turn.shape[1]
        apart = np.zeros(fresh) if values is None else values
        state, sums = blocks.step(state, _turned(turn, fresh, combinatorial), _projected(width, fresh, combinatorial, apart), f"{top}/{products}")
        if products:
            remove(spark, f"{top}/{products - 1}")
        products += 1
        inner, residuals = sums[:-fresh].reshape(width + fresh, 2 * fresh), np.sqrt(sums[-fresh:])
        if values is not None and (last or residuals.max() < bound):
            break
        # the Gram matrix of the basis and the projected matrix: known for what was kept, summed for what is new
        both = np.zeros((2, width, width))
        both[:, : width - fresh, : width - fresh] = kept
        for j in range(2):
            both[j, :, -fresh:] = inner[:width, j * fresh : (j + 1) * fresh]
            both[j, -fresh:] = both[j, :, -fresh:].T
        gram, projected = both
        lengths = _inverse_root(gram, 1e-12 * np.diag(gram).max())
        theta, small = np.linalg.eigh(lengths.T @ ((projected + projected.T) / 2) @ lengths)
        ritz = lengths @ small[:, ::-1]
        inside, own = inner[:width, fresh:], inner[width:, fresh:]
        across = lengths @ (lengths.T @ inside)
        left = own - inside.T @ across
        tails = ritz[-fresh:, :k]
        off = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", tails, left, tails)))
        root = _inverse_root(left, 1e-13 * max(np.abs(np.diag(own)).max(), 1e-300))
        last = not root.shape[1] or products >= restarts * steps
        if last or len(theta) >= k and off.max() < 0.9 * bound:
            values, best = theta[::-1][:k], ritz[:, :k]
            turn, fresh, kept = np.concatenate([best, np.zeros((fresh, k))]), k, np.zeros((2, 0, 0))
            continue
        values = None
        best = ritz[:, : KEPT * size] if width + root.shape[1] > (KEPT + steps) * size else np.eye(width)
        kept = np.stack([best.T @ x @ best for x in both])
        turn = np.block([[best, -across @ root], [np.zeros((fresh, best.shape[1])), root]])
        fresh = root.shape[1]
    found = blocks.nodes.join(state.select("block", "data").mapInArrow(_coordinates(k), "block long, at long, scale double, v array<double>"), ["block", "at"])
    if form == "randomwalk":
        found = found.withColumn("v", F.transform("v", lambda x: F.when(F.col("scale") > 0, x * F.col("scale")).otherwise(x)))
        lengths = found.agg(*[F.sqrt(F.sum(F.pow(F.col("v")[i], 2))) for i in range(k)]).first()
        found = found.withColumn("v", F.array(*[F.col("v")[i] / F.lit(float(x or 1.0)) for i, x in enumerate(lengths)]))
    found = cut(found.select("node", "v"))
    remove(spark, top)
    return Eigen(-values if combinatorial else 1 - values, found, residuals, products)


# --- linear systems ---


@dataclass
class Solved:
    """``values`` (node, one column for each right side), and how far each one's residual went down."""

    values: DataFrame
    residuals: dict[str, float]
    steps: int


# A block's state is one array of the scale s, the solution x, the residual r, the direction p and the product ap, each with a row for a node and a column for a right side.


def _begun(width: int):
    """Rows (block, at, scale, right) of a block to its state."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("at").to_numpy())
        s, r = (np.asarray(rows.column(c).combine_chunks().flatten(), np.float64).reshape(-1, width)[order] for c in ("scale", "right"))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.stack([s, np.zeros_like(r), r, r, np.zeros_like(r)]).tobytes()], pa.binary())], names=["block", "data"])

    return run


def _matrices(data: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<f8").reshape(5, -1, width)


def _stepped(width: int, factors: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """(block, other, data) of a block's packs and its state: for each other block the directions it needs, and the block's own state after the step, under -1."""

    def run(packs: pa.Table, states: pa.Table) -> pa.Table:
        block = states.column("block")[0].as_py()
        s, x, r, p, ap = _matrices(states.column("data")[0], width)
        if factors is not None:
            a, b, moves = factors
            x, r = x + a * p, r - a * ap
            p = np.where(moves, r + b * p, p)
        return _sent(block, np.stack([s, x, r, p, ap]), s * p, packs)

    return run


def _multiplied(width: int):
    """(block, data, sums) of a block's packs and what was sent to it: its state with the product, and the inner products of r r, p ap, r ap and ap ap."""

    def run(packs: pa.Table, sent: pa.Table) -> pa.Table:
        came = dict(zip(sent.column("other").to_pylist(), sent.column("data"), strict=True))
        s, x, r, p, _ = _matrices(came[-1], width)
        ap = p - s * _neighbours_sum(packs, came, len(p), width)
        sums = np.concatenate([(u * v).sum(axis=0) for u, v in ((r, r), (p, ap), (r, ap), (ap, ap))])
        return _kept(sent, np.stack([s, x, r, p, ap]), sums, came)

    return run


def _solutions(width: int):
    """(block, at, x) of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _matrices(data, width)[1]
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), pa.array(np.arange(len(x))), flat], names=["block", "at", "x"])

    return run


def _conjugate_gradients(graph: Graph, start: DataFrame, columns: list[str], tolerance: float, most: int) -> Solved:
    """values (node, x) with (1 - S W S) x = right for ``start`` (node, scale, right: a number for each column), S the scales, which are 0 where nothing is unknown.

    All columns go in step, each with factors of its own. A step is one product, one
    table and one sum; the next residual's norm follows from the sums, and is summed afresh in the next step. Tables but the last are removed again.
    """
    spark, width, blocks = start.sparkSession, len(columns), graph.blocks
    top = f"{shared_dir(spark)}/gradients-{uuid.uuid4().hex}"
    begun = start.join(blocks.nodes, "node").select("block", "at", "scale", "right").groupBy("block").applyInArrow(_begun(width), "block long, data binary")
    state, factors, first = begun, None, None
    for step in range(most + 1):
        table, sums = blocks.step(state, _stepped(width, factors), _multiplied(width), f"{top}/{step}")
        if step:
            remove(spark, f"{top}/{step - 1}")
        rr, pap, rap, apap = sums.reshape(4, width) if sums.size else np.zeros((4, width))
        first = rr if first is None else first
        moves = (rr > tolerance**2 * first) & (pap > 0)
        if not moves.any() or step == most:
            left = {c: float((n / f) ** 0.5) if f > 0 else 0.0 for c, n, f in zip(columns, rr, first, strict=True)}
            found = table.select("block", "data").mapInArrow(_solutions(width), "block long, at long, x array<double>")
            return Solved(cut(blocks.nodes.join(found, ["block", "at"]).select("node", "x")), left, step)
        a = np.where(moves, rr / np.where(moves, pap, 1.0), 0.0)
        factors = a, np.where(moves, np.maximum(0.0, rr - 2 * a * rap + a * a * apap) / np.where(moves, rr, 1.0), 0.0), moves
        state = table.select("block", "data")
    raise AssertionError


def harmonic(graph: Graph, given: DataFrame, columns: list[str], tolerance: float = 1e-8, most: int = 500) -> Solved:
    """values (node, columns): each column harmonic on the graph but at the nodes where ``given`` (node, columns) has a value for it.

    Every column has given nodes of its own (null: not given). Where no given node can be reached, the value is 0.
    Solved for the normalised unknowns D**1/2 u, which is what conjugate gradients with the diagonal as preconditioner do.
    """
    root = F.sqrt("degree")
    fixed = given.select("node", *[F.col(c).cast("double").alias(f"f_{c}") for c in columns])
    rows = cut(graph.degrees.join(fixed, "node", "left"))
    w = graph.times(rows.select("node", *[F.coalesce(f"f_{c}", F.lit(0.0)).alias(f"f_{c}") for c in columns]), [f"f_{c}" for c in columns])
    free = lambda c, value: F.when(F.col(f"f_{c}").isNull() & (F.col("degree") > 0), value).otherwise(F.lit(0.0))
    start = rows.join(w.toDF("node", *[f"b_{c}" for c in columns]), "node", "left")
    start = start.select("node", F.array(*[free(c, 1 / root) for c in columns]).alias("scale"), F.array(*[free(c, F.coalesce(f"b_{c}", F.lit(0.0)) / root) for c in columns]).alias("right"))
    solved = _conjugate_gradients(graph, start, columns, tolerance, most)
    value = lambda i, c: F.coalesce(F.col(f"f_{c}"), F.when(F.col("degree") > 0, F.col("x")[i] / root), F.lit(0.0))
    return Solved(rows.join(solved.values, "node").select("node", *[value(i, c).alias(c) for i, c in enumerate(columns)]), solved.residuals, solved.steps)


def poisson(graph: Graph, sources: DataFrame, columns: list[str], tolerance: float = 1e-8, most: int = 500) -> Solved:
    """values (node, columns) with (D - W) u = source for ``sources`` (node, columns).

    Only sources that add up to zero on a connected part have a solution there; what a part has over is taken off its nodes by degree.
    Of all solutions the one whose mean, weighted by degree, is zero on each part. Sources at nodes without neighbours are left out.
    """
    root = F.sqrt("degree")
    given = graph.degrees.where("degree > 0").join(sources.select("node", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s_{c}") for c in columns]), "node", "left").join(graph.parts(), "node")
    over = given.groupBy("part").agg(F.sum("degree").alias("whole"), *[F.sum(f"s_{c}").alias(f"o_{c}") for c in columns])
    balanced = given.join(over, "part").select("node", *[(F.coalesce(f"s_{c}", F.lit(0.0)) - F.col("degree") * F.coalesce(f"o_{c}", F.lit(0.0)) / F.col("whole")).alias(f"s_{c}") for c in columns])
    linked = lambda value: F.when(F.col("degree") > 0, value / root).otherwise(F.lit(0.0))
    rows = graph.degrees.join(balanced, "node", "left")
    start = rows.select("node", F.array(*[linked(F.lit(1.0)) for _ in columns]).alias("scale"), F.array(*[linked(F.coalesce(f"s_{c}", F.lit(0.0))) for c in columns]).alias("right"))
    solved = _conjugate_gradients(graph, start, columns, tolerance, most)
    return Solved(graph.degrees.join(solved.values, "node").select("node", *[linked(F.col("x")[i]).alias(c) for i, c in enumerate(columns)]), solved.residuals, solved.steps)


def argmax(columns: list[str]) -> Column:
    """The name of the greatest of several columns, ties to the first."""
    best = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in columns])
