"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its distinct words, hashed to ``BUCKETS`` slots and weighted by
1 + log of their count, as a vector of length 1; a few measures of its structure; and, as
metadata, the size that ``n_chars`` states and how far it is from the text's own (null, negative or
absent: the text's own). Measures are standardised on the training rows. The score is the logistic of bias + linear
terms + all pairwise interactions of rank ``RANK``, which cost linear time:
sum over f of ((sum v x)^2 - sum v^2 x^2) / 2.

Training uses labelled documents of the folds that may be learned from, at most ``ROWS`` ids
(those with the least hash; ties by id), one row an id; their features, not their texts, go to the
driver, by mini-batch AdaGrad from a fixed seed. Scoring covers every whole text.

Defined cases: null text counts as empty; empty texts are scored by structure alone.
Rows with a null label are not learned from; of several labels of one document the
greatest holds. Without labels, or with one kind only, every score is the (smoothed)
share of label 1. Very long texts are scored whole, row by row. Empty tables give no rows. Repeated
rows get equal scores, and count once where they are learned from. Extra
columns, whatever their names, are ignored; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, take

BUCKETS = 1 << 15
RANK = 8
ROWS = 8192
EPOCHS = 6
CACHE = 300_000

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = ~(_LETTERS | _DIGITS | _SENTENCE | _SPACE)
STRUCTURE = (
    "size words word_length distinct top_share repeats letters upper digits sentence odd lines pipes exclaims long_words stated_size size_off".split()
)


def structure(text: str, raw: np.ndarray, words: list[str], counts: Counter) -> list[float]:
    """The measures named in STRUCTURE, but for the last two."""
    n, w = max(1, len(raw)), max(1, len(words))
    by = np.bincount(raw, minlength=256)
    share = lambda kind: float(by[kind].sum()) / n
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        min(40.0, len(text) / w),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        repeats,
        share(_LETTERS),
        share(_UPPER),
        share(_DIGITS),
        share(_SENTENCE),
        share(_ODD),
        float(by[10]) / w,
        float(by[ord("|")]) / w,
        float(by[ord("!")]) / w,
        sum(1 for x in counts if len(x) > 15) / max(1, len(counts)),
    ]


def metadata(text: str, n_chars: float | None) -> list[float]:
    """The last two measures named in STRUCTURE."""
    own = float(np.log1p(len(text)))
    stated = own if n_chars is None or not n_chars >= 0 else float(np.log1p(n_chars))
    return [stated, abs(stated - own)]


class Features:
    """Texts to (slots, weights, structure), with a bounded memory of hashed words."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.slots: dict[str, int] = {}

    def of(self, text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        words = text.split()
        counts = Counter(words)
        slots, known, buckets = [], self.slots, self.buckets
        if len(known) > CACHE:
            known.clear()
        for word in counts:
            slot = known.get(word)
            if slot is None:
                slot = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets
            slots.append(slot)
        weights = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
        norm = float(np.sqrt((weights**2).sum())) or 1.0
        return np.array(slots, np.int64), (weights / norm).astype(np.float32), structure(text, raw, words, counts) + metadata(text, n_chars)


@dataclass
class Machine:
    """Slots 0 .. buckets-1 are words, then one slot for each measure of structure."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    buckets: int

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, values, first position of each row), all rows after each other."""
        extra = self.buckets + np.arange(len(self.mean))
        dense = (np.clip((np.array([x[2] for x in found]) - self.mean) / self.scale, -4, 4) / np.sqrt(len(self.mean))).astype(np.float32)
        slots = np.concatenate([y for x in found for y in (x[0], extra)])
        values = np.concatenate([y for x, d in zip(found, dense, strict=True) for y in (x[1], d)])
        starts = np.concatenate([[0], np.cumsum([len(x[0]) + len(extra) for x in found])[:-1]])
        return slots, values, starts

    def raw(self, slots, values, starts):
        """(score before the logistic, sums of v x by row)."""
        vx = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, found) -> np.ndarray:
        raw, _ = self.raw(*self.rows(found))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(found, labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7, batch: int = 64) -> Machine:
    """AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    dense = np.array([x[2] for x in found]) if found else np.zeros((0, len(STRUCTURE)))
    mean = dense.mean(axis=0) if len(dense) else np.zeros(len(STRUCTURE))
    scale = np.maximum(dense.std(axis=0), 1e-3) if len(dense) else np.ones(len(STRUCTURE))
    size = buckets + len(STRUCTURE)
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32), mean, scale, buckets)
    if len(set(labels.tolist())) < 2:
        return machine
    machine.factors = rng.normal(0, 0.05, (size, rank)).astype(np.float32)
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-3, np.float32), np.full((size, rank), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            slots, values, starts = machine.rows([found[i] for i in part])
            raw, sums = machine.raw(slots, values, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]).astype(np.float32)
            each = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(slots))))
            by_value = error[each] * values
            touched, where = np.unique(slots, return_inverse=True)
            linear = np.bincount(where, by_value, len(touched)).astype(np.float32) + decay * machine.linear[touched]
            grow = by_value[:, None] * (sums[each] - machine.factors[slots] * values[:, None])
            factors = np.stack([np.bincount(where, grow[:, f], len(touched)) for f in range(rank)], axis=1).astype(np.float32) + decay * machine.factors[touched]
            seen_linear[touched] += linear**2
            seen_factors[touched] += factors**2
            seen_bias += float(error.sum()) ** 2
            machine.linear[touched] -= rate * linear / np.sqrt(seen_linear[touched])
            machine.factors[touched] -= 0.5 * rate * factors / np.sqrt(seen_factors[touched])
            machine.bias -= rate * float(error.sum()) / np.sqrt(seen_bias)
    return machine


def _sampled(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [features.of(*x) for x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                cols = [part.column(0), part.column(1), pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32()))]
                cols += [pa.array([x[1] for x in found], pa.list_(pa.float32())), pa.array([x[2] for x in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "slots", "weights", "structure"])

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; n_chars is null where there is no such column."""
    known = "n_chars" in docs.columns
    rows = take(docs, "doc_id", "text", *["n_chars"] * known)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("n_chars").cast("double") if known else F.lit(None).cast("double")).alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, buckets: int = BUCKETS) -> Machine:
    """The machine from at most ``rows`` labelled documents."""
    marked = take(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = (
        marked.where(learnable(F.col("doc_id")) & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = _inputs(docs).select("doc_id", "text", "n_chars")
    # one row an id, however often it is repeated: the least of its texts
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("t")).select("doc_id", "label", "t.text", "t.n_chars")
    sample = joined.mapInArrow(_sampled(buckets), "doc_id long, label int, slots array<int>, weights array<float>, structure array<double>").toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    lists = [sample.column(c).combine_chunks() for c in ("slots", "weights", "structure")]
    row_of = lambda i: tuple(np.asarray(c[i].values) for c in lists)
    found = [(s.astype(np.int64), w, d.tolist()) for s, w, d in (row_of(int(i)) for i in order)]
    return train(found, sample.column("label").to_numpy()[order].clip(0, 1).astype(np.float32), buckets)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        features = Features(machine.buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                scores = machine.score([features.of(*x) for x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = _inputs(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "n_chars")
    scored = rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
