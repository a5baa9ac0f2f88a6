"""Language-model scores from a small causal self-attention model, beside a unigram base.

The model works on subword ids of a public byte-level vocabulary. An id has a class: the ``HEAD`` most
frequent ids of the training texts and the end id have their own; the others share one by kind (begins with a
space or not; letters, digits or neither), and inside it a probability by their counts. A class is predicted from the
last one (a table of counts, smoothed) and from causal self-attention over the context: embeddings, queries, keys
and values of ``WIDTH`` numbers, one bias per distance, a softmax over the classes. So the probabilities of all
continuations of a text add up to one.

Texts are scored in windows of ``2 * STRIDE`` places that overlap by half: the first half is context, and each
id of the second half is scored, so every id is scored once, with ``STRIDE`` to ``2 * STRIDE - 1`` ids before it.
Windows of many texts go through one masked product in numpy.

What is learned grows with the input: counts of words, ids and pairs of classes are those of all training texts,
summed by Spark; the attention is fitted on every window of all training texts, each once, in ``ROUNDS`` steps over
disjoint parts of them. In a round each task sends the gradient of its windows, in rows of ``_SENT`` numbers,
Spark sums them by row, and the driver, which holds parameters only, takes one Adam step. The model's size depends on constants alone.

The base (unigram) takes words and one end; a word's count comes from a broadcast table for words that make up at least one
in ``FREQUENT`` of all tokens, and from a join by word for the others, so no vocabulary is held whole anywhere.

Defined cases: null text counts as empty: one token, the end. Rows with a null doc_id are scored, not held out and not
learned from. Without training rows every count is zero and ids are nearly alike. Repeated rows are learned from as often as they
stand and get equal scores. Very long texts are scored whole, window by window. Ties of counts go to the smaller id or word. Empty tables give
no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import compress, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spilled, take

HEAD, GROUP, WIDTH, STRIDE, ROUNDS, STEP, NOISE, SEED = 1017, 32, 16, 16, 8, 0.1, 4000, 12
FREQUENT = 500_000
END = 50_256
_END = np.array([END], "<u2").tobytes()
_KINDS = 6
_AT_ONCE = 64  # windows in one product
_BLOCKS = 2048  # windows of which rows are sorted by class
_ROWS = 900  # rows of a group in one product: few enough for the quick way of small matrices
_FLUSH = 200_000  # words that a task counts before it sends them on
_KNOWN, _LONG = 300_000, 100  # words that a worker keeps with their ids; bytes of the longest of them
_SLICE = 1 << 20  # ids that are counted at once
_SENT = 1 << 10  # slopes in a row


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


# --- the model ---


@dataclass
class Classes:
    """Which class each id has, and the log probability of an id inside its class."""

    of: np.ndarray
    inside: np.ndarray
    size: int

    @staticmethod
    def of_counts(counts: np.ndarray, kinds: np.ndarray, head: int = HEAD) -> Classes:
        own = np.lexsort((np.arange(len(counts)), -counts))
        own = own[(own != END) & (counts[own] > 0)][:head]
        of = head + 1 + kinds
        of[own] = np.arange(len(own))
        of[END] = head
        size = head + 1 + _KINDS
        members, total = np.bincount(of, minlength=size), np.bincount(of, counts, size)
        return Classes(of.astype(np.int16), np.log((counts + 1) / (total + members)[of]), size)


def kinds_of(pieces: list[bytes]) -> np.ndarray:
    """0 to 5: twice as many as letters, digits and others, for those that begin with a space."""
    out = np.zeros(len(pieces), np.int64)
    for i, piece in enumerate(pieces):
        body = piece.lstrip(b" ")
        what = 0 if any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in body) else 1 if any(48 <= c <= 57 for c in body) else 2
        out[i] = 3 * (piece[:1] == b" ") + what
    return out


def pair_logs(pairs: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log probabilities of the next class after each class (the last row: at a text's start), mixed with those of the classes alone."""
    whole = pairs.sum(axis=0) + 1.0
    return np.log((pairs + weight * whole / whole.sum()) / (pairs.sum(axis=1, keepdims=True) + weight)).astype(np.float32)


def windows(classes: np.ndarray, stride: int = STRIDE, only: np.ndarray | None = None, start: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets): inputs of 2 * stride classes, the last one before each target included; -1 where there is none.

    ``classes`` is one text with its end. Place i of the inputs is the class before target i; before the first stands ``start``.
    """
    n = len(classes)
    count = -(-n // stride)
    padded = np.full((count + 1) * stride, -1, np.int16)
    padded[stride] = start
    padded[stride + 1 : stride + n] = classes[:-1]
    targets = np.full(count * stride, -1, np.int16)
    targets[:n] = classes
    halves = padded.reshape(-1, stride)
    inputs, targets = np.concatenate([halves[:-1], halves[1:]], axis=1), targets.reshape(-1, stride)
    return (inputs, targets) if only is None else (inputs[only], targets[only])


@dataclass
class Blocks:
    """Places of many texts, ``stride`` in a block: the windows without their first halves, as each is the block before.

    Place i of ``inputs`` is the class before target i; -1 where there is none. A block that ``first`` marks has no places
    before it: a text's first, or the context of a long text's next part, which has no targets.
    """

    inputs: np.ndarray
    targets: np.ndarray
    first: np.ndarray

    @staticmethod
    def of_windows(inputs: np.ndarray, targets: np.ndarray) -> tuple[Blocks, np.ndarray]:
        """The same windows as blocks, and which block has each window's targets."""
        s = targets.shape[1]
        before, own = inputs[:, :s], inputs[:, s:]
        first = before[:, 0] < 0
        alone = ~first  # its first half is not the window before
        alone[1:] &= (before[1:] != own[:-1]).any(axis=1)
        at = np.arange(len(inputs)) + np.cumsum(alone)
        size = len(inputs) + int(alone.sum())
        out = Blocks(np.full((size, s), -1, np.int16), np.full((size, s), -1, np.int16), np.ones(size, bool))
        out.inputs[at], out.targets[at], out.first[at] = own, targets, first
        out.inputs[at[alone] - 1] = before[alone]
        return out, at


def blocks(texts: Iterator[np.ndarray], stride: int, start: int, most: int | None = None) -> Iterator[tuple[Blocks, np.ndarray, np.ndarray]]:
    """(blocks, numbers of texts, where each begins) of classes of texts with their ends, about ``most`` blocks at once.

    Of a text, whatever its length, the windows come some at a time: it goes on with the places before.
    """
    most = most or _BLOCKS

    def empty() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
        return np.full(most * stride, -1, np.int16), np.full(most * stride, -1, np.int16), np.zeros(most, bool), [], []

    inputs, targets, first, owners, begins = empty()
    used = 0
    for i, classes in enumerate(texts):
        at = 0
        while at < len(classes):
            if used > most - 2:
                yield Blocks(inputs[: used * stride].reshape(-1, stride), targets[: used * stride].reshape(-1, stride), first[:used]), np.array(owners), np.array(begins)
                inputs, targets, first, owners, begins = empty()
                used = 0
            owners.append(i)
            begins.append(used)
            first[used] = True
            if at:
                inputs[used * stride : (used + 1) * stride] = classes[at - stride - 1 : at - 1] if at > stride else np.r_[start, classes[: stride - 1]]
                used += 1
            n = min(len(classes) - at, (most - used) * stride)
            place = used * stride
            inputs[place] = classes[at - 1] if at else start
            inputs[place + 1 : place + n] = classes[at : at + n - 1]
            targets[place : place + n] = classes[at : at + n]
            used += -(-n // stride)
            at += n
    if used:
        yield Blocks(inputs[: used * stride].reshape(-1, stride), targets[: used * stride].reshape(-1, stride), first[:used]), np.array(owners), np.array(begins)


@dataclass
class Attention:
    """One head of causal self-attention over classes, on top of the pair table.

    The softmax has two steps, groups of ``GROUP`` classes and classes of a group, each with the
    pair table's chances as its weights.
    """

    pairs: np.ndarray  #: log probabilities, (classes + 1, classes)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    _rooms: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    @staticmethod
    def start(pairs: np.ndarray, width: int = WIDTH, stride: int = STRIDE, seed: int = SEED) -> Attention:
        rng = np.random.default_rng(seed)
        n = pairs.shape[1]
        shapes = {"embed": (n + 1, width), "query": (width, width), "key": (width, width), "value": (width, width), "group": (width, -(-n // GROUP)), "out": (width, n)}
        scale = {"embed": 1.0, "out": 0.02, "group": 0.02}
        drawn = {k: (rng.standard_normal(s) * scale.get(k, width**-0.5)).astype(np.float32) for k, s in shapes.items()}
        return Attention(pairs, drawn | {"near": np.zeros(2 * stride, np.float32)})

    @property
    def stride(self) -> int:
        return len(self.weights["near"]) // 2

    @cached_property
    def _chances(self) -> np.ndarray:
        """Once a task, the pair table's probabilities: a table for each group, with a row for each class before, of groups and then of classes inside this group."""
        chances = np.exp(self.pairs)
        starts = np.arange(0, chances.shape[1], GROUP)
        groups = np.add.reduceat(chances, starts, axis=1)
        out = np.zeros((len(starts), len(chances), 2, max(GROUP, len(starts))), np.float32)
        out[:, :, 0, : len(starts)] = groups
        for g, start in enumerate(starts):
            own = chances[:, start : start + GROUP]
            np.divide(own, groups[:, g : g + 1], out=out[g, :, 1, : own.shape[1]])
        return out.reshape(len(starts), len(chances), -1)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, key and value of every class: one product each, then blocks only look them up."""
        w = self.weights
        return w["embed"] @ w["query"] * np.float32(w["embed"].shape[1] ** -0.5), w["embed"] @ w["key"], w["embed"] @ w["value"]

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that later runs use again, with whatever they left in it."""
        size = math.prod(shape)
        if len(self._rooms.get(name, ())) < size:
            self._rooms[name] = np.empty(size, np.float32)
        return self._rooms[name][:size].reshape(shape)

    def _far(self) -> np.ndarray:
        return self.stride + np.arange(self.stride)[:, None] - np.arange(2 * self.stride)

    def _small(self, query: np.ndarray, key: np.ndarray) -> bool:
        """No score can be so large that its exponential overflows, or so small that all of a row's vanish."""
        most = np.sqrt((query**2).sum(axis=1).max() * (key**2).sum(axis=1).max()) + np.abs(self.weights["near"]).max()
        return bool(most < 60)

    def logs(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probabilities of the windows' targets, zero where there is none."""
        own, at = Blocks.of_windows(inputs, targets)
        return self.run(own, None)[at]

    def gradient(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], float, int]:
        """(gradient of the sum of the windows' -log probabilities, that sum, targets)."""
        slopes = Slopes(self)
        logs = self.run(Blocks.of_windows(inputs, targets)[0], slopes)
        return slopes.of_weights(), -float(logs.sum()), int((targets >= 0).sum())

    def run(self, own: Blocks, slopes: Slopes | None) -> np.ndarray:
        """Log probabilities of the targets, zero where there is none; ``slopes``, if given, gets those of the sum of -log probabilities.

        Attention goes over few blocks at once, which stay in a core's cache; the softmax and the sums by class need more rows.
        """
        s, n, width = self.stride, len(own.inputs), self.weights["out"].shape[0]
        tables, far = self._tables(), self._far()
        places = np.concatenate([own.inputs[:1], own.inputs]).astype(np.intp)  # before the first stands what none sees
        places[places < 0] = len(tables[0]) - 1
        near = np.where(far >= 0, self.weights["near"][np.maximum(far, 0)], np.float32(-1e9))
        small, ones = self._small(*tables[:2]), np.ones(2 * s, np.float32)
        kept = self._room("kept", n if slopes else min(n, _AT_ONCE), s, 2 * s)
        mixed = self._room("mixed", n, s, width)
        for at in range(0, n, _AT_ONCE):
            part = slice(at, min(n, at + _AT_ONCE))
            query, key, value = self._look_up(places, part, tables)
            p = np.matmul(query, key.transpose(0, 2, 1), out=kept[part] if slopes else kept[: len(query)])
            p += near
            p[own.first[part], :, :s] = np.float32(-1e9)  # places behind a text's end are never seen
            if not small:
                p -= p.max(axis=2, keepdims=True)
            np.exp(p, out=p)
            total = (1 / (p.reshape(-1, 2 * s) @ ones)).reshape(-1, s, 1)
            if slopes:
                p *= total
            np.matmul(p, value, out=mixed[part])
            if not slopes:
                mixed[part] *= total
        logs, d_mixed = self._choose(own.targets.ravel(), places[1:].ravel(), mixed.reshape(-1, width), slopes)
        if slopes:
            d_mixed = d_mixed.reshape(n, s, width)
            d_query, d_key, d_value = (self._room(name, n + 1, s, width) for name in ("d_query", "d_key", "d_value"))  # the last: what no block sees
            d_near = np.zeros((s, 2 * s))
            for at in range(0, n, _AT_ONCE):
                part = slice(at, min(n, at + _AT_ONCE))
                query, key, value = self._look_up(places, part, tables)
                p, d_m = kept[part], d_mixed[part]
                d = d_m @ value.transpose(0, 2, 1)
                d -= ((d_m * mixed[part]).reshape(-1, width) @ np.ones(width, np.float32)).reshape(-1, s, 1)
                d *= p
                d_near += d.sum(axis=0)
                np.matmul(d, key, out=d_query[part])
                for whole, x in ((d_key, d.transpose(0, 2, 1) @ query), (d_value, p.transpose(0, 2, 1) @ d_m)):
                    whole[part] = x[:, s:]
                    whole[at - 1] += x[0, :s]
                    whole[at : part.stop - 1] += x[1:, :s]
            slopes.near += np.bincount(np.maximum(far, 0).ravel(), np.where(far >= 0, d_near, 0).ravel(), 2 * s)
            self._add_by_class(slopes, own.inputs.ravel(), self._to_embeddings(slopes, places[1:], d_query, d_key, d_value))
        return logs.reshape(own.targets.shape)

    def _look_up(self, places: np.ndarray, part: slice, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries of the blocks, and keys and values of each with the block before."""
        s, n, width = places.shape[1], part.stop - part.start, tables[0].shape[1]
        query = tables[0].take(places[part.start + 1 : part.stop + 1], axis=0, mode="clip", out=self._room("query", n, s, width))
        both = []
        for name, table in zip(("key", "value"), tables[1:], strict=True):
            x = table.take(places[part.start : part.stop + 1], axis=0, mode="clip", out=self._room(name, n + 1, s, width))
            both.append(np.lib.stride_tricks.as_strided(x, (n, 2 * s, width), x.strides))
        return query, both[0], both[1]

    def _choose(self, targets: np.ndarray, before: np.ndarray, mixed: np.ndarray, slopes: Slopes | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Both steps of the softmax side by side, for the targets of one group after the other: log probabilities, and slopes of what attention gave."""
        w, chances = self.weights, self._chances
        groups, half = len(chances), chances.shape[2] // 2
        weights = np.zeros((groups, len(w["out"]), 2 * half), np.float32)
        weights[:, :, :groups] = w["group"]
        for g in range(groups):
            own = w["out"][:, g * GROUP : (g + 1) * GROUP]
            weights[g, :, half : half + own.shape[1]] = own
        back = np.ascontiguousarray(weights.transpose(0, 2, 1))
        ones, numbers = np.ones(half, np.float32), np.arange(_ROWS)
        order = np.argsort(targets, kind="stable")
        wanted, last = targets.take(order), before.take(order)
        borders = np.searchsorted(wanted, np.arange(groups + 1) * GROUP)
        rows = mixed.take(order, axis=0, out=self._room("rows", *mixed.shape), mode="clip")
        found = np.ones(len(order))
        d_rows = self._room("d_rows", *mixed.shape) if slopes else None
        if slopes:
            d_rows[: borders[0]] = 0
        for g in np.flatnonzero(np.diff(borders)).tolist():
            for at in range(borders[g], borders[g + 1], _ROWS):
                part = slice(at, min(borders[g + 1], at + _ROWS))
                x = rows[part]
                z = np.matmul(x, weights[g], out=self._room("z", len(x), 2 * half))
                np.exp(z, out=z)
                z *= chances[g].take(last[part], axis=0, mode="clip", out=self._room("chances", *z.shape))
                total = z.reshape(-1, half) @ ones
                want = numbers[: len(x)], wanted[part] + (half - g * GROUP)
                found[part] = z[:, g] / total[::2] * (z[want] / total[1::2]).astype(np.float64)
                if slopes:
                    halves = z.reshape(-1, half)
                    halves *= (1 / total)[:, None]
                    z[:, g] -= 1
                    z[want] -= 1
                    slopes.chosen[g] += x.T @ z
                    np.matmul(z, back[g], out=d_rows[part])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        logs = np.log(found).take(place)
        return logs, d_rows.take(place, axis=0, out=rows, mode="clip") if slopes else None

    def _to_embeddings(self, slopes: Slopes, places: np.ndarray, *parts: np.ndarray) -> np.ndarray:
        """Slopes of each place's embedding, from those of its query, key and value, whose weights' slopes are summed on the way."""
        w, width = self.weights, parts[0].shape[2]
        out = self._room("d_embed", places.size, width)
        scales = np.float32(width**-0.5), np.float32(1), np.float32(1)
        back = [np.ascontiguousarray(w[name].T * scale) for name, scale in zip(("query", "key", "value"), scales, strict=True)]
        rows, classes = [x.reshape(-1, width) for x in parts], places.ravel()
        for at in range(0, len(out), _ROWS):
            part = slice(at, min(len(out), at + _ROWS))
            embedded = w["embed"].take(classes[part], axis=0, mode="clip", out=self._room("embedded", part.stop - at, width)).T
            d = np.matmul(rows[0][part], back[0], out=out[part])
            d += rows[1][part] @ back[1]
            d += rows[2][part] @ back[2]
            for x, to in zip(rows, slopes.seen, strict=True):
                to += embedded @ x[part]
        return out

    def _add_by_class(self, slopes: Slopes, classes: np.ndarray, rows: np.ndarray) -> None:
        """Sums of rows by class: a product of each 32 classes' rows, sorted, with which class each is of."""
        order = np.argsort(classes, kind="stable")
        classes = classes.take(order)
        borders = np.searchsorted(classes, np.arange(0, len(self.pairs) + 32, 32))
        one = np.eye(32, dtype=np.float32)
        for g in np.flatnonzero(np.diff(borders)).tolist():
            to = slopes.embed[32 * g : 32 * g + 32]
            for at in range(borders[g], borders[g + 1], _ROWS):
                own = slice(at, min(borders[g + 1], at + _ROWS))
                here = rows.take(order[own], axis=0, mode="clip", out=self._room("here", own.stop - at, rows.shape[1]))
                to += (one.take(classes[own] - 32 * g, axis=0).T @ here)[: len(to)]


class Slopes:
    """Sums of slopes, by what ``Attention.run`` looks up; from them, those of the weights."""

    def __init__(self, model: Attention):
        self.weights = model.weights
        width, n = model.weights["out"].shape
        groups = model.weights["group"].shape[1]
        self.embed, self.seen = np.zeros((n + 1, width)), np.zeros((3, width, width))
        self.near, self.chosen = np.zeros(2 * model.stride), np.zeros((groups, width, 2 * max(GROUP, groups)))

    def of_weights(self) -> dict[str, np.ndarray]:
        w = self.weights
        width, n = w["out"].shape
        of_groups, of_classes = np.split(self.chosen, 2, axis=2)
        out = {"near": self.near, "group": of_groups.sum(axis=0)[:, : len(self.chosen)], "embed": self.embed}
        out["out"] = of_classes[:, :, :GROUP].transpose(1, 0, 2).reshape(width, -1)[:, :n]
        out |= {"query": self.seen[0] * width**-0.5, "key": self.seen[1], "value": self.seen[2]}
        return {k: out[k] for k in w}


@dataclass
class Adam:
    step: float = STEP
    noise: float = NOISE
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)
    t: int = 0

    def __call__(self, weights: dict[str, np.ndarray], grad: dict[str, np.ndarray], targets: float) -> dict[str, np.ndarray]:
        """The next weights, by the mean gradient of so many targets: the fewer they are, the less of it is signal and the shorter the step."""
        self.t += 1
        step, out = self.step * (targets / (targets + self.noise)) ** 0.5, {}
        for k, w in weights.items():
            a = self.first[k] = 0.8 * self.first.get(k, 0.0) + 0.2 * grad[k]
            b = self.second[k] = 0.95 * self.second.get(k, 0.0) + 0.05 * grad[k] ** 2
            out[k] = (w - step * (a / (1 - 0.8**self.t)) / (np.sqrt(b / (1 - 0.95**self.t)) + 1e-9)).astype(np.float32)
        return out


# --- counts and scores in Spark ---


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between white space; the methods of bytes know ASCII letters and the six ASCII spaces only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of runs of rows, sent on whenever there are many words; a null word is the end."""
    counts: Counter = Counter()

    def sent() -> pa.RecordBatch:
        names, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
            counts[None] += 1
            if len(counts) > _FLUSH:
                yield sent()
    yield sent()


class Subwords:
    """Ids of lower-cased texts and the bytes of each id, by the public byte-level vocabulary's rank form."""

    def __init__(self, ranks_path: str | None):
        import base64

        import tiktoken

        from .packing import vocabulary

        import public_tokenizers

        with open(ranks_path or vocabulary()[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (END + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, lowered: str) -> np.ndarray:
        """The ids and the end. A stretch of thousands of spaces is cut, as the library's patterns recur once for each."""
        return np.frombuffer(self.of_text(lowered) + _END, "<u2").astype(np.uint16)

    def of_text(self, lowered: str) -> bytes:
        """The ids alone, as 16-bit numbers."""
        from .packing import _LONG_SPACE

        parts = [lowered[i : i + 1000] for i in range(0, len(lowered), 1000)] if _LONG_SPACE.search(lowered) else [lowered]
        return b"".join(np.array(self.encoding.encode_ordinary(part), "<u2").tobytes() for part in parts)


class Lexicon(dict):
    """Numbers of words as texts have them, with their ids, which a worker looks for once.

    A key is a word behind a space, which it leaves out, behind a line feed, or, at a text's start, behind a return in place of nothing. The
    vocabulary's pattern never joins such a word with what stands around it. A text with other space, or a long word, is told by ``ids``
    being None, and goes to the library whole.
    """

    def __init__(self, subwords: Subwords):
        self.subwords = subwords
        self.sizes = np.array([len(x) for x in subwords.pieces])
        self.words: list[bytes] = []
        self.ids: list[bytes | None] = []

    @staticmethod
    def keys_of(low: bytes) -> list[bytes]:
        first, *rest = low.replace(b"\n", b" \n").split(b" ")
        return [b"\r" + first, *rest]

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self.words)
        self.words.append(key)  # until learn() was called
        return number

    def learn(self) -> None:
        """Finds the ids of what was looked up for the first time, in one run of the library."""
        start = len(self.ids)
        keys = self.words[start:]
        self.words[start:] = [key[1:] if key[:1] in (b"\n", b"\r") else key for key in keys]
        self.ids += [None] * len(keys)
        inner = [i for i, key in enumerate(keys, start) if key[:1] != b"\r"]
        for i in [i for i, key in enumerate(keys, start) if key[:1] == b"\r"]:
            if self._words_alone([b" " + self.words[i]]):
                self.ids[i] = self._found([self.words[i]])[0]
        together = [key if key[:1] == b"\n" else b" " + key for key in keys if key[:1] != b"\r"]
        if not self._words_alone(together):
            good = [self._words_alone([x]) for x in together]
            inner, together = [*compress(inner, good)], [*compress(together, good)]
        for i, ids in zip(inner, self._found(together), strict=True):
            self.ids[i] = ids

    def _words_alone(self, spaced: list[bytes]) -> bool:
        """Each is a space and a word, without other space by whatever standard, and not long."""
        text = b"".join(spaced).decode("utf-8", "surrogatepass")
        words = text.split()
        return len(words) == len(spaced) and sum(map(len, words)) + len(words) == len(text) and max(map(len, spaced), default=0) <= _LONG

    def _found(self, spaced: list[bytes]) -> list[bytes]:
        ids = np.array(self.subwords.encoding.encode_ordinary(b"".join(spaced).decode("utf-8", "surrogatepass")), "<u2")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x) for x in spaced]), side="right") * 2
        own, ends = ids.tobytes(), ends.tolist()
        return [own[at:end] for at, end in zip([0, *ends], ends)]

    def forget(self, start: int) -> None:
        """Of what came from number ``start`` on, keeps no more than fits ``_KNOWN``, and only words; other numbers stay."""
        for key in [*islice(reversed(self), len(self.ids) - start)]:
            number = self[key]
            if number >= _KNOWN or self.ids[number] is None:
                del self[key]
        del self.words[_KNOWN:], self.ids[_KNOWN:]
        for number in range(start, len(self.ids)):
            if self.ids[number] is None:
                self.words[number] = b""


@lru_cache(maxsize=1)
def _lexicon(ranks_path: str | None) -> Lexicon:
    """Once a worker."""
    return Lexicon(Subwords(ranks_path))


def _encode(shared, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, frequent = _lexicon(ranks_path), shared.value
        end = frequent.get(None)
        known_end, logs_end = (0, 0.0) if end is None else (1, end)
        logs_of = np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, known, logs, ids, sizes = [], [], [], [], [0]
                names: list[bytes] = []
                times: list[int] = []
                texts = [(text or "").encode("utf-8", "surrogatepass").lower() for text in part.column(4).to_pylist()]
                start = len(lexicon.ids)
                numbers = [[*map(lexicon.__getitem__, lexicon.keys_of(low))] for low in texts]
                lexicon.learn()
                new = lexicon.words[len(logs_of) :]
                logs_of = np.concatenate([logs_of, np.fromiter(map(frequent.get, new, repeat(math.nan)), np.float64, len(new))])
                for low, own in zip(texts, numbers, strict=True):
                    try:
                        ids.append(b"".join(map(lexicon.ids.__getitem__, own)) + _END)
                        found = logs_of.take(own)
                        other = np.isnan(found)
                        rare = Counter(map(lexicon.words.__getitem__, compress(own, other.tolist())))
                    except TypeError:  # not only words between single spaces
                        ids.append(lexicon.subwords.of_text(low.decode("utf-8", "surrogatepass")) + _END)
                        words = low.split()
                        found = np.fromiter(map(frequent.get, words, repeat(math.nan)), np.float64, len(words))
                        other = np.isnan(found)
                        rare = Counter(compress(words, other.tolist()))
                    names += rare
                    times += rare.values()
                    sizes.append(len(names))
                    n.append(len(found) + 1)
                    known.append(len(found) - int(other.sum()) + known_end)
                    logs.append(float(np.nansum(found)) + logs_end)
                lexicon.forget(start)
                logs_of = logs_of[:_KNOWN]
                words_of_row = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
                columns = [*(part.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64())]
                columns += [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), words_of_row), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "learn", "n_tokens", "n_known", "logs", "rare", "ids"])

    return run


def lowered(text: str | None) -> str:
    """A-Z in lower case, other characters as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of texts, the id before each or -1 at a text's start), of many texts or a part of a long one at once."""
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        if not len(column):
            continue
        borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
        ids, begins = np.frombuffer(column.buffers()[2], "<u2"), borders[:-1]
        for at in range(borders[0], borders[-1], _SLICE):
            to = min(borders[-1], at + _SLICE)
            before = np.empty(to - at, np.int32)
            before[0], before[1:] = ids[at - 1] if at else -1, ids[at : to - 1]
            before[begins[(begins >= at) & (begins < to)] - at] = -1
            yield ids[at:to], before


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(END + 1, np.int64)
    for ids, _ in _slices(batches):
        counts += np.bincount(ids, minlength=END + 1)
    yield _nonzero(counts)


def _nonzero(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])


def _pair_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        counts = np.zeros((classes.size + 1) * classes.size, np.int64)
        for ids, before in _slices(batches):
            last = np.where(before < 0, classes.size, classes.of[before].astype(np.int64))
            np.add.at(counts, last * classes.size + classes.of[ids], 1)
        yield _nonzero(counts)

    return run


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """Counts by place, of which there are at most size, a constant of the model."""
    out = np.zeros(size, np.int64)
    whole = df.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[whole.column("at").to_numpy()] = whole.column("n").to_numpy()
    return out


def _classes_of(classes: Classes, column: pa.Array) -> Iterator[np.ndarray]:
    return (classes.of[np.frombuffer(ids.as_buffer(), "<u2")] for ids in column)


def _gradients(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model = shared.value
        slopes, targets = Slopes(model), 0
        for own, _, _ in blocks((x for batch in batches for x in _classes_of(classes, batch.column(0))), model.stride, classes.size):
            model.run(own, slopes)
            targets += int((own.targets >= 0).sum())
        flat = np.concatenate([[float(targets)], *(v.ravel() for v in slopes.of_weights().values())])
        starts = range(0, len(flat), _SENT)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([flat[i : i + _SENT].astype("<f8").tobytes() for i in starts], pa.binary())], names=["at", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x.as_buffer(), "<f8") for x in rows.column("sums"))
    return pa.table({"at": rows.column("at").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model = shared.value
        for batch in batches:
            scores = np.array([classes.inside[np.frombuffer(ids.as_buffer(), "<u2")].sum() for ids in batch.column(6)], np.float64)
            for own, texts, begins in blocks(_classes_of(classes, batch.column(6)), model.stride, classes.size):
                np.add.at(scores, texts, np.add.reduceat(model.run(own, None).sum(axis=1), begins))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(scores / math.log(10))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    return run


def fit(texts: DataFrame, rounds: int = ROUNDS, ranks_path: str | None = None, head: int = HEAD) -> tuple[Classes, Attention]:
    """The model from texts (row, learn, ids): counts of all rows that may be learned from, then rounds over disjoint parts of them."""
    context = texts.sparkSession.sparkContext
    usable = texts.where("learn")
    counts = _summed(usable.select("ids").mapInArrow(_id_counts, "at long, n long"), END + 1)
    classes = Classes.of_counts(counts, kinds_of(Subwords(ranks_path).pieces), head)
    pairs = _summed(usable.select("ids").mapInArrow(_pair_counts(context.broadcast(classes)), "at long, n long"), (classes.size + 1) * classes.size)
    model = Attention.start(pair_logs(pairs.reshape(classes.size + 1, classes.size).astype(np.float64)))
    adam = Adam()
    size = 1 + sum(v.size for v in model.weights.values())
    for r in range(rounds):
        part = usable.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("ids")
        sent = part.mapInArrow(_gradients(context.broadcast((classes, model))), "at long, sums binary")
        sums = sent.groupBy("at").applyInArrow(_added, "at long, sums binary").toArrow()  # as many numbers as the model has
        flat = np.zeros(size)
        for start, values in zip(sums.column("at").to_pylist(), sums.column("sums").to_pylist(), strict=True):
            flat[start : start + _SENT] = np.frombuffer(values, "<f8")
        if not flat[0]:
            continue
        grad, at = {}, 1
        for k, v in model.weights.items():
            grad[k] = flat[at : at + v.size].reshape(v.shape) / flat[0]
            at += v.size
        model = Attention(model.pairs, adam(model.weights, grad, flat[0]))
    return classes, model


def score(docs: DataFrame, ranks_path: str | None = None, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    ``ranks_path``: the vocabulary's rank form on driver and executors; None looks it up there.
    """
    context = docs.sparkSession.sparkContext
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.where(learnable(F.col("doc_id"))).select("text").mapInArrow(_count_words, "word binary, n long")
    with spilled(counted.groupBy("word").agg(F.sum("n").alias("n")), "words") as vocabulary:
        whole = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        total, distinct = whole["n"], whole["v"]
        under = math.log10(total + distinct + 1)
        # at most ``frequent`` words can each be so large a share of all tokens, so the table's size is bounded without a sort
        best = vocabulary.where(F.col("n") * frequent >= total).toArrow()
        table = {w: math.log10(n + 1) - under for w, n in zip(best.column("word").to_pylist(), best.column("n").to_pylist(), strict=True)}
        if total:  # the end is known, however rare it is among the words
            table[None] = math.log10(vocabulary.where("word is null").first()["n"] + 1) - under
        given = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), learnable(F.col("doc_id")).alias("learn"), "text")
        schema = "row long, doc_id long, held_out boolean, learn boolean, n_tokens long, n_known long, logs double, rare array<struct<word: binary, times: long>>, ids binary"
        with spilled(given.mapInArrow(_encode(context.broadcast(table), ranks_path), schema), "texts") as texts:
            shared = context.broadcast(fit(texts, rounds, ranks_path=ranks_path))
            scored = texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "ids").mapInArrow(
                _scores(shared), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
            )
            rare = texts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
            # only words that training texts hold go on; a word that many texts hold is split by the skew join
            rare = rare.join(vocabulary.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 1) - F.lit(under))).alias("more_logs"))
            out = scored.join(rare, "row", "left")
            known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
            base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - (F.col("n_tokens") - known) * F.lit(under)
            return cut(out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))
