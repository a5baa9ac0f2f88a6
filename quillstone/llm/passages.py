"""Substring dedup with compact windows: near-duplicate passages across documents.

A text is its sequence of five-word shingles (A-Z lower-cased, words split at white
space), each hashed. For each of ``HASHES`` functions the Cartesian tree over the hashed
sequence groups all subsequences of at least ``SHORTEST`` shingles by the position of
their least hash: a compact window (l, c, r) stands for every subsequence from between l
and c to between c and r, so n shingles give about 2 n / SHORTEST windows. Two
passages with similarity s share the least hash of a function with probability s.

Windows meet where the least hash and the shingle ``CONTEXT`` places beside it agree
(the right side for even functions, the left for odd), so that short phrases that many
texts share don't meet. Within such a group every window is paired with that of the
least document id, where both, aligned at c, hold a stretch that is long enough: a passage
in a thousand documents gives 999 pairs. A pair is verified from ``ENOUGH`` votes on: one for
each function that agrees, one for each run of 10 shingles that ends or begins at c.
Windows that are unlike the least document's on a side (runs of ``SIDES`` shingles) meet the
least of those that have the same run there, so a document that shares a line or a
template only doesn't stand between two that share more. Where the verification still leaves a window
of a group with one long run in no passage, the group's documents meet by all runs of
``SHORTEST`` shingles around c: exact copies that share a key find each other
whatever else stands under it.

A pair is verified on whole texts: runs of shared shingles are chained over gaps on either
side, and the longest parts of a chain with Jaccard similarity of the two stretches at
least ``SIMILAR`` are taken, edits inside.

Defined cases: null and empty texts have no words. Texts of fewer than 50 words have no passage.
Very long texts are hashed block by block and windowed whole; a text takes memory in
proportion to its own words. Of equal least hashes (a text that repeats itself) the first
is the window's. Repeats inside one document are left alone, and rows with the same id,
repeated rows among them, are one document. Rows with a null id neither give nor lose passages. Of a passage
that stands in several documents, that of the least id stays. Empty tables give no rows. Extra
columns, whatever their names, are kept by ``without_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, cut, spilled, take

WORDS = 5
SHORTEST = 46  #: shingles: 50 words
HASHES = 5
CONTEXT = 2
SIDES = (10, 23)  #: shingles of the runs beside c; the longest fits a half of any run of SHORTEST that holds c
ENOUGH = 2
SIMILAR = 0.8
GAP = 2 * WORDS
LOOK_BACK = 500  #: runs overlapping in the earlier text that a chain may leave out on end
_PLACE_BITS, _SIDE_BITS = 24, 13
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * _A)


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: a number for each byte, A-Z like a-z
_CODES = mixed((np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)) + 1).astype(np.uint64) * _B)
_BASE = int(_C)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class Shingler:
    """Texts to shingle hashes: all words of a block of text are hashed at once, by differences of running polynomials."""

    def __init__(self, block: int = 1 << 20):
        self.block = block
        self._sized(1 << 16)

    def _sized(self, n: int) -> None:
        self.powers, self.inverses = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (np.uint64(_BASE), _INVERSE))

    def _words(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self._sized(len(data))
        space = _SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edges[::2], edges[1::2]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * self.powers[: len(data)])])
        return mixed((running[ends] - running[starts]) * self.inverses[starts])

    def words(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word of UTF-8 bytes."""
        if len(data) <= self.block:
            return self._words(data)
        out, at = [], 0
        while at < len(data):
            size = self.block
            while at + size < len(data) and not _SPACE[data[at : at + size]].any():
                size *= 2
            to = min(at + size, len(data))
            if to < len(data):  # a block ends where a word does
                to = at + int(np.flatnonzero(_SPACE[data[at:to]])[-1]) + 1
            out.append(self._words(data[at:to]))
            at = to
        return np.concatenate(out)

    @staticmethod
    def _of_words(each: np.ndarray) -> np.ndarray:
        n = len(each) - WORDS + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = each[:n].copy()
        for i in range(1, WORDS):
            out *= _A
            out += each[i : i + n]
        return mixed(out)

    def __call__(self, text: str | None) -> np.ndarray:
        return self._of_words(self.words(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)))

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """Shingle hashes of each text of a column."""
        whole = "\n".join(x or "" for x in texts.to_pylist()).encode("utf-8", "surrogatepass")
        if len(whole) > self.block:
            return [self(x) for x in texts.to_pylist()]
        data = np.frombuffer(whole, np.uint8)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(~_SPACE[data] & np.concatenate([[True], _SPACE[data[:-1]]]))
        ends = np.searchsorted(starts, np.cumsum(sizes + 1) - 1)
        return [self._of_words(x) for x in np.split(self._words(data), ends[:-1])]


def _minima(hashed: np.ndarray, longest: int) -> list[np.ndarray]:
    """Least values of all stretches of 1, 2, 4, ... places, up to ``longest``; a place's own low bits make every value differ from its neighbours', the left one of equals being less."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    out = [(hashed & ~low) | (np.arange(len(hashed), dtype=np.uint64) & low)]
    width = 1
    while 2 * width <= min(longest, len(hashed)):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
        width *= 2
    return out


def _tops(minima: list[np.ndarray], first: np.ndarray, last: np.ndarray, shortest: int, reach: int, extents: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, before, beyond) of the compact windows: the nodes of the Cartesian trees over at least ``shortest`` places.

    ``first`` and ``last`` bound the text that each place belongs to. A node is the least of
    some stretch of exactly ``shortest`` places; how far it stays the least is found by
    halving steps, up to ``reach`` places on either side (0 where ``extents`` aren't asked for).
    """
    values, n = minima[0], len(minima[0])
    none = np.empty(0, np.int64)
    if n < shortest:
        return none, none, none
    k = shortest.bit_length() - 1
    count = n - shortest + 1
    least = np.minimum(minima[k][:count], minima[k][shortest - (1 << k) : shortest - (1 << k) + count])
    start = np.flatnonzero(first[:count] == first[shortest - 1 :])
    if not len(start):
        return none, none, none
    low = np.int64((1 << _PLACE_BITS) - 1)
    c = start + ((least[start].view(np.int64) - start) & low)
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]  # the least place never goes back as the stretch goes on
    own, before, beyond = values[c], np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(len(minima) - 1, -1, -1) if extents else ():
        step, table = 1 << k, minima[k]
        to = c - before - step
        before += step * ((to >= first[c]) & (before + step <= reach) & (table[np.maximum(to, 0)] > own))
        to = c + beyond + 1
        fits = (to + step - 1 <= last[c]) & (beyond + step <= reach)
        beyond += step * (fits & (table[np.minimum(to, len(table) - 1)] > own))
    return c, before, beyond


def compact_windows(hashed: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(l, c, r) of all compact windows of at least ``shortest`` places, of equal minima the first."""
    n = len(hashed)
    order = np.unique(hashed, return_inverse=True)[1].astype(np.uint64) << np.uint64(_PLACE_BITS)
    c, before, beyond = _tops(_minima(order, 2 * n), np.zeros(n, np.int64), np.full(n, n - 1), shortest, n)
    return list(zip((c - before).tolist(), c.tolist(), (c + beyond).tolist(), strict=True))


def _run_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n shingles from each place on."""
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens, dtype=np.uint64)])
    return mixed(total[n:] - total[:-n])


def _sides(tokens: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For each of SIDES the short hashes of the run that ends at c and of the one that begins there; 0 where the text has none."""
    out = []
    for n in SIDES:
        runs = _run_hashes(tokens, n) >> np.uint64(64 - _SIDE_BITS)
        for start in (c - n + 1, c):
            there = (start >= first[c]) & (start + n - 1 <= last[c])
            out.append(np.where(there, np.maximum(runs[np.clip(start, 0, max(0, len(runs) - 1))], 1), 0).astype(np.uint64) if len(runs) else np.zeros(len(c), np.uint64))
    return out


def _slices(batch: pa.RecordBatch, text_at: int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a few hundred rows and a bounded size of text; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at : at + 200])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, n)
        at += n


def _windows(hashes: int, shortest: int, context: int, whole: bool):
    """Keys of all compact windows; with their place, extent and sides where the ``whole`` is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        names = ["doc_id", "key", "place", "packed"] if whole else ["key"]
        for part in (x for batch in batches for x in _slices(batch, 1)):
            all_tokens = shingles.column(part.column(1))
            sizes = np.array([len(t) if len(t) >= shortest else 0 for t in all_tokens], np.int64)
            tokens = np.concatenate([np.empty(0, np.uint64), *(t for t, n in zip(all_tokens, sizes, strict=True) if n)])
            if not len(tokens):
                continue
            ends = np.cumsum(sizes)
            first, last = np.repeat(ends - sizes, sizes), np.repeat(ends - 1, sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            found = []
            for f in range(hashes):
                c, before, beyond = _tops(_minima(mixed(tokens ^ SEEDS[f]), shortest), first, last, shortest, shortest, whole)
                beside = c + context if f % 2 == 0 else c - context
                inside = (beside >= first[c]) & (beside <= last[c])
                c, beside, before, beyond = c[inside], beside[inside], before[inside], beyond[inside]
                found.append((c, mixed(tokens[c] * _A + tokens[beside] + SEEDS[f]), before, beyond))
            c, key, before, beyond = map(np.concatenate, zip(*found, strict=True))
            packed = before.astype(np.uint64) << np.uint64(6) | beyond.astype(np.uint64)
            if whole:
                for side in _sides(tokens, c, first, last):
                    packed = packed << np.uint64(_SIDE_BITS) | side
            # a document that says the same thing again has the same window again: once is enough
            same = mixed((key + (packed * _B if whole else 0)) * _A + row[c].astype(np.uint64))
            _, once = np.unique(same, return_index=True)
            arrays = [pa.array(key[once].view(np.int64))]
            if whole:
                at = c[once]
                ids = part.column(0).to_numpy(zero_copy_only=False)[row[at]]
                arrays = [pa.array(ids, pa.int64()), *arrays, pa.array((at - first[at]).astype(np.int32)), pa.array(packed[once].view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return take(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _met(texts: DataFrame, keep, hashes: int, shortest: int, context: int) -> DataFrame:
    """(doc_id, key, place, packed): windows whose key stands more than once.

    Most keys stand in one document only. Counting the keys alone moves the least; making
    the windows a second time costs less than keeping them all.
    """
    keys = texts.mapInArrow(_windows(hashes, shortest, context, False), "key long")
    with spilled(keys.groupBy("key").count().where("count > 1").select("key"), "shared") as shared:
        windows = texts.mapInArrow(_windows(hashes, shortest, context, True), "doc_id long, key long, place int, packed long")
        return keep(windows.join(shared, "key", "left_semi").select("doc_id", "key", "place", "packed"), "met")


def _bits(packed: str, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(packed, shift).bitwiseAND(F.lit((1 << n) - 1))


def _side(packed: str, i: int) -> Column:
    return _bits(packed, _SIDE_BITS * (2 * len(SIDES) - 1 - i), _SIDE_BITS)


def _beside_first(met: DataFrame, keep) -> DataFrame:
    """Windows with those of the least document under their key; of keys of one document only, none."""
    firsts = met.groupBy("key").agg(F.min(F.struct("doc_id", "packed")).alias("first"), F.max("doc_id").alias("last")).where("last > first.doc_id")
    firsts = keep(firsts.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.packed").alias("first_packed")), "firsts")
    return met.join(firsts, "key").where(F.col("doc_id") != F.col("first_id"))


def _groups(texts: DataFrame, keep, hashes: int, shortest: int, context: int) -> DataFrame:
    """The table of windows beside their group's first, which all later steps read; what it is made from goes."""
    with contextlib.ExitStack() as release:
        passing = lambda df, like: release.enter_context(spilled(df, like))
        return keep(_beside_first(_met(texts, passing, hashes, shortest, context), passing), "beside")


def _pairs(beside: DataFrame, keep, shortest: int, similar: float, enough: int) -> DataFrame:
    """(doc_id, first_id): documents to verify, from agreeing windows that overlap when aligned at c.

    Each function that agrees is a vote, and so is each of the shorter runs beside c.
    Windows that are unlike the least document's on a side meet again there: with
    the least of those that have the same run on this side.
    """
    extent = 2 * len(SIDES) * _SIDE_BITS
    low = [[_bits(p, extent + at, 6) for p in ("packed", "first_packed")] for at in (6, 0)]
    overlap = sum((F.least(*x) for x in low), F.lit(1)) >= round(similar * shortest)
    same = [_side("packed", i) == _side("first_packed", i) for i in range(2 * len(SIDES))]
    votes = F.lit(1) + sum((F.when(same[i] & (_side("packed", i) != 0), 1).otherwise(0) for i in range(2)), F.lit(0))
    near = beside.where(overlap).groupBy("doc_id", "first_id").agg(F.sum(votes).alias("votes")).where(F.col("votes") >= enough).select("doc_id", "first_id")
    sides = [F.when((_side("packed", i) != 0) & ~(same[i] & overlap), F.xxhash64("key", F.lit(i), _side("packed", i))) for i in range(2 * len(SIDES))]
    again = keep(beside.select("doc_id", F.explode(F.array_compact(F.array(*sides))).alias("side")), "sides")
    least = keep(again.groupBy("side").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last")).where("last > first_id").select("side", "first_id"), "least")
    further = again.join(least, "side").where("doc_id <> first_id").select("doc_id", "first_id")
    return near.union(further).distinct()


def candidates(docs: DataFrame, hashes: int = HASHES, shortest: int = SHORTEST, context: int = CONTEXT, enough: int = ENOUGH, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, first_id): pairs of documents to verify at first, first_id < doc_id."""
    with contextlib.ExitStack() as tables:
        keep = lambda df, like: tables.enter_context(spilled(df, like))
        return cut(_pairs(_groups(_texts(docs), keep, hashes, shortest, context), keep, shortest, similar, enough))


def _grams(shortest: int):
    """The hashes of all runs of ``shortest`` shingles that hold one of the stated places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for part in (x for batch in batches for x in _slices(batch, 1)):
            ids, grams = [], []
            for doc_id, tokens, places in zip(part.column(0).to_pylist(), shingles.column(part.column(1)), part.column(2).to_pylist(), strict=True):
                hashed = _run_hashes(tokens, shortest).view(np.int64)
                if not len(hashed):
                    continue
                near = np.zeros(len(hashed) + 1, np.int64)
                c = np.array(places, np.int64)
                np.add.at(near, np.clip(c - shortest + 1, 0, len(hashed)), 1)
                np.add.at(near, np.minimum(c + 1, len(hashed)), -1)
                grams.append(np.unique(hashed[np.cumsum(near[:-1]) > 0]))
                ids.append(np.full(len(grams[-1]), doc_id, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, grams)], names=["doc_id", "gram"])

    return run


def _shadowed(beside: DataFrame, found: DataFrame, keep) -> DataFrame:
    """(doc_id, places): windows of the groups with one long run beside c in which a window is in no passage found so far.

    Of a run of ``SHORTEST`` shingles that holds c, one half holds the longest side in full. So copies that the
    least document of their group hides from each other are in one such group.
    """
    longest = 2 * len(SIDES) - 2
    # a third document, besides the least: with fewer there is nobody else to meet
    others = beside.select("doc_id", "place", F.explode(F.array_compact(F.array(*[F.when(_side("packed", i) != 0, F.xxhash64("key", F.lit(i), _side("packed", i))) for i in (longest, longest + 1)]))).alias("side"))
    others = keep(others, "others")
    several = keep(others.groupBy("side").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("side"), "sides")
    others = keep(others.join(several, "side", "left_semi"), "several")
    passages = found.select(F.col("doc_id").alias("d"), "start_word", (F.col("start_word") + F.col("n_words") - WORDS).alias("until"))
    left = others.join(passages, (F.col("doc_id") == F.col("d")) & F.col("place").between(F.col("start_word"), F.col("until")), "left_anti")
    hidden = keep(left.select("side").distinct(), "hidden")
    return others.join(hidden, "side", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def _further_pairs(texts: DataFrame, shadowed: DataFrame, pairs: DataFrame, keep, shortest: int) -> DataFrame:
    """(doc_id, first_id): pairs by a whole run of ``shortest`` shingles, with the least document that has it."""
    grams = keep(texts.join(shadowed, "doc_id").select("doc_id", "text", "places").mapInArrow(_grams(shortest), "doc_id long, gram long"), "grams")
    same = keep(grams.groupBy("gram").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last")).where("last > first_id").select("gram", "first_id"), "same")
    further = grams.join(same, "gram").select("doc_id", "first_id")
    return further.where("doc_id <> first_id").distinct().join(pairs, ["doc_id", "first_id"], "left_anti")


def _followed(a: np.ndarray, b: np.ndarray, places: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """Opposite places where b repeats shingles: each goes on from its near neighbour's where b allows it, from the right, then from the left."""
    at, step, n = in_b.tolist(), np.diff(places).tolist(), len(b)
    mine, theirs = a[places].tolist(), b.tolist()
    for i in range(len(at) - 2, -1, -1):
        want = at[i + 1] - step[i]
        if step[i] <= GAP and want >= 0 and at[i] != want and theirs[want] == mine[i]:
            at[i] = want
    for i in range(1, len(at)):
        want = at[i - 1] + step[i - 1]
        if step[i - 1] <= GAP and want < n and at[i] != want and theirs[want] == mine[i]:
            at[i] = want
    return np.array(at, np.int64)


class _Greatest:
    """The greatest value among those put at places up to a given one, ties to the lesser number; log n a step."""

    def __init__(self, size: int):
        self.tree: list[tuple[float, int]] = [(-np.inf, 0)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.tree):
            if value > self.tree[place]:
                self.tree[place] = value
            place += place & -place

    def up_to(self, place: int) -> tuple[float, int]:
        place, best = place + 1, (-np.inf, 0)
        while place:
            best = max(best, self.tree[place])
            place &= place - 1
        return best


def _chains(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[list[tuple[list[int], int]], list[int]]:
    """(chains, rest): chains of runs (places p in one text, q in the other, n long) in the order of both, each with its shared places, the weightiest first.

    A gap costs little here, so a chain goes on where less than a tenth of the gap is shared on either side of it,
    however many runs it leaves out. Of runs that overlap the next one in the other text the last ``LOOK_BACK`` are looked at. All chains come from one
    table; the rest are runs whose way back leads into a weightier chain, which may be linked otherwise without it.
    """
    ends, others = p + n, q + n
    sorted_others = np.unique(others)
    place_of, before_of = np.searchsorted(sorted_others, others).tolist(), (np.searchsorted(sorted_others, q, "right") - 1).tolist()
    weight, shared, back = n.astype(float), n.tolist(), [-1] * len(p)
    apart = _Greatest(len(sorted_others))
    for j in range(len(p)):
        # runs that end in both texts before this one begins
        worth, i = apart.up_to(before_of[j])
        worth, i = worth - 0.1 * (p[j] + q[j]), -i
        lo = max(0, j - LOOK_BACK)
        if lo < j:  # runs that this one overlaps, as where a says twice what b says once
            over = others[lo:j] - q[j]
            there = (over > 0) & (q[lo:j] < q[j]) & (others[lo:j] < others[j])
            if there.any():
                each = np.where(there, weight[lo:j] - 0.1 * (p[j] - ends[lo:j]) - over, -np.inf)
                best = int(each.argmax())
                if each[best] > worth:
                    worth, i = float(each[best]), lo + best
        if worth > 0:
            weight[j] += worth
            shared[j] += shared[i]
            back[j] = i
        apart.put(place_of[j], (weight[j] + 0.1 * (ends[j] + others[j]), -j))
    found, used, rest = [], [False] * len(p), []
    for j in np.argsort(-weight, kind="stable").tolist():
        chain, i = [], j
        while i >= 0 and not used[i]:
            chain.append(i)
            i = back[i]
        if i < 0 and chain:
            found.append((chain[::-1], shared[j]))
            for i in chain:
                used[i] = True
        elif chain:
            rest.append(j)
    return found, [j for j in sorted(rest) if not used[j]]


def _longest(at: np.ndarray, to: np.ndarray, similar: float) -> tuple[int, int, int]:
    """(lo, hi, places): the farthest apart of the matches at[lo..hi] whose share in both texts' places reaches ``similar``, and their places before chance ends are left out."""
    gain = (1 - similar) / similar  # shared / (shared + missing) >= similar  <=>  gain * shared >= missing
    gaps = np.diff(at) - 1 + np.maximum(np.diff(to) - 1, 0)
    lost = np.concatenate([[0], np.cumsum(gaps)])
    after = gain * np.arange(1, len(at) + 1) - lost + 1e-9
    least = np.minimum.accumulate(after - gain - 1e-9)
    lo = np.searchsorted(-least, -after)
    lo = np.minimum(lo, np.arange(len(at)))
    hi = int((at - at[lo]).argmax())
    low = int(lo[hi])
    whole = int(at[hi] - at[low]) + 1
    while low < hi:  # an end that is small beside the gap before it is chance, not part of the passage
        cuts = low + np.flatnonzero(gaps[low:hi] > 0)
        if not len(cuts):
            break
        first, last = int(cuts[0]), int(cuts[-1])
        if first + 1 - low <= 0.1 * gaps[first]:
            low = first + 1
        elif hi - last <= 0.1 * gaps[last]:
            hi = last
        else:
            break
    return low, hi, whole


def stretches(a: np.ndarray, b: np.ndarray, shortest: int = SHORTEST, similar: float = SIMILAR) -> list[tuple[int, int, float]]:
    """(first, last, similarity): verified passages of a that b has too, in shingles of a.

    Runs of shared shingles are chained in the order of both texts, whatever the gaps; of
    each chain the longest parts that are alike are taken, edits inside, until no part
    of ``shortest`` shingles is left.
    """
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    at = np.searchsorted(sorted_b, a)
    hit = at < len(b)
    hit[hit] = sorted_b[at[hit]] == a[hit]
    found: list[tuple[int, int, float]] = []
    places = np.flatnonzero(hit)
    fewest = shortest * similar
    if len(places) < fewest:
        return found
    in_b = order[at[places]]
    if len(b) > 1 and (sorted_b[1:] == sorted_b[:-1]).any():
        in_b = _followed(a, b, places, in_b)

    def measure(x: np.ndarray, y: np.ndarray) -> float:
        """Jaccard of a's stretch over the places x and b's over y."""
        mine, theirs = np.unique(a[x[0] : x[-1] + 1]), np.unique(b[y.min() : y.max() + 1])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        return both / (len(mine) + len(theirs) - both)

    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(in_b) != 1)) + 1
    starts = np.concatenate([[0], breaks])
    lengths = np.diff(np.concatenate([starts, [len(places)]]))
    while len(starts) and lengths.sum() >= fewest:
        chains, rest = _chains(places[starts], in_b[starts], lengths)
        chains = [chain for chain, total in chains if total >= fewest]
        todo = [np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in chain]) for chain in chains]
        while todo:
            part = todo.pop()
            if len(part) < fewest or places[part[-1]] - places[part[0]] + 1 < shortest:
                continue
            x, y = places[part], in_b[part]
            lo, hi, whole = _longest(x, y, similar)
            if whole < shortest:
                continue
            todo += [part[:lo], part[hi + 1 :]]
            if x[hi] - x[lo] + 1 < shortest:
                continue
            likeness = measure(x[lo : hi + 1], y[lo : hi + 1])
            gaps = np.diff(x[lo : hi + 1]) + np.abs(np.diff(y[lo : hi + 1]) - 1) - 1
            if likeness >= similar:
                found.append((int(x[lo]), int(x[hi]), likeness))
            elif gaps.any():  # shingles that repeat count once, so it may differ after all; its parts may do
                middle = lo + int(gaps.argmax()) + 1
                todo += [part[lo:middle], part[middle : hi + 1]]
        if not chains:
            break
        starts, lengths = starts[rest], lengths[rest]
    return sorted(found)


def _verified(shortest: int, similar: float):
    names = ["doc_id", "first_id", "start_word", "n_words", "similarity"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        now, theirs = None, np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for doc_id, first_id, text, first_text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if first_id != now:
                        now, theirs = first_id, shingles(first_text)
                    if text == first_text:  # the whole of an exact copy
                        rows += [(doc_id, first_id, 0, len(theirs) + WORDS - 1, 1.0)] * (len(theirs) >= shortest)
                        continue
                    for lo, hi, likeness in stretches(shingles(text), theirs, shortest, similar):
                        rows.append((doc_id, first_id, lo, hi - lo + WORDS, likeness))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def repeats(docs: DataFrame, hashes: int = HASHES, shortest: int = SHORTEST, context: int = CONTEXT, enough: int = ENOUGH, similar: float = SIMILAR) -> DataFrame:
    """doc_id, first_id, start_word, n_words, similarity: passages of a document that an earlier one has too."""
    texts = _texts(docs)
    firsts_texts = texts.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"))
    schema = "doc_id long, first_id long, start_word long, n_words long, similarity double"

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(texts, "doc_id").join(firsts_texts, "first_id").select("doc_id", "first_id", "text", "first_text")
        return joined.mapInArrow(_verified(shortest, similar), schema)

    with contextlib.ExitStack() as tables:
        keep = lambda df, like: tables.enter_context(spilled(df, like))
        beside = _groups(texts, keep, hashes, shortest, context)
        with contextlib.ExitStack() as release:
            pairs = keep(_pairs(beside, lambda df, like: release.enter_context(spilled(df, like)), shortest, similar, enough), "pairs")
        found = keep(verified(pairs), "found")
        with contextlib.ExitStack() as release:
            again = lambda df, like: release.enter_context(spilled(df, like))
            further = keep(_further_pairs(texts, _shadowed(beside, found, again), pairs, again, shortest), "further")
        return cut(found.union(verified(further)).distinct())


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (first word, number of words), and without the white space after each."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    drop = np.zeros(len(words), bool)
    for first, n in spans:
        drop[first : first + n] = True
    out, at, kept_to = [], 0, 0
    for word, gone in zip(words, drop.tolist(), strict=True):
        start = raw.index(word, at)
        at = start + len(word)
        if gone:
            out.append(raw[kept_to:start])
            while at < len(raw) and raw[at : at + 1].isspace():
                at += 1
            kept_to = at
    out.append(raw[kept_to:])
    return b"".join(out).decode("utf-8", "surrogatepass").strip()


def _removed(text_at: int, spans_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, keep = [], []
                for text, spans in zip(part.column(text_at).to_pylist(), part.column(spans_at).to_pylist(), strict=True):
                    if spans and text is not None:
                        text = cut_words(text, [(s["start_word"], s["n_words"]) for s in spans])
                        keep.append(bool(text.split()))
                    else:
                        keep.append(True)
                    texts.append(text)
                arrays = [part.column(i) for i in range(part.num_columns)]
                arrays[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    touched = part.column(spans_at).is_valid().to_pylist()
                    before = part.column(chars_at)
                    counts = [len(t) if hit and t is not None else n for t, hit, n in zip(texts, touched, before.to_pylist(), strict=True)]
                    arrays[chars_at] = pa.array(counts, before.type)
                names = [n for i, n in enumerate(part.schema.names) if i != spans_at]
                arrays = [x for i, x in enumerate(arrays) if i != spans_at]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, without the passages that an earlier document has.

    A document of which nothing is left goes. ``n_chars``, where there is such a column,
    is set for texts that were cut.
    """
    spans = repeats(docs, **settings).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    whole = Rows(docs)
    joined = whole.rows.join(spans, whole.col("doc_id").cast("long") == F.col("doc_id"), "left").drop("doc_id")
    chars = whole.at("n_chars") if whole.has("n_chars") else None
    return whole.back(joined.mapInArrow(_removed(whole.at("text"), len(whole.names), chars), whole.rows.schema))
