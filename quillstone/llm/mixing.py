"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With target share w, block k of a source
(k from 1) is released at slot floor((k - 1) / w) and due at slot ceil(k / w). Each
slot takes the released block that is due first (ties: the source first by name). The
shares sum to 1, so earliest-deadline-first meets every window and at any slot no source
is a whole block away from its share of the slots so far.

Shares are the given weights as fractions over their least common denominator, so the
schedule repeats after that many slots (84 for the production weights), and one period, made
on the driver from the weights alone, tells the slot of any block by arithmetic. Weights
whose denominator is over ``LONGEST_PERIOD``, which bounds the plan, are rounded to multiples of 1 /
``LONGEST_PERIOD``: a source is then a block off its weight after that many slots at the
earliest. When a source runs out, the others go on in a new phase with their shares
scaled up; inside each phase the bound holds.

Nothing is dropped or repeated: every document has one place in the mix. Blocks within
a source follow a hash of the id, so each is a random sample of its source. Ranks are
found in two steps (counts by (source, part), then ranks within a part), so a source that
holds a third of all rows meets in no single task.

Defined cases: sources without a target weight, null ones among them, are one stream of
weight ``rest``, shuffled by the hash, so that each holds its own share of it; listed
sources that are absent are left out and the shares scaled to sum 1. Repeated rows have
places of their own. Ties of the hash go by id and source. The last block of a stream may hold fewer documents. Empty tables
give no rows. Texts, empty or very long, are not read by ``mix``. Columns other than doc_id and source, whatever
their names, are ignored by it and kept by ``in_order``. The plan on the driver is sized by the weight table,
whatever the number of sources.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, cut, even_parts, take

LONGEST_PERIOD = 100_000
BLOCK_DOCS = 16


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers without a common divisor."""
    fractions = {}
    for s, w in weights.items():
        near = Fraction(w).limit_denominator(1_000_000)  # 1 / 3 as it was meant
        fractions[s] = near if float(near) == float(w) else Fraction(str(w))
    over = math.lcm(*[f.denominator for f in fractions.values()])
    whole = {s: int(f * over) for s, f in fractions.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def rounded_shares(weights: dict[str, float], period: int = 1000) -> dict[str, int]:
    """Whole numbers that sum to ``period`` (or to the number of sources, if that is more), at least 1 each."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(out.values())
    order = sorted(out, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while spare > 0:
        out[order[i % len(order)]] += 1
        spare -= 1
        i += 1
    while spare < 0:  # the minimum of 1 took too much: the largest give
        most = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else float("-inf"), s))
        out[most] -= 1
        spare += 1
    return out


def one_period(shares: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period, by earliest deadline first."""
    period = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    ready: list[tuple[int, str]] = []
    waiting = [(0, s) for s in sorted(shares)]
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            k = len(slots[s]) + 1
            heapq.heappush(ready, (-(-k * period // shares[s]), s))
        due, s = heapq.heappop(ready)
        if due <= slot:
            raise RuntimeError("a deadline was missed")
        slots[s].append(slot)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * period // shares[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """The plan: for each phase its first slot, shares, one period, and each source's first block (from 0).

    ``period`` rounds the shares to multiples of 1 / period; None takes them as they are, up to LONGEST_PERIOD.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    plan, start = [], 0
    while left:
        wanted = {s: weights[s] for s in left}
        shares = exact_shares(wanted) if period is None else rounded_shares(wanted, period)
        if sum(shares.values()) > max(LONGEST_PERIOD, period or 0):
            shares = rounded_shares(wanted, LONGEST_PERIOD)
        slots = one_period(shares)
        whole = sum(shares.values())

        def last_slot(s: str, slots=slots, shares=shares, whole=whole) -> int:
            n = left[s] - 1
            return n // shares[s] * whole + slots[s][n % shares[s]]

        length = min(last_slot(s) for s in left) + 1
        plan.append({"start": start, "length": length, "shares": shares, "slots": slots, "first": dict(done), "whole": whole})
        for s in list(left):
            taken = length // whole * shares[s] + bisect_left(slots[s], length % whole)
            done[s] += taken
            left[s] -= taken
            if not left[s]:
                del left[s]
        start += length
    return plan


def target_weights(counts: dict[str, int], weights: dict[str, float], rest: float) -> dict[str, float]:
    """A positive weight for each present stream; '' is that of all sources without a weight."""
    return {s: w for s, w in ({"": rest} | weights).items() if s in counts and w > 0} or dict.fromkeys(counts, 1.0)


def ranked(docs: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, source, stream, rank from 0 within the stream), and the documents of each stream."""
    base = take(docs, "doc_id", "source").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    listed = [s for s, w in weights.items() if w > 0]
    base = base.withColumn("stream", F.when(F.col("source").isin(listed), F.col("source")).otherwise(F.lit("")))
    counts = {r["stream"]: r["n"] for r in base.groupBy("stream").agg(F.count("*").alias("n")).collect()}  # a row a weight
    each = sum(counts.values()) // even_parts(sum(counts.values()))
    parts = docs.sparkSession.createDataFrame([(s, max(1, n // max(1, each))) for s, n in counts.items()], "stream string, parts long")
    dealt = base.withColumn("h", F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("source"))).join(F.broadcast(parts), "stream").withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("parts")
    sizes = dealt.groupBy("stream", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sizes.select("stream", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("stream", "part").orderBy("h", "doc_id", "source")
    return dealt.join(bases, ["stream", "part"]).select("doc_id", "source", "stream", (F.col("base") + F.row_number().over(inside) - 1).alias("rank")), counts


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = 1.0, block_docs: int = BLOCK_DOCS, period: int | None = None) -> DataFrame:
    """doc_id, source, stream, block, phase, release, deadline, slot, position for every row of docs (doc_id, source).

    ``slot`` is the block's turn in the whole mix, ``position`` orders documents within it.
    Release and deadline are slots of the whole mix too.
    """
    weights = weights or {}
    rows, counts = ranked(docs, weights)
    spark = docs.sparkSession
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    plan = phases(blocks, target_weights(counts, weights, rest), period)
    # one row per source, with its phases and turns: sized by the weight table, not by the data
    turns: dict[str, list] = {}
    for i, p in enumerate(plan):
        for s, share in p["shares"].items():
            first, whole = p["first"][s], p["whole"]
            until = first + p["length"] // whole * share + bisect_left(p["slots"][s], p["length"] % whole)
            turns.setdefault(s, []).append((i, first, until, share, whole, p["start"], p["slots"][s]))
    kind = "array<struct<phase:int,first:long,until:long,share:long,whole:long,start:long,slots:array<int>>>"
    table = spark.createDataFrame(list(turns.items()), f"stream string, plan {kind}")
    block = F.col("block")
    joined = rows.withColumn("block", F.floor(F.col("rank") / block_docs)).join(F.broadcast(table), "stream")
    joined = joined.withColumn("p", F.element_at(F.filter("plan", lambda p: (block >= p["first"]) & (block < p["until"])), 1)).drop("plan")
    k = block - F.col("p.first")
    return joined.select(
        "doc_id",
        "source",
        "stream",
        "block",
        F.col("p.phase").alias("phase"),
        (F.col("p.start") + F.expr("(block - p.first) * p.whole div p.share")).alias("release"),
        (F.col("p.start") + F.expr("((block - p.first + 1) * p.whole + p.share - 1) div p.share")).alias("deadline"),
        (F.col("p.start") + F.floor(k / F.col("p.share")) * F.col("p.whole") + F.element_at("p.slots", (k % F.col("p.share") + 1).cast("int"))).alias("slot"),
        (F.col("rank") % block_docs).alias("position"),
    )


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = 1.0, block_docs: int = BLOCK_DOCS, period: int | None = None) -> DataFrame:
    """The rows of docs, all columns, sorted by their place in the mix.

    Rows with equal id and source have equal places here (they are copies of one row's
    turn), so none is lost or multiplied.
    """
    places = mix(docs, weights, rest, block_docs, period).groupBy("doc_id", "source").agg(F.min(F.struct("slot", "position")).alias("at"))
    whole = Rows(docs)
    own = (whole.col("doc_id").cast("long").eqNullSafe(F.col("doc_id"))) & (F.coalesce(whole.col("source").cast("string"), F.lit("")) == F.col("source"))
    return whole.back(whole.rows.join(places, own).orderBy("at.slot", "at.position", "doc_id"))
