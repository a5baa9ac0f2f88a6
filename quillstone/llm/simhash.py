"""SimHash near-duplicates: fingerprints, pigeonring candidate search, connected components.

Two fingerprints of 64 bits link at ``LIMIT`` (4) or fewer differing bits. The ring
has five segments. If two fingerprints differ in at most 4 bits, then some segment
starts a chain in which every prefix of n consecutive segments differs in at most
floor(4 n / 5) bits: 0, 1, 2, 3, 4. So the candidates of a segment agree in it exactly
and differ in at most one bit of the next: the search key holds both, and one side
also looks up the key with each set bit of the second segment cleared. Candidates are
pruned by the prefixes of three and four segments before the full Hamming check.

Fingerprints are collapsed first, so exact copies cost one row. Within a key no pairs
are written: each task joins its members into trees and writes only tree edges. A key
with more than ``BLOCK`` members is dealt into blocks, and each block meets the others
in tasks of their own, so no task holds a whole hot key.

Defined cases: null text counts as no words: fingerprint zero, which links like any
other. Fewer than four words: one shingle of them all. Rows with a null id get the
smallest id that is not null in their component, or null if there is none. Repeated
rows are kept. Very long texts are fingerprinted whole; a bit set in just half the hashes (a tie) is 0. Empty
tables give no rows. Extra columns, whatever their names, are ignored, and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, cut, take

LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Lowest bit of each segment, the first one topmost.
SHIFTS = tuple(64 - sum(WIDTHS[: i + 1]) for i in range(len(WIDTHS)))
BLOCK = 4096
PROBES = 8  #: times BLOCK rows in one part of a hot key


def fingerprint(text: str | None, words_each: int = 4, seed: int = 42, chunk: int = 1 << 16) -> int:
    """The 64 bit SimHash of whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < words_each:
        return int.from_bytes(digest(b" ".join(words), seed), "big")
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_each + 1].tolist()
    ends = ends[words_each - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), chunk):
        packed = b"".join([digest(whole[s:e], seed) for s, e in zip(starts[at : at + chunk], ends[at : at + chunk], strict=True)])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            values = np.array([fingerprint(x) for x in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row."""
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _key(fp: Column, i: int, second: Column) -> Column:
    return F.lit(i << 26).cast("long") + F.shiftleft(_segment(fp, i), 13) + second


def _keys_of(fp: Column, i: int) -> list[Column]:
    """Arrays of (key, probe) for the chain that starts at segment i."""
    nxt = (i + 1) % len(WIDTHS)
    second = _segment(fp, nxt)
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(WIDTHS[nxt])])
    entry = lambda part, probe: F.struct(_key(fp, i, part).alias("key"), F.lit(probe).alias("probe"))
    set_bits = F.filter(masks, lambda m: second.bitwiseAND(m) != 0)
    return [F.array(entry(second, False)), F.transform(set_bits, lambda m: entry(second.bitwiseXOR(m), True))]


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, probe): each fingerprint under its own five keys, and as a probe under those with one bit of the second segment cleared."""
    found = [x for i in range(len(WIDTHS)) for x in _keys_of(F.col("fp"), i)]
    return fps.select("fp", F.explode(F.concat(*found)).alias("x")).select("x.key", "fp", "x.probe")


def _prefix_masks() -> np.ndarray:
    """For each start on the ring, the bits of three and of four consecutive segments."""
    one = [((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS, strict=True)]
    of = lambda i, n: sum(one[(i + j) % len(one)] for j in range(n))
    return np.array([[of(i, 3), of(i, 4)] for i in range(len(one))], np.uint64)


PREFIXES = _prefix_masks()


def linked(differ: np.ndarray, start: int) -> np.ndarray:
    """Which XORs of candidates of segment ``start`` pass the chain and then the full check."""
    ok = np.bitwise_count(differ & PREFIXES[start, 0]) <= 2
    ok &= np.bitwise_count(differ & PREFIXES[start, 1]) <= 3
    ok[ok] = np.bitwise_count(differ[ok]) <= LIMIT
    return ok


def _forest(right: np.ndarray, left: np.ndarray, start: int, chunk: int = 1024) -> list[tuple[int, int]]:
    """Tree edges that join what the linking pairs right x right and left x right join.

    Each fingerprint of ``right`` has a label; a row looks only at the labels of what it links to, so a
    dense group costs a step a row, not a step a pair.
    """
    label = np.arange(len(right))
    edges: list[tuple[int, int]] = []
    for own, rows in ((True, right), (False, left)):
        for at in range(0, len(rows), chunk):
            part = rows[at : at + chunk]
            ok = linked(part[:, None] ^ right[None, :], start)
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                to = np.flatnonzero(ok[i])
                found, where = np.unique(label[to], return_index=True)
                mine = label[at + i] if own else found[0]
                for other, w in zip(found.tolist(), where.tolist(), strict=True):
                    if not own or other != mine:
                        edges.append((int(part[i]), int(right[to[w]])))
                    if other != mine:
                        label[label == other] = mine
    return edges


def _tree_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, side): in each group those of side 0 are met by all."""
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []
    now: tuple[int, int] | None = None
    out: list[tuple[int, int]] = []

    def close() -> None:
        if right and sum(map(len, right)) + sum(map(len, left)) > 1:
            out.extend(_forest(np.concatenate(right), np.concatenate(left) if left else np.empty(0, np.uint64), now[0] >> 26))

    def flush() -> pa.RecordBatch:
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        key, block, side, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        fp = fp.astype(np.int64).view(np.uint64)
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        last = np.append(first[1:], len(key))
        ones = np.add.reduceat((side == 0).astype(np.int64), first)
        size = last - first
        edge = np.zeros(len(first), bool)
        edge[0] = edge[-1] = True
        for g in np.flatnonzero(edge | ((size > 1) & (ones > 0))).tolist():
            s, e, n = int(first[g]), int(last[g]), int(ones[g])
            group = (int(key[s]), int(block[s]))
            if group != now:
                close()
                now = group
                right.clear()
                left.clear()
            if n:
                right.append(fp[s : s + n])
            if s + n < e:
                left.append(fp[s + n : e])
            if sum(map(len, left)) > 4 * BLOCK and right:  # side 0 came first, so it is complete
                out.extend(_forest(np.concatenate(right), np.concatenate(left), now[0] >> 26))
                left.clear()
        if len(out) > 50_000:
            yield flush()
    if now is not None:
        close()
    yield flush()


def link_forest(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    keyed = _keyed(fps)
    # both sides of a key count: many probes may gather under a key with few fingerprints of its own, and the other way round
    sizes = keyed.groupBy("key").agg(F.sum((~F.col("probe")).cast("long")).alias("owners"), F.count("*").alias("n"))
    hot = cut(sizes.where((F.col("owners") > 0) & ((F.col("owners") > block) | (F.col("n") > PROBES * block))).select("key", F.ceil(F.col("owners") / block).cast("int").alias("blocks"), F.ceil(F.col("n") / (PROBES * block)).cast("int").alias("parts")))
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("block"), F.col("probe").cast("int").alias("side"), "fp")
    else:
        h = F.xxhash64("fp")
        each = keyed.join(hot, "key", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})
        each = each.withColumns({"own": F.pmod(h, F.col("blocks")).cast("int"), "part": F.pmod(F.shiftright(h, 20), F.col("parts")).cast("int")})
        each = each.select("key", "fp", "probe", "own", "part", "parts", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
        # a block's own fingerprints meet every part of the rows that come to it; all others come in one part
        mine = ~F.col("probe") & (F.col("b") == F.col("own"))
        spread = F.when(mine, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
        each = each.select("key", "fp", F.when(mine, 0).otherwise(1).alias("side"), "b", "parts", F.explode(spread).alias("p"))
        dealt = each.select("key", (F.col("b") * F.col("parts") + F.col("p")).alias("block"), "side", "fp")
    sorted_rows = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "side")
    return sorted_rows.mapInArrow(_tree_edges, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Every round takes the least label of the neighbours and then the label of that
    label, so chains shorten geometrically. Labels stay on the executors; each round is
    cut in the shared folder. Minimums are combined before the shuffle.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").select("node", "component")
        least = labels.union(near).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut(
            least.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        )
        moved = after.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before")
        done = moved.isEmpty()
        labels = after
        if done:
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    rows = cut(fingerprints(docs))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(link_forest(fps.select("fp"), block))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))  # a table, so that Spark can split a large component
    by_fp = cut(named.join(ids, "component").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each component does, with all their columns.

    The row with the component's own id stays; of repeated rows with that id, one. Rows
    without an id can't be named by a component: one of each text stays.
    """
    whole = Rows(docs)
    named = take(docs, "doc_id", "text").where("doc_id is not null")
    found = near_duplicates(named)
    kept = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")))
    doc_id, text = whole.col("doc_id"), f"_c{whole.at('text')}"
    stay = whole.rows.join(kept.select(F.col("doc_id").alias("keep")), doc_id.cast("long") == F.col("keep"), "left_semi")
    if not kept.where("times > 1").isEmpty():
        stay = stay.dropDuplicates([f"_c{whole.at('doc_id')}"])
    return whole.back(stay.unionByName(whole.rows.where(doc_id.isNull()).dropDuplicates([text])))
