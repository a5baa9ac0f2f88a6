"""SpotSigs fingerprints: chains of content words that follow common-word anchors. DataFrame functions only.

Text is lower-cased and cut into words of letters and digits. A common word (or a run
of them: its last) is an anchor; its signature is a hash of the anchor and the next
``CHAIN`` content words. The fingerprint of a text is the set of its signatures, so
boilerplate without common words leaves no trace in it. Text without an anchor has the
hash of its words as its only signature.

Two sets can reach a Jaccard similarity t only if the smaller has at least t times as
many members as the larger. ``similar_pairs`` deals sets to partitions by length
accordingly, joins them on the few rarest signatures that any such pair must share, and
compares sets of fitting length only.

Defined cases: null text counts as empty. The document after the last is the first; a
single document follows itself. Documents are ordered by id, null ids last, ties by a
hash of the text. Repeated rows are documents of their own. Very long texts are fingerprinted whole.
Empty tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, take

CHAIN = 3
ROWS_A_PART = 2000
RANGES = 256
MOST_HEADS = 200_000
#: Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or that the their this to was were which will with you "
    "als am auf aus bei das dem den der des die ein eine im ist mit nicht sich und von war wie zu "
    "au aux ce dans des du elle en est et la le les par pas pour que qui se sur un une "
    "con de del el ella en es la las lo los no para por que se su un una y"
)
_END = "\u0001 "


def normal(text: Column) -> Column:
    """Lower-cased words of letters and digits, each followed by one space."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    words = F.trim(spaced)
    return F.when(words == "", F.lit("")).otherwise(F.concat(words, F.lit(" ")))


def _segments(words: Column, chain: int) -> Column:
    """Content words, each with the run of common words before it; ``chain`` end marks follow the last."""
    common = "|".join(sorted(set(ANCHORS.split()), key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.concat(words, F.lit(_END * chain)), F.lit(f"(?:(?:{common}) )*+[^ ]+ "), F.lit(0))


def with_signatures(df: DataFrame, text: str, into: str, chain: int = CHAIN) -> DataFrame:
    """df with column ``into``: the sorted distinct signatures (64 bits) of column ``text``."""
    words, parts = f"_{into}_words", f"_{into}_parts"
    df = df.withColumn(words, normal(F.col(text))).withColumn(parts, _segments(F.col(words), chain))
    part = F.col(parts)
    shifted = [F.slice(part, F.lit(1 + i), F.greatest(F.size(part) - i, F.lit(0))) for i in range(chain)]
    anchored = F.filter(F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(shifted)]), lambda z: (F.instr(z["w0"], " ") < F.length(z["w0"])) & z[f"w{chain - 1}"].isNotNull())
    hashed = F.transform(
        anchored,
        lambda z: F.xxhash64(F.substring_index(z["w0"], " ", -3), *[F.substring_index(z[f"w{i}"], " ", -2) for i in range(1, chain)]),
    )
    df = df.withColumn(into, F.sort_array(F.array_distinct(hashed)))
    return df.withColumn(into, F.when(F.size(into) > 0, F.col(into)).otherwise(F.array(F.xxhash64(words)))).drop(words, parts)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets that are not empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_string(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def _place(value: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the sorted bounds a value has reached, found by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value < F.lit(bounds[half]), _place(value, bounds[:half], first)).otherwise(_place(value, bounds[half + 1 :], first + half + 1))


def parts_of(docs: DataFrame, rows_a_part: int = ROWS_A_PART, ranges: int = RANGES) -> Column:
    """A number for each row of docs (doc_id, tie) that grows with the order, some ``rows_a_part`` rows to a number.

    Quantiles give up to ``ranges`` ranges of equally many rows, each cut into equal cells of ids, as
    many as the table needs. An id that fills whole ranges by itself, and rows without an id, are cut into cells
    of the tie, a hash.
    """
    rows, nulls, least, most = docs.select(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    cells = max(1, -(-(rows - nulls) // rows_a_part))
    ranges = min(ranges, cells)
    edges = [int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)] if ranges > 1 else []
    each = -(-cells // ranges)
    # (first id, cells, whether of the tie) of the ranges in order
    table = [(least or 0, each, False)]
    for edge in sorted(set(edges)):
        if (times := edges.count(edge)) > 1:
            table.append((edge, times * each, True))
            edge += 1
        table.append((edge, each, False))
    table = [x for x, after in zip(table, [*table[1:], None], strict=True) if after is None or after[0] > x[0]]
    ends = [x[0] for x in table[1:]] + [(most or 0) + 1]
    before = [sum(x[1] for x in table[:i]) for i in range(len(table) + 1)]
    at = _place(F.col("doc_id"), [x[0] for x in table[1:]]) + 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), at)
    tie = F.col("tie") / 2.0**64 + 0.5  # 0 to 1
    share = F.when(of([x[2] for x in table], "boolean"), tie).otherwise((F.col("doc_id").cast("double") - of([x[0] for x in table], "double")) / of([max(1, e - x[0]) for x, e in zip(table, ends, strict=True)], "double"))
    cell = lambda part, n: F.least(F.greatest(F.floor(part * n), F.lit(0)), n - 1).cast("long")
    without = F.lit(before[-1]) + cell(tie, F.lit(max(1, -(-nulls // rows_a_part))))
    return F.when(F.col("doc_id").isNull(), without).otherwise(of(before[:-1], "long") + cell(share, of([x[1] for x in table], "long")))


def with_next(docs: DataFrame, rows_a_part: int = ROWS_A_PART, ranges: int = RANGES) -> DataFrame:
    """docs (doc_id, text) with their signatures, and next_text and next_signatures of the following document.

    Rows are dealt to parts of the order. The first row of each part is also put at
    the end of the part before, so every row finds its follower in its own part. Only
    texts are moved, once; they are fingerprinted where they come to lie.
    """
    dealt = docs.withColumn("tie", F.xxhash64("text"))
    dealt = dealt.withColumn("part", parts_of(dealt, rows_a_part, ranges)).withColumn("after", F.lit(0))
    order = ["after", F.col("doc_id").asc_nulls_last(), "tie"]
    firsts = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("head")).select("part", "head.doc_id", "head.tie")
    ring = Window.orderBy("part")  # one row a part
    before = F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy(F.lit(1))))
    firsts = cut(firsts.select("part", "doc_id", "tie", before.alias("to")))
    heads = firsts.select(F.col("part").alias("_part"), F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "to")
    if firsts.count() <= MOST_HEADS:  # some 8 MB; beyond, the planner joins by sort, with a bloom filter on the larger side
        heads = F.broadcast(heads)
    heads = (
        dealt.join(heads, (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .drop("_part", "_id", "_tie", "part")
        .withColumnRenamed("to", "part")
        .withColumn("after", F.lit(1))
    )
    follow = Window.partitionBy("part").orderBy(*order)
    moved = dealt.unionByName(heads).withColumn("next_text", F.lead("text").over(follow))
    return (
        with_signatures(moved, "text", "signatures")
        .withColumn("next_signatures", F.lead("signatures").over(follow))
        .where("after = 0")
        .drop("part", "tie", "after")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and two likenesses.

    The edited text has its last half replaced by as much of the next document's start.
    """
    base = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(base)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).drop("text", "next_text")
    pairs = with_signatures(pairs, "edited", "edited_signatures")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("signatures")).alias("fingerprint"),
        as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        jaccard(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        jaccard(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id with its class, and pairs of classes at or above the threshold.

    A class holds the documents with equal fingerprints and is named by its least id, so
    copies are never expanded into pairs. Each class looks up its rarest signatures (all
    but what the threshold lets it lose) in the length partitions that can hold a partner.
    """
    base = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = with_signatures(base, "text", "signatures").select("doc_id", "signatures", F.sha2(as_string(F.col("signatures")).cast("binary"), 256).alias("print"))
    names = signed.groupBy("print").agg(F.min("doc_id").alias("class"))
    members = signed.select("doc_id", "print").join(names, "print").select("doc_id", "class")
    sets = cut(signed.join(names, "print").where("doc_id = class").select("class", "signatures").dropDuplicates(["class"]))
    frequent = sets.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = (
        sets.select("class", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
        .join(frequent, "s")
        .groupBy("class", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("rare"))
    )
    reach = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    step = F.lit(-1.0 / __import__("math").log(threshold))
    level = F.floor(F.log(F.col("n").cast("double")) * step).cast("int")
    seeds = cut(ranked.select("class", "n", level.alias("level"), F.explode(F.slice("rare", F.lit(1), reach)).alias("x")).select("class", "n", "level", F.col("x.s").alias("s")))
    left = seeds.select(F.col("class").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"))
    right = seeds.select(F.col("class").alias("b"), F.col("n").alias("nb"), "s", "level")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * threshold) & (F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    candidates = left.join(right, ["s", "level"]).where(fits).select("a", "b").distinct()
    set_of = lambda name: sets.select(F.col("class").alias(name), F.col("signatures").alias(f"s{name}"))
    pairs = candidates.join(set_of("a"), "a").join(set_of("b"), "b").withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
    return members, pairs.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
