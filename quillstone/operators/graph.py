"""Keyword and text graphs: similarity, clusters, label propagation, search."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.solvers import Graph, eigenvectors, harmonic, poisson
from quillstone.session import cut


def trusted_keywords(texts: DataFrame, shortest: int = 5, least: int = 2, share: float = 0.2, each: int = 8) -> DataFrame:
    """(text_id, k, r) of texts (text_id, text): the ``each`` keywords that most texts hold, of those in every text, by place.

    A keyword is a lower-cased word of at least ``shortest`` characters in at least ``least`` texts and at most ``share`` of
    them (or ``least``, if that is more): a bound that grows with the corpus, as words in most texts would connect everything.
    Ties go by word. Texts that are null hold none and don't count.
    """
    texts = texts.where("text is not null")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: F.length(w) >= shortest))
    t = texts.select("text_id", F.explode(words).alias("k"))
    n = texts.agg(F.count("*").alias("n"))  # one row, so the plan holds the count and no job runs before it
    kept = t.groupBy("k").agg(F.count("*").alias("df")).where(F.col("df") >= least).crossJoin(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(float(least)), F.col("n") * F.lit(share))).drop("n")
    trusted = Window.partitionBy("text_id").orderBy(F.col("df").desc(), "k")
    return t.join(kept, "k").withColumn("r", F.row_number().over(trusted)).where(F.col("r") <= each).select("text_id", "k", "r")


def adjacency(member: DataFrame) -> DataFrame:
    """member (text_id, k) to symmetric (k1, k2, weight): texts that hold both keywords."""
    a, b = member.select("text_id", F.col("k").alias("k1")), member.select("text_id", F.col("k").alias("k2"))
    return a.join(b, "text_id").where("k1 <> k2").groupBy("k1", "k2").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(degree, nodes) from (k1, k2)."""
    return edges.groupBy("k1").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


def top_adjacent(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("k1").orderBy(F.col("weight").desc(), "k2")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_adjacent(words: DataFrame, groups: list[str], each: int = 3) -> DataFrame:
    """(k1, k2, rank) of words (k, groups): the ``each`` least other words that share a word's group.

    Only the first ``each`` + 1 words of a group can be among them, so a group's pairs grow with its words, not with their square.
    """
    few = words.withColumn("place", F.dense_rank().over(Window.partitionBy(*groups).orderBy("k"))).where(F.col("place") <= each + 1)
    pairs = words.select(*groups, F.col("k").alias("k1")).join(few.select(*groups, F.col("k").alias("k2")), groups).where("k1 <> k2")
    w = Window.partitionBy("k1").orderBy("k2")
    return pairs.select("k1", "k2", F.row_number().over(w).alias("rank")).where(F.col("rank") <= each)


def cap_connections(scores: DataFrame, texts: int, share: float = 0.2) -> DataFrame:
    """scores (text_id, k, u): keywords with more than share * texts connections keep the best, ties kept."""
    most = int(texts * share)
    w = Window.partitionBy("k").orderBy(F.col("u").desc())
    return scores.withColumn("r", F.rank().over(w)).where(F.col("r") <= most).drop("r")


def prune_containing(words: DataFrame, column: str = "w") -> DataFrame:
    """Words that contain no other word of the set.

    Each word is cut into its substrings, so the check is an equi-join on words, not a
    comparison of all pairs.
    """
    own = words.select(column).distinct()
    n = F.length(column)
    parts = own.withColumn("i", F.explode(F.sequence(F.lit(1), n))).select(column, F.explode(F.transform(F.sequence(F.lit(1), n - F.col("i") + 1), lambda j: F.expr(column).substr(F.col("i"), j))).alias("part"))
    containing = parts.where(F.col("part") != F.col(column)).join(own.withColumnRenamed(column, "part"), "part", "left_semi").select(column).distinct()
    return own.join(containing, column, "left_anti")


def k_means(vectors: DataFrame, k: int, restarts: int = 5, seed: int = 42) -> DataFrame:
    """(id, cluster) of the cheapest of several seeded runs over (id, v)."""
    rows = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features")).cache()
    best = min((KMeans(k=k, seed=seed + i, maxIter=20).fit(rows) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", F.col("prediction").alias("cluster"))


def power_iteration(edges: DataFrame, k: int, seed_mode: str = "degree") -> DataFrame:
    """(id, cluster): spectral-like clusters of a weighted graph (a, b, weight), each edge once."""
    model = PowerIterationClustering(k=k, maxIter=15, initMode=seed_mode, srcCol="a", dstCol="b", weightCol="weight")
    return model.assignClusters(edges.where("a < b").select("a", "b", F.col("weight").cast("double").alias("weight")))


def propagate_labels(edges: DataFrame, seeds: DataFrame, rounds: int = 10, keep: float = 0.5, cut_every: int = 5) -> DataFrame:
    """(node, label, u): seeds (node, label, u) spread over (a, b, weight); each round mixes a node's seed with the weighted mean of its neighbours.

    Lineage is cut every few rounds where a checkpoint folder is set.
    """
    total = edges.groupBy("b").agg(F.sum("weight").alias("total"))
    share = edges.join(total, "b").select("a", "b", (F.col("weight") / F.col("total")).alias("share"))
    now = seeds
    context = seeds.sparkSession.sparkContext
    for i in range(rounds):
        moved = now.join(share, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "label", (F.col("u") * F.col("share") * (1 - keep)).alias("u"))
        now = seeds.withColumn("u", F.col("u") * keep).union(moved).groupBy("node", "label").agg(F.sum("u").alias("u"))
        if (i + 1) % cut_every == 0 and context.getCheckpointDir():
            now = now.checkpoint()
    return now


def strongest(labels: DataFrame) -> DataFrame:
    """(node, label): the label of the greatest mass, ties to the least label."""
    w = Window.partitionBy("node").orderBy(F.round("u", 9).desc(), "label")
    return labels.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "label")


def laplace_edges(distances: DataFrame) -> DataFrame:
    """Symmetric Gaussian weights from (a, b, d): exp(-4 d^2 / far^2), far the greatest distance of a."""
    far = F.max("d").over(Window.partitionBy("a"))
    w = distances.withColumn("far", far).where("far > 0").select("a", "b", F.exp(-4 * F.col("d") * F.col("d") / (F.col("far") * F.col("far"))).alias("weight"))
    return w.union(w.select("b", "a", "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))


def search(similar_texts: DataFrame, similar_keywords: DataFrame, text_of_keyword: DataFrame, adjacent: DataFrame, texts_each: int = 2, adjacent_each: int = 3, texts_adjacent: int = 1) -> DataFrame:
    """(qid, text_id, via): texts found directly (-1), through similar keywords, and through adjacent keywords that are not similar themselves.

    similar_texts (qid, text_id), similar_keywords (qid, k), text_of_keyword (k, text_id,
    rank), adjacent (k1, k2, rank). Each text once, with all its ways.
    """
    direct = similar_texts.select("qid", "text_id", F.lit(-1).cast("long").alias("via"))
    near = similar_keywords.join(text_of_keyword.where(F.col("rank") <= texts_each), "k").select("qid", "text_id", F.col("k").cast("long").alias("via"))
    beyond = similar_keywords.join(adjacent.where(F.col("rank") <= adjacent_each), F.col("k") == F.col("k1")).select("qid", F.col("k2").alias("k")).distinct()
    beyond = beyond.join(similar_keywords, ["qid", "k"], "left_anti")
    further = beyond.join(text_of_keyword.where(F.col("rank") <= texts_adjacent), "k").select("qid", "text_id", F.col("k").cast("long").alias("via"))
    return direct.union(near).union(further).groupBy("qid", "text_id").agg(F.array_sort(F.collect_set("via")).alias("via"))


def drop_near_copies(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ids of sizes (id, tokens) that stay, given near-copy pairs (a < b): of a pair, a goes if it has at least as many tokens, else b."""
    a, b = sizes.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sizes.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    gone = pairs.join(a, "a").join(b, "b").select(F.when(F.col("ta") >= F.col("tb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
    return sizes.join(gone, "id", "left_anti")


def spectral_clusters(graph: Graph, k: int, form: str = "normalized", extra: int = 5, **kind) -> DataFrame:
    """(id, cluster) of every node: k-means over the k + extra smallest eigenvectors; for "normalized" each node's coordinates have length one."""
    found = eigenvectors(graph, k + extra, form, **kind).vectors
    if form == "normalized":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        found = found.withColumn("length", length).select("node", F.when(F.col("length") > 0, F.transform("v", lambda x: x / F.col("length"))).otherwise(F.col("v")).alias("v"))
    return k_means(found.select(F.col("node").alias("id"), "v"), k)


def learn_labels(graph: Graph, seeds: DataFrame, method: str = "laplace", at_once: int = 16, **kind) -> DataFrame:
    """(node, label, u) of every node: the label whose column is greatest, ties to the least label; without seeds no rows.

    seeds (node, label); a node with several labels counts as the least. "laplace": each label's column is harmonic,
    1 at its own seeds and 0 at the others'. "poisson": each column solves the Poisson equation whose source is, at
    the seeds, 1 for its own less the label's share of all seeds. Columns are solved ``at_once``.
    """
    if method not in ("laplace", "poisson"):
        raise ValueError(f"unknown method {method!r}")
    own = cut(seeds.where("label is not null").groupBy("node").agg(F.min("label").alias("label")).join(graph.degrees.select("node"), "node", "left_semi"))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each label
    labels, whole = sorted(counts), sum(counts.values())
    best = None
    for i in range(0, len(labels), at_once):
        part = labels[i : i + at_once]
        names = [f"c{i + j}" for j in range(len(part))]
        hit = [(F.col("label") == F.lit(x)).cast("double") for x in part]
        if method == "laplace":
            solved = harmonic(graph, own.select("node", *[h.alias(c) for h, c in zip(hit, names, strict=True)]), names, **kind)
        else:
            solved = poisson(graph, own.select("node", *[(h - F.lit(counts[x] / whole)).alias(c) for h, c, x in zip(hit, names, part, strict=True)]), names, **kind)
        # rounded, so that solver noise decides no tie; the least label of the greatest value
        each = [F.struct(F.round(c, 9).alias("u"), F.lit(-(i + j)).alias("turn"), F.lit(x).alias("label")) for j, (c, x) in enumerate(zip(names, part, strict=True))]
        top = solved.values.select("node", (F.greatest(*each) if len(each) > 1 else each[0]).alias("best"))
        best = top if best is None else best.join(top.withColumnRenamed("best", "other"), "node").select("node", F.greatest("best", "other").alias("best"))
    if best is None:
        return own.select("node", "label", F.lit(0.0).alias("u"))
    return best.select("node", "best.label", "best.u")
