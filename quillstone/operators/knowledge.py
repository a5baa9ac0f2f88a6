"""Graph building and answering: representatives, membership, facts, subgraphs, pipelines by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunks
from quillstone.operators.graph import propagate_labels
from quillstone.session import cut


def representatives(distances: DataFrame, budget: int) -> DataFrame:
    """distances (cluster, id, d, tokens): nearest to the centre first, while their tokens fit the budget."""
    w = Window.partitionBy("cluster").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    return distances.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def centre_distances(vectors: DataFrame) -> DataFrame:
    """vectors (id, cluster, v): (cluster, id, d), the Euclidean distance to the mean of the cluster; means are summed map-side."""
    parts = vectors.select("id", "cluster", F.posexplode(F.col("v").cast("array<double>")).alias("i", "x"))
    centre = parts.groupBy("cluster", "i").agg(F.avg("x").alias("c"))
    return parts.join(centre, ["cluster", "i"]).groupBy("cluster", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d"))


def cluster_terms(docs: DataFrame, k: int) -> DataFrame:
    """docs (cluster, id, text): the k terms of each cluster with the greatest tf-idf, ties by term."""
    words = docs.select("cluster", "id", F.explode(T.tokens(F.lower("text"))).alias("w"))
    n = docs.select(F.countDistinct("id").alias("n"))
    df = words.groupBy("w").agg(F.countDistinct("id").alias("df"))
    tf = words.groupBy("cluster", "w").agg(F.count("*").alias("tf"))
    scored = tf.join(df, "w").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log((F.col("n") + 1) / F.col("df")), 6))
    best = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "w")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("cluster", "w", "score", "rank")


def trusted_seeds(distances: DataFrame, trust: int = 5, multiplier: int = 3) -> DataFrame:
    """distances (k, text_id, d): (k, node, label, u); the nearest ``trust`` texts are label 0, the farthest multiplier * trust label 1."""
    near = Window.partitionBy("k").orderBy("d", "text_id")
    far = Window.partitionBy("k").orderBy(F.col("d").desc(), F.col("text_id").desc())
    r = distances.withColumn("n", F.row_number().over(near)).withColumn("f", F.row_number().over(far))
    label = F.when(F.col("n") <= trust, 0).when(F.col("f") <= trust * multiplier, 1)
    return r.select("k", F.col("text_id").alias("node"), label.alias("label"), F.lit(1.0).alias("u")).where("label is not null")


def membership(edges: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """(k, text_id, u): texts whose stronger label is the keyword's own; all keywords spread in one job."""
    keyed = seeds.select("node", F.struct("k", "label").alias("label"), "u")
    spread = propagate_labels(edges, keyed, rounds).select(F.col("label.k").alias("k"), F.col("node").alias("text_id"), F.col("label.label").alias("side"), "u")
    sides = spread.groupBy("k", "text_id").agg(F.sum(F.when(F.col("side") == 0, F.col("u")).otherwise(0.0)).alias("u"), F.sum(F.when(F.col("side") == 1, F.col("u")).otherwise(0.0)).alias("against"))
    return sides.where("u >= against").select("k", "text_id", "u")


def related_texts(scores: DataFrame, k: int, by: str = "u", descending: bool = True) -> DataFrame:
    """The k texts of each keyword with the greatest membership, or the least distance."""
    order = F.col(by).desc() if descending else F.col(by)
    w = Window.partitionBy("k").orderBy(order, "text_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def subgraph(found: DataFrame) -> DataFrame:
    """found (qid, text_id, via array): (qid, src, dst) of a drawing; -1 is the question itself."""
    rows = found.select("qid", "text_id", F.explode("via").alias("v"))
    start = F.when(F.col("v") == -1, F.concat(F.lit("q"), "qid")).otherwise(F.concat(F.lit("k"), "v"))
    hubs = rows.where("v <> -1").select("qid", F.concat(F.lit("q"), "qid").alias("src"), F.concat(F.lit("k"), "v").alias("dst"))
    return rows.select("qid", start.alias("src"), F.concat(F.lit("t"), "text_id").alias("dst")).union(hubs).distinct()


def fact(section: Column, content: Column, entities: Column) -> Column:
    return F.concat(F.lit("Section: "), section, F.lit("\nContent: "), F.substring(content, 1, 500), F.lit("...\nEntities: "), F.array_join(entities, ", "))


def facts_context(facts: DataFrame, most: int = 10) -> DataFrame:
    """facts (qid, place, fact): one numbered context a question, of the first ``most``."""
    w = Window.partitionBy("qid").orderBy("place")
    top = facts.where("fact <> ''").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    lines = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("Source "), "n", F.lit(": "), "fact").alias("line")))).alias("x"))
    return lines.select("qid", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("context"))


def policy_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """Sections, entities and mentions of documents: episodes, entities, mentions tables."""
    episodes = chunks.split_with(docs, chunks.sections()).select(F.concat_ws("_", "doc_id", "chunk").alias("episode"), "doc_id", "chunk", "content")
    named = episodes.select("episode", F.explode(T.entities(F.col("content"))).alias("kind", "names")).select("episode", "kind", F.explode("names").alias("name"))
    mentions = cut(named.distinct())  # entities are looked for once
    return {"episodes": episodes, "entities": mentions.select("kind", "name").distinct(), "mentions": mentions}


#: Retrieval pipelines by name; a caller may add some.
PIPELINES: dict[str, Callable[..., DataFrame]] = {}
DEFAULT = "traditional"


def register_pipeline(name: str, run: Callable[..., DataFrame]) -> None:
    PIPELINES[name] = run


def pipeline(name: str | None = None) -> Callable[..., DataFrame]:
    """A pipeline by name, the default for none."""
    if (name or DEFAULT) not in PIPELINES:
        raise KeyError(f"unknown pipeline {name!r}; known: {sorted(PIPELINES)}")
    return PIPELINES[name or DEFAULT]
