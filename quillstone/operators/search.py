"""Retrieval: adaptive cut, BM25, hybrid union, fusion of queries, relevance gate, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

MIN_K, MAX_K, THRESHOLD = 4, 15, 0.1


def score_drops(ranked: DataFrame) -> DataFrame:
    """ranked (qid, rank, score) with each rank's relative drop from the one before; 1 after a score of 0 or less."""
    w = Window.partitionBy("qid").orderBy("rank")
    before = F.lag("score").over(w)
    drop = F.when(before.isNull(), F.lit(None)).when(before <= 0, F.lit(1.0)).otherwise((before - F.col("score")) / before)
    return ranked.withColumn("drop", drop)


def dynamic_k(ranked: DataFrame, min_k: int = MIN_K, max_k: int = MAX_K, threshold: float = THRESHOLD) -> DataFrame:
    """(qid, n, k, reason): how many results of each list to keep.

    The first of: a drop at or over the adaptive threshold, a score under a share of
    the best, a cumulative loss over a quarter; else by the average drop.
    """
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("qid")
    best = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(whole)
    d = score_drops(ranked).withColumn("lost", F.sum("drop").over(run)).withColumn("best", best)
    limit = F.when(F.col("best") > 0.8, F.greatest(F.lit(0.08), F.lit(threshold * 0.6))).when(F.col("best") > 0.6, F.greatest(F.lit(0.1), F.lit(threshold * 0.8))).otherwise(F.lit(threshold))
    share = F.when(F.col("best") > 0.8, 0.75).otherwise(0.7)
    late = F.col("rank") >= min_k
    g = d.groupBy("qid").agg(
        F.count("*").alias("n"),
        F.min(F.when(late & (F.col("drop") >= limit), F.col("rank"))).alias("cliff"),
        F.min(F.when(late & (F.col("score") < F.col("best") * share), F.col("rank"))).alias("weak"),
        F.min(F.when(late & (F.col("lost") > 0.25), F.col("rank"))).alias("spent"),
        F.avg("drop").alias("mean_drop"),
    )
    first = F.least("cliff", "weak", "spent")
    by_mean = F.when(F.col("mean_drop") < 0.03, F.least("n", F.lit(12))).when(F.col("mean_drop") < 0.06, F.lit(8)).otherwise(F.lit(6))
    raw = F.coalesce(first, by_mean)
    k = F.when(F.col("n") <= 1, F.lit(min_k)).otherwise(F.greatest(F.lit(min_k), F.least(raw, F.lit(max_k), F.col("n"))))
    reason = (
        F.when(F.col("n") <= 1, "insufficient_data")
        .when(first.isNull(), "average_drop")
        .when(F.col("cliff") == first, "relative_drop")
        .when(F.col("weak") == first, "score_threshold")
        .otherwise("cumulative_loss")
    )
    return g.select("qid", "n", k.cast("long").alias("k"), reason.alias("reason"))


def relevance_gate(ranked: DataFrame, queries: DataFrame, threshold: float = 0.255) -> DataFrame:
    """(qid, best, relevant) for all queries (qid): best of the top 5; without hits a query counts as relevant."""
    best = ranked.where("rank <= 5").groupBy("qid").agg(F.max("score").alias("best"))
    return queries.join(best, "qid", "left").select("qid", "best", F.coalesce(F.col("best") >= threshold, F.lit(True)).alias("relevant"))


def fuse(ranked: DataFrame, group: str = "grp", keep: int = 4) -> DataFrame:
    """Best score of each row over the queries of a group; the first ``keep`` rows a group."""
    best = ranked.groupBy(group, "id").agg(F.max("score").alias("score"), F.count("*").alias("hits"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qid, id, score): BM25 (Okapi form) of queries (qid, text) over docs (id, text).

    Words are split at white space, case kept. A negative idf becomes epsilon times the
    mean idf of the vocabulary. Only words of the queries are shuffled with their
    documents; lengths and document frequencies are summed map-side.
    """
    parts = docs.select("id", T.tokens(F.col("text")).alias("w"))
    stats = parts.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    df = parts.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("w", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    mean = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    wanted = queries.select("qid", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("qid", "w").agg(F.count("*").alias("times"))
    terms = wanted.select("w").distinct()
    idf = idf.join(terms, "w", "left_semi").crossJoin(F.broadcast(mean))
    idf = idf.select("w", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avgdl")
    tf = parts.select("id", F.size("w").alias("dl"), F.explode("w").alias("w")).join(terms, "w", "left_semi").groupBy("id", "dl", "w").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "w").select("id", "w", weight.alias("x")).join(wanted, "w").groupBy("qid", "id").agg(F.round(F.sum(F.col("x") * F.col("times")), 6).alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(first: DataFrame, second: DataFrame, contents: DataFrame, k: int) -> DataFrame:
    """(qid, id, place): the first list's 2k, deduplicated by the first 200 characters, then unseen rows of the second, up to 3k; the first k.

    Lists are (qid, id, rank), a bounded number of rows a query; contents are (id, text).
    """
    heads = contents.select("id", F.substring("text", 1, 200).alias("head"))
    both = first.where(F.col("rank") <= 2 * k).select("qid", "id", F.lit(0).alias("list"), "rank").union(second.where(F.col("rank") <= 2 * k).select("qid", "id", F.lit(1), "rank"))
    seen = Window.partitionBy("qid", "head").orderBy("list", "rank")
    once = heads.join(F.broadcast(both), "id").withColumn("again", F.row_number().over(seen)).where("again = 1")
    place = Window.partitionBy("qid").orderBy("list", "rank")
    return once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= F.least(F.lit(k), F.lit(3 * k))).select("qid", "id", "place")


def pack_budget(ranked_texts: DataFrame, budget: int) -> DataFrame:
    """ranked_texts (qid, rank, size) until the first that would overflow the budget."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked_texts.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= budget)
