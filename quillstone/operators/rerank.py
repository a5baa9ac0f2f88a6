"""Structure-aware re-ranking of typed chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.numbering import numbered
from quillstone.session import ship

# --- fixed values: weights by element type and boosts by question type ---
WEIGHTS = {"complete_table": 1.0, "table_row": 0.9, "table_cell": 0.8, "footnote": 1.2, "text": 0.7}
BOOSTS = {
    "monetary": {"complete_table": 1.3, "table_row": 1.4, "table_cell": 1.5, "footnote": 1.1, "text": 0.8},
    "condition": {"complete_table": 1.1, "table_row": 1.1, "table_cell": 0.9, "footnote": 1.6, "text": 1.0},
    "coverage": {"complete_table": 1.4, "table_row": 1.3, "table_cell": 1.2, "footnote": 1.2, "text": 0.9},
    "general": {"complete_table": 1.1, "table_row": 1.0, "table_cell": 0.9, "footnote": 1.1, "text": 1.0},
}
PRIORITY = {"footnote": 4, "complete_table": 3, "table_row": 2, "table_cell": 1, "text": 0}
QUOTA = {"footnote": 2, "complete_table": 2, "table_row": 1, "table_cell": 1, "text": 1}
# --- end of fixed values ---


def pick(col: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def boost(question: Column, element: Column) -> Column:
    out = F.lit(1.0)
    for kind, row in BOOSTS.items():
        out = F.when(question == kind, pick(element, row, 1.0)).otherwise(out)
    return out


def priority_sorted(chunks: DataFrame, k: int) -> DataFrame:
    """chunks (qid, ord, element_type, importance): by type priority, importance, input order; the first k a question."""
    w = Window.partitionBy("qid").orderBy(pick(F.col("element_type"), PRIORITY, 0).desc(), F.coalesce("importance", F.lit(0.0)).desc(), "ord")
    return chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def diversity_penalty(chunks: DataFrame) -> DataFrame:
    """(qid, ord, penalty): for every earlier chunk of the question .02 for the same type, .05 for the same table, .1 times the likeness of heads; at most .3."""
    own = chunks.select("qid", "ord", F.coalesce("element_type", F.lit("text")).alias("et"), F.coalesce("table_id", F.lit("none")).alias("tid"), T.token_set(F.substring("content", 1, 200)).alias("tok"))
    a, b = own.alias("a"), own.alias("b")
    pair = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("b.ord") < F.col("a.ord")), "left")
    each = (
        F.when(F.col("a.et") == F.col("b.et"), 0.02).otherwise(0.0)
        + F.when((F.col("a.tid") == F.col("b.tid")) & (F.col("a.tid") != "none"), 0.05).otherwise(0.0)
        + T.jaccard(F.col("a.tok"), F.col("b.tok")) * 0.1
    )
    return pair.groupBy(F.col("a.qid").alias("qid"), F.col("a.ord").alias("ord")).agg(F.least(F.lit(0.3), F.coalesce(F.sum(F.when(F.col("b.ord").isNotNull(), each)), F.lit(0.0))).alias("penalty"))


def reranked(chunks: DataFrame, k: int) -> DataFrame:
    """chunks (qid, ord, question, content, element_type, table_id, parent_id, has_money) with final scores and quota picks, the first k a question.

    Lists of at most k are returned as they came.
    """
    w = Window.partitionBy("qid")
    kind = F.coalesce(F.col("element_type"), F.lit("text"))
    c = (
        chunks.withColumn("n", F.count("*").over(w))
        .withColumn("et", kind)
        .withColumn("qt", T.question_type(F.col("question")))
        .withColumn("overlap", F.size(F.array_intersect(T.token_set(F.col("question")), T.token_set(F.col("content")))))
        .withColumn("base", T.jaccard(T.token_set(F.col("question")), T.token_set(F.col("content"))))
    )
    family, kin = Window.partitionBy("qid", "table_id"), Window.partitionBy("qid", "parent_id")
    in_table = F.col("table_id").isNotNull() & F.col("et").isin("table_row", "table_cell")
    relevant = F.when(F.col("overlap") >= 2, 1).otherwise(0)
    c = c.withColumn("family", F.count("*").over(family)).withColumn("related", F.sum(relevant).over(family))
    c = c.withColumn("siblings", F.count("*").over(kin)).withColumn("sibling_hits", F.sum(relevant).over(kin))
    paid = (F.col("qt") == "monetary") & (F.coalesce(F.col("has_money"), F.lit(False)) | F.col("content").rlike(r"\b\d+\s*%"))
    score = (
        F.col("base")
        * pick(F.col("et"), WEIGHTS, 1.0)
        * boost(F.col("qt"), F.col("et"))
        * F.when(in_table & (F.col("family") > 3), 1.1).otherwise(1.0)
        * F.when(in_table & (F.col("related") > 1), 1.15).otherwise(1.0)
        * F.when(F.col("parent_id").isNotNull() & (F.col("siblings") > 1) & (F.col("sibling_hits") > 1), 1.1).otherwise(1.0)
        * F.when(paid, F.when(F.col("et") == "table_cell", 1.2).when(F.col("et").isin("table_row", "complete_table"), 1.05).otherwise(1.0)).otherwise(1.0)
    )
    c = c.withColumn("raw", score).join(diversity_penalty(chunks), ["qid", "ord"])
    c = c.withColumn("score", F.round(F.col("raw") * (1 - F.col("penalty")), 6))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "ord")
    c = c.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= 2 * k) | (F.col("n") <= k))
    return quota(c, k)


def quota(c: DataFrame, k: int) -> DataFrame:
    """c (qid, ord, n, et, score, rank): each type's quota in priority order while slots remain, then by score."""
    of_type = Window.partitionBy("qid", "et").orderBy("rank")
    c = c.withColumn("nth", F.row_number().over(of_type))
    chosen = F.col("nth") <= pick(F.col("et"), QUOTA, 0)
    turn = F.when(chosen, -pick(F.col("et"), PRIORITY, -1)).otherwise(F.lit(9))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("n") <= k, F.lit(0)).otherwise(turn), F.when(F.col("n") <= k, F.col("ord")).otherwise(F.col("rank")))
    return c.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def context(chunks: DataFrame) -> DataFrame:
    """(qid, context): contents under headings in the fixed order table, row, cell, footnote, text."""
    turn = pick(F.col("element_type"), {"complete_table": 0, "table_row": 1, "table_cell": 2, "footnote": 3, "text": 4}, 4)
    rows = chunks.select("qid", F.struct(turn.alias("turn"), F.col("ord"), F.concat(F.lit("["), F.upper(F.coalesce("element_type", F.lit("text"))), F.lit("] "), F.col("content")).alias("line")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("context"))


def rerank_failover(candidates: DataFrame, services: list[DataFrame], k: int) -> DataFrame:
    """candidates (qid, id, rank, score) by the first service that answers a query, best ``k``; without an answer, in their own order.

    Each service is (qid, idx, score): scores by the candidate's place from 0, as rerankers answer. Places
    that no candidate has are left out. ``service`` is the number of the service used, null where none answered.
    """
    out = candidates.withColumn("idx", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")) - 1)
    answered = [s.select("qid").distinct().withColumn(f"has{i}", F.lit(True)) for i, s in enumerate(services)]
    for i, s in enumerate(services):
        out = out.join(answered[i], "qid", "left").join(s.select("qid", "idx", F.col("score").alias(f"by{i}")), ["qid", "idx"], "left")
    used = F.coalesce(*[F.when(F.col(f"has{i}"), F.lit(i)) for i in range(len(services))], F.lit(None).cast("int"))
    by = F.coalesce(*[F.when(F.col("service") == i, F.col(f"by{i}")) for i in range(len(services))], F.lit(None).cast("double"))
    out = out.withColumn("service", used).withColumn("again", by).where("service is null or again is not null")
    place = Window.partitionBy("qid").orderBy(F.when(F.col("service").isNull(), F.lit(0.0)).otherwise(-F.col("again")), "idx")
    return out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("qid", "id", "service", F.coalesce("again", "score").alias("score"), "place")


def priority_batches(topics: DataFrame, size: int) -> DataFrame:
    """topics (topic, priority) with their batch of ``size``, highest priority first, ties by name."""
    return numbered(topics, [], [F.col("priority").desc(), F.col("topic")]).withColumn("batch", F.expr(f"(place - 1) div {size}"))


#: (question, texts) to (place in the texts, score) of those a service answers for; it raises when it can't be reached.
Scorer = Callable[[str, list[str]], list[tuple[int, float]]]


def word_likeness(question: str, texts: list[str]) -> list[tuple[int, float]]:
    """The scorer of last resort: Jaccard of lower-cased words; needs no service and never fails."""
    own = set(question.lower().split())
    sets = [set(t.lower().split()) for t in texts]
    return [(i, len(own & s) / len(own | s) if own and s else 0.0) for i, s in enumerate(sets)]


def _scored(scorers: list[tuple[str, Scorer]], top: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"], kind="stable")
        answer, used = [], None
        for name, scorer in scorers:
            try:
                answer, used = scorer(rows["question"].iloc[0] or "", [t or "" for t in rows["content"]]), name
                break
            except Exception:  # noqa: BLE001  whatever a service raises, the next one is asked
                continue
        ids = rows["id"].tolist()
        best = sorted(((-float(s), i) for i, s in dict(answer).items() if 0 <= i < len(ids)))
        if used is None:
            best = [(0.0, i) for i in range(len(ids))]
        best = best[:top]
        score = [None if used is None else -s for s, _ in best]
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]] * len(best), "id": [ids[i] for _, i in best], "service": [used] * len(best), "score": pd.array(score, "Float64"), "place": range(1, len(best) + 1)}).astype({"qid": "int64", "id": "int64", "place": "int32"})

    return run


def rerank_by(candidates: DataFrame, scorers: dict[str, Scorer], k: int, default: Scorer | None = word_likeness) -> DataFrame:
    """(qid, id, service, score, place) of candidates (qid, question, id, rank, content): the best ``k`` a question by the first service that answers.

    A question's candidates go to a service in one call, in the order of their ranks; a service that raises
    is left for the next one, at last for ``default``. Candidates that the answering service leaves out are left out, as
    services that return their best few do. Where nothing answers, they keep their order and have no score. Ties go by
    rank. A group is one question's candidates, a bounded list.
    """
    ship(candidates.sparkSession)
    order = [*scorers.items(), *([("words", default)] if default else [])]
    rows = candidates.select(F.col("qid").cast("long").alias("qid"), "question", F.col("id").cast("long").alias("id"), F.col("rank").cast("int").alias("rank"), "content")
    return rows.groupBy("qid").applyInPandas(_scored(order, k), "qid long, id long, service string, score double, place int")
