"""Retrieval pipelines by name: one candidate table per run, from which every later step works.

A run takes questions (qid, question, v, doc) and chunks (id, content, v, doc, and for the
structure-aware pipeline element_type, importance, table_id, parent_id, has_money). The candidates of
a question are the nearest chunks of its document. They are written once; the number to keep, keyword scores
(BM25 whose statistics are those of the question's own candidates), the union of both lists
and the re-ranking all read that table. Groups are by question and hold at most as many rows as there are candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import ocr
from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators import knowledge, rerank, search
from quillstone.session import cut


@dataclass(frozen=True)
class Pipeline:
    """How many candidates a question gets: ``least``, or ``each`` times the number to keep; whether structure counts."""

    description: str
    least: int
    each: int
    structured: bool

    def __call__(self, questions: DataFrame, chunks: DataFrame, k: int | None = None) -> Retrieved:
        return Retrieved(self, questions, chunks, k)


class Retrieved:
    """A pipeline's run: ``documents`` are the chunks kept, ``answers`` one row a question, ``candidates`` what they were chosen from."""

    def __init__(self, pipeline: Pipeline, questions: DataFrame, chunks: DataFrame, k: int | None):
        self.pipeline = pipeline
        self.candidates = cut(candidates(questions, chunks, pipeline.least, pipeline.each, k))
        self.combined = combined(self.candidates)
        self.documents = structured(self.combined) if pipeline.structured else self.combined.where("ord <= k").withColumn("place", F.col("ord"))

    def answers(self) -> DataFrame:
        """(qid, k, reason, candidates, keyword_hits, merged, kept) of every question that has candidates."""
        c = self.candidates.groupBy("qid").agg(F.first("k").alias("k"), F.first("reason").alias("reason"), F.count("*").alias("candidates"))
        c = c.withColumn("keyword_hits", F.least("candidates", 2 * F.col("k")))
        merged = self.combined.groupBy("qid").agg(F.count("*").alias("merged"))
        return c.join(merged, "qid").join(self.documents.groupBy("qid").agg(F.count("*").alias("kept")), "qid")


def candidates(questions: DataFrame, chunks: DataFrame, least: int, each: int, k: int | None = None) -> DataFrame:
    """(qid, question, k, reason, id, place, score, then the chunk's columns) of the nearest chunks of each question's document.

    ``k``: how many results every question keeps; without it, as many as the shape of its first scores says.
    """
    most = search.MAX_K if k is None else k
    found = V.top_k(questions.select(F.col("qid").alias("id"), "v", F.col("doc").alias("grp")), chunks.select("id", "v", F.col("doc").alias("grp")), max(least, each * most), same_group=True)
    if k is None:
        found = cut(found)
        kept = search.dynamic_k(found.where(F.col("rank") <= search.MAX_K)).select("qid", F.col("k").cast("int").alias("k"), "reason")
        found = found.join(kept, "qid").where(F.col("rank") <= F.greatest(F.lit(least), each * F.col("k")))
    else:
        found = found.withColumns({"k": F.lit(k), "reason": F.lit("static")})
    found = found.join(questions.select("qid", "question"), "qid").withColumnRenamed("rank", "place")
    return found.join(chunks.drop("v", "doc"), "id").where("content is not null")


def keyword_scores(found: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """found (qid, question, id, place, content) with ``bm25`` and ``keyword_rank``: BM25 inside each question's candidates.

    Document frequencies, the mean length and the floor of negative weights are those of the question's candidates.
    Words are moved once, by question and word; then counts of a word in a chunk and chunks of a word need no further
    shuffle. Ties, and candidates without a word of the question, go by their place.
    """
    own = Window.partitionBy("qid")
    sized = found.select("qid", "question", "id", "place", T.tokens(F.col("content")).alias("w")).withColumn("dl", F.size("w"))
    sized = sized.withColumns({"n": F.count("*").over(own), "avgdl": F.avg("dl").over(own)})
    words = sized.select("qid", "id", "dl", "n", "avgdl", F.explode("w").alias("w")).repartition("qid", "w")
    tf = words.groupBy("qid", "w", "id", "dl", "n", "avgdl").agg(F.count("*").alias("tf"))
    word = Window.partitionBy("qid", "w")
    tf = tf.withColumns({"df": F.count("*").over(word), "first": F.row_number().over(word.orderBy("id")) == 1})
    tf = tf.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = tf.where("first").groupBy("qid").agg((F.avg("idf") * epsilon).alias("floor"))
    asked = found.select("qid", "question").distinct().select("qid", F.explode(T.tokens(F.col("question"))).alias("w")).groupBy("qid", "w").agg(F.count("*").alias("times"))
    hit = tf.join(asked, ["qid", "w"]).join(floor, "qid")
    idf = F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("times")
    scores = hit.groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("bm25"))
    out = found.join(scores, ["qid", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return out.withColumn("keyword_rank", F.row_number().over(own.orderBy(F.col("bm25").desc(), "place")))


def combined(found: DataFrame) -> DataFrame:
    """The first 2k by similarity, then unseen ones of the first 2k by keywords, up to 3k, as ``ord``; chunks whose first 200 characters were seen before are left out."""
    scored = keyword_scores(found)
    by_vector, by_word = F.col("place") <= 2 * F.col("k"), F.col("keyword_rank") <= 2 * F.col("k")
    turn = F.when(by_vector, F.struct(F.lit(0).alias("list"), F.col("place").alias("at"))).otherwise(F.struct(F.lit(1).alias("list"), F.col("keyword_rank").alias("at")))
    both = scored.where(by_vector | by_word).withColumn("turn", turn).withColumn("head", F.substring("content", 1, 200))
    seen = Window.partitionBy("qid", "head").orderBy("turn")
    once = both.withColumn("again", F.row_number().over(seen)).where("again = 1")
    out = once.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("turn"))).where("ord <= 3 * k")
    return out.drop("turn", "head", "again")


def structured(merged: DataFrame) -> DataFrame:
    """The merged list in order of element types and importance, re-ranked with tables and cells in mind; lists of at most k stay in that order."""
    kind = rerank.pick(F.col("element_type"), rerank.PRIORITY, 0)
    first = Window.partitionBy("qid").orderBy(kind.desc(), F.coalesce("importance", F.lit(0.0)).desc(), "ord")
    sorted_ = merged.withColumn("ord", F.row_number().over(first)).drop("score", "bm25", "keyword_rank", "place")
    return rerank.reranked(sorted_, F.col("k"))


def proxy(place: Column) -> Column:
    """The score that a place in the final list stands for."""
    return F.round(1 - F.lit(0.05) * (place - 1), 6)


# --- fixed values: how kept chunks are marked for the answer ---
TAGS = {
    "complete_table": ("[COMPLETE TABLE - ", "Policy Table", "]", "[/COMPLETE TABLE]"),
    "table_row": ("[TABLE ROW - ", "Unknown Table", "]", "[/TABLE ROW]"),
    "table_cell": ("[TABLE CELL - ", "Cell", "]", "[/TABLE CELL]"),
    "footnote": ("[FOOTNOTE ", "*", "]", "[/FOOTNOTE]"),
}
TEXT_TAGS = ("[POLICY TEXT]", "[/POLICY TEXT]")
# --- end of fixed values ---


def tagged_context(documents: DataFrame) -> DataFrame:
    """(qid, context): the kept chunks (qid, place, content, element_type, label) by type under their marks, texts last in one block.

    ``label`` names a chunk (its table, cell or footnote); null gives the type's own name.
    """
    kind = F.coalesce("element_type", F.lit("text"))
    marked = F.col("content")
    for name, (opened, unnamed, closed, end) in TAGS.items():
        whole = F.concat(F.lit(opened), F.coalesce("label", F.lit(unnamed)), F.lit(closed + "\n"), F.col("content"), F.lit("\n" + end + "\n"))
        marked = F.when(kind == name, whole).otherwise(marked)
    marked = F.when(kind == "text", F.concat("content", F.lit("\n"))).otherwise(marked)
    turn = rerank.pick(kind, {name: i for i, name in enumerate([*TAGS, "text"])}, len(TAGS) + 1)
    rows = documents.select("qid", F.struct(turn.alias("turn"), F.col("place"), marked.alias("part")).alias("x")).where(f"x.turn <= {len(TAGS)}")
    parts = rows.groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("x"))
    of = lambda cond: F.transform(F.filter("x", cond), lambda x: x["part"])
    texts, others = of(lambda x: x["turn"] == len(TAGS)), of(lambda x: x["turn"] < len(TAGS))
    block = F.when(F.size(texts) > 0, F.array(F.lit(TEXT_TAGS[0]))).otherwise(F.array().cast("array<string>"))
    close = F.when(F.size(texts) > 0, F.array(F.lit(TEXT_TAGS[1]))).otherwise(F.array().cast("array<string>"))
    return parts.select("qid", F.array_join(F.concat(others, block, texts, close), "\n").alias("context"))


def prompts(documents: DataFrame) -> DataFrame:
    """(qid, prompt): which instructions fit a question and the types of its kept chunks."""
    of = lambda *kinds: F.sum(F.coalesce("element_type", F.lit("text")).isin(*kinds).cast("int"))
    counts = documents.groupBy("qid").agg(F.first("question").alias("question"), of("complete_table", "table_row", "table_cell").alias("tables"), of("footnote").alias("footnotes"))
    return counts.select("qid", ocr.prompt_kind(F.col("question"), F.col("tables"), F.col("footnotes")).alias("prompt"))


TRADITIONAL = Pipeline("similarity and keywords", 50, 3, False)
STRUCTURE_AWARE = Pipeline("similarity and keywords, re-ranked by tables and cells", 60, 4, True)
knowledge.register_pipeline("traditional", TRADITIONAL)
knowledge.register_pipeline("structure_aware", STRUCTURE_AWARE)
