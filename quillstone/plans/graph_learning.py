"""Queries over the similarity graph of all vectors: exact neighbours, spectral clusters, labels learned from a few.

Every row is asked for its neighbours; a pivot index saves comparing all pairs where the data allow it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import pivots
from quillstone.operators import graph as G
from quillstone.operators import solvers
from quillstone.plans.catalog import register
from quillstone.plans.graphs import _KEYWORDS, _numbered_members
from quillstone.plans.retrieval import STEP, _sim
from quillstone.session import cut
from quillstone.sources.tables import table

NEIGHBOURS = 10


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("grp"))


def _search(spark, sf_dir, queries: str, k: int, **kind) -> pivots.Search:
    rows = _rows(spark, sf_dir)
    return pivots.search(rows.where(queries), pivots.build(rows), k, **kind)


@register("pivot_topk", _sim() + " select qid, id, score, rank from r where rank <= 15")
def pivot_topk(spark, sf_dir):
    return _search(spark, sf_dir, f"id % {STEP} = 0", 15).found.select("qid", "id", "score", "rank")


@register("pivot_savings")
def pivot_savings(spark, sf_dir):
    """How many pairs of a query and a block of rows exist, and how many were compared to find the same rows."""
    run = _search(spark, sf_dir, f"id % {STEP} = 0", 15)
    return run.found.agg(F.count("*").alias("found")).select("found", F.lit(run.pairs).cast("long").alias("pairs"), F.lit(run.compared).cast("long").alias("compared"))


def _edges(spark, sf_dir):
    near = _search(spark, sf_dir, "true", NEIGHBOURS, skip_self=True).found
    return G.laplace_edges(near.select(F.col("qid").alias("a"), F.col("id").alias("b"), (1 - F.col("score")).alias("d")))


@register(
    "neighbour_graph",
    f"""with s as (
  select q.vec_id qid, d.vec_id id, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) score from embeddings q, embeddings d where q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s),
t as (select qid, id, 1 - score dist, max(1 - score) over (partition by qid) far from r where rank <= {NEIGHBOURS}),
w as (select qid, id, exp(-4 * dist * dist / (far * far)) weight from t where far > 0)
select a, b, round(max(weight), 6) weight from (select qid a, id b, weight from w union all select id, qid, weight from w) group by all""",
)
def neighbour_graph(spark, sf_dir):
    return _edges(spark, sf_dir).select("a", "b", F.round("weight", 6).alias("weight"))


def _graph(spark, sf_dir) -> solvers.Graph:
    return solvers.Graph(_edges(spark, sf_dir), _rows(spark, sf_dir).select(F.col("id").alias("node")))


def _spectral(form: str):
    def run(spark, sf_dir):
        with _graph(spark, sf_dir) as graph:
            return G.spectral_clusters(graph, 8, form, tolerance=1e-3, steps=8)

    return run


for _form in solvers.FORMS:
    register(f"spectral_{_form}")(_spectral(_form))


def _learned(method: str):
    def run(spark, sf_dir):
        seeds = _rows(spark, sf_dir).where(f"id % {STEP} = 0").select(F.col("id").alias("node"), F.col("grp").alias("label"))
        with _graph(spark, sf_dir) as graph:
            return G.learn_labels(graph, seeds, method).select("node", "label", F.round("u", 6).alias("u"))

    return run


for _method in ("laplace", "poisson"):
    register(f"{_method}_learning")(_learned(_method))


# --- texts and keywords: neighbours either way, trusted and negative texts ---

NEAR, FAR, OF_TEXT = 5, 15, 5
#: Vectors of more numbers than this, or of different numbers, are summed number by number.
WIDEST = 256


def _keywords(spark, sf_dir):
    """(id, k, v): the mean of the unit vectors of the texts that hold a keyword, for keywords of at least two such texts.

    A keyword's number is 16 times the least text that holds it, plus its place there, so no two have the same.
    """
    members = _numbered_members(spark, sf_dir)
    rows = _rows(spark, sf_dir).select(F.col("id").alias("text_id"), F.col("v").cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = members.join(rows, "text_id").withColumn("length", length).where("length > 0")
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] == sizes[1] and 0 < sizes[0] <= WIDEST:  # one row for a text's keyword, not one for each of its numbers
        each = [F.round(F.avg(F.col("v")[i] / F.col("length")), 9) for i in range(sizes[0])]
        means = parts.groupBy("k").agg(F.array(*each).alias("v"), F.min(F.expr("text_id * 16 + r")).alias("id"), F.count("*").alias("n"))
        return means.where("n >= 2").select("k", "id", "v")
    parts = parts.select("k", F.expr("text_id * 16 + r").alias("at"), "text_id", F.posexplode(F.transform("v", lambda x: x / F.col("length"))).alias("i", "x"))
    means = parts.groupBy("k", "i").agg(F.round(F.avg("x"), 9).alias("x"), F.min("at").alias("id"), F.count("*").alias("n")).where("n >= 2")
    return means.groupBy("k", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


_VECTORS = (
    _KEYWORDS.replace("m as (select text_id, k from (", "m as (select text_id, k, r from (")
    + """,
u as (select vec_id text_id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) v from embeddings),
pt as (select k, text_id * 16 + r as kid, unnest(v) x, unnest(range(len(v))) i from m join u using (text_id)),
mv as (select k, i, round(avg(x), 9) x, min(kid) id from pt group by k, i having count(*) >= 2),
kv as materialized (select k, id, list(x order by i) v from mv group by k, id),
sk as materialized (select k, kv.id kid, vec_id text_id, round(list_cosine_similarity(kv.v, embedding::double[]), 6) score from kv, embeddings)"""
)


@register(
    "keyword_trust",
    _VECTORS
    + f""",
a as (select k, text_id, score, row_number() over (partition by kid order by score desc, text_id) n, row_number() over (partition by kid order by score, text_id) f from sk)
select k, text_id, 0 label, n as rank, score from a where n <= {NEAR} union all select k, text_id, 1, f, score from a where f <= {FAR}""",
)
def keyword_trust(spark, sf_dir):
    """Of each keyword the nearest texts, and the farthest: those nearest to the opposite of its vector."""
    own = cut(_keywords(spark, sf_dir))
    index = pivots.build(_rows(spark, sf_dir))
    near = pivots.search(own.select("id", "v"), index, NEAR).found.withColumn("label", F.lit(0))
    far = pivots.search(own.select("id", F.transform("v", lambda x: -x).alias("v")), index, FAR).found.withColumns({"score": -F.col("score") + F.lit(0.0), "label": F.lit(1)})
    found = near.unionByName(far).withColumnRenamed("id", "text_id")
    return found.join(own.select(F.col("id").alias("qid"), "k"), "qid").select("k", "text_id", "label", "rank", "score")


@register(
    "text_keywords",
    _VECTORS
    + f""",
a as (select text_id, k, score, row_number() over (partition by text_id order by score desc, kid) as rank from sk),
tt as (select *, acos(greatest(-1.0, least(1.0, score))) d from a where rank <= {OF_TEXT}),
ww as (select *, d * d dd, max(d * d) over (partition by text_id) far from tt),
pp as (select *, case when far > 0 then exp(-4 * dd / far) else 1.0 end weight from ww)
select text_id, k, rank, score, round(weight / sum(weight) over (partition by text_id), 6) prob from pp""",
)
def text_keywords(spark, sf_dir):
    """Of each text the nearest keywords by angle, and their share of the text."""
    own = cut(_keywords(spark, sf_dir))
    found = pivots.search(_rows(spark, sf_dir), pivots.build(own.select("id", "v")), OF_TEXT).found.withColumnRenamed("qid", "text_id")
    square = F.pow(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))), 2)
    text = Window.partitionBy("text_id")
    found = found.withColumn("dd", square).withColumn("far", F.max("dd").over(text))
    found = found.withColumn("weight", F.when(F.col("far") > 0, F.exp(-4 * F.col("dd") / F.col("far"))).otherwise(F.lit(1.0)))
    found = found.withColumn("prob", F.round(F.col("weight") / F.sum("weight").over(text), 6))
    return found.join(own.select("id", "k"), "id").select("text_id", "k", "rank", "score", "prob")
