"""Queries over keyword graphs, clusters, decision trees and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import pivots
from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators import graph as G
from quillstone.operators import tables as B
from quillstone.operators import trees as R
from quillstone.plans.catalog import register
from quillstone.session import cut, ship
from quillstone.sources import stores
from quillstone.sources.tables import table
from quillstone.streaming import ordered, streams

#: A keyword is a lower-cased word of at least 5 characters that stands in at least 2 documents and at most a fifth of them; each text trusts its 8 most frequent of those.
_KEYWORDS = r"""with t as (select doc_id text_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: length(w) >= 5))) k from documents where text is not null),
f as (select k, count(*) df from t group by k having count(*) >= 2 and count(*) <= greatest(2, 0.2 * (select count(*) from documents where text is not null))),
m as (select text_id, k from (select text_id, k, row_number() over (partition by text_id order by df desc, k) r from t join f using (k)) where r <= 8),
e as (select a.k k1, b.k k2, count(*) weight from m a join m b on a.text_id = b.text_id and a.k <> b.k group by all)"""


def _members(spark, sf_dir):
    return _numbered_members(spark, sf_dir).select("text_id", "k")


def _numbered_members(spark, sf_dir):
    """(text_id, k, r): the keywords that each text trusts, by place."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return G.trusted_keywords(texts)


def _strong(spark, sf_dir):
    return G.adjacency(_members(spark, sf_dir)).where("weight >= 2")


@register("keyword_adjacency", _KEYWORDS + " select k1, k2, weight from e where weight >= 2")
def keyword_adjacency(spark, sf_dir):
    return _strong(spark, sf_dir)


@register("degree_hist", _KEYWORDS + ", d as (select k1, count(*) degree from e where weight >= 2 group by 1) select degree, count(*) nodes from d group by 1")
def degree_hist(spark, sf_dir):
    return G.degrees(_strong(spark, sf_dir))


_TOP = ", a as (select k1, k2, weight, row_number() over (partition by k1 order by weight desc, k2) as rank from e where weight >= 2)"


@register("topk_adjacent", _KEYWORDS + _TOP + " select k1, k2, weight, rank from a where rank <= 3")
def topk_adjacent(spark, sf_dir):
    return G.top_adjacent(_strong(spark, sf_dir), 3)


@register("graph_export", _KEYWORDS + " select k1, k2, weight from e where weight >= 2 and k1 < k2")
def graph_export(spark, sf_dir):
    return stores.export_edges(_strong(spark, sf_dir)).select("k1", "k2", "weight")


@register("connection_cap", _KEYWORDS + ", n as (select (count(*) * 0.005)::int most from documents where text is not null), r as (select m.*, rank() over (partition by k order by text_id desc) r from m) select text_id, k from r, n where r <= greatest(most, 1)")
def connection_cap(spark, sf_dir):
    n = table(spark, sf_dir, "documents").where("text is not null").count()
    scores = _members(spark, sf_dir).withColumn("u", F.col("text_id").cast("double"))
    return G.cap_connections(scores, n, max(1, round(n * 0.005)) / n + 1e-9).select("text_id", "k")


@register(
    "graph_search",
    r"""with w as (select vec_id % 50 text_id, vec_id k, label from embeddings),
q as (select * from w where k % 20 = 0),
st as (select k qid, text_id from q),
sk as (select q.k qid, w.k from q join w on q.label = w.label and w.text_id = (q.text_id + 1) % 50),
tk as (select k, text_id, row_number() over (partition by k order by text_id) as rank from w),
adj as (select a.k k1, b.k k2, row_number() over (partition by a.k order by b.k) as rank from w a join w b on a.label = b.label and a.text_id = b.text_id and a.k <> b.k),
dir as (select qid, text_id, -1 via from st),
near as (select qid, text_id, k via from sk join tk using (k) where rank <= 2),
bey as (select distinct qid, k2 k from sk join adj on k = k1 where rank <= 3),
bey2 as (select * from bey where not exists (select 1 from sk where sk.qid = bey.qid and sk.k = bey.k)),
far as (select qid, text_id, k via from bey2 join tk using (k) where rank <= 1)
select qid, text_id, list_sort(list(distinct via)) via from (select * from dir union all select * from near union all select * from far) group by all""",
)
def graph_search(spark, sf_dir):
    w = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("text_id"), F.col("vec_id").alias("k"), "label")
    q = w.where("k % 20 = 0").withColumnRenamed("k", "qid")
    rank_text = Window.partitionBy("k").orderBy("text_id")
    return G.search(
        q.select("qid", "text_id"),
        q.select("qid", "label", ((F.col("text_id") + 1) % 50).alias("text_id")).join(w, ["label", "text_id"]).select("qid", "k"),
        w.select("k", "text_id", F.row_number().over(rank_text).alias("rank")),
        G.first_adjacent(w, ["label", "text_id"]),
    )


_WORDS = r"w as (select w from (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: length(w) between 4 and 24))) w from documents where text is not null) group by w having count(*) >= 5)"


@register("keyword_containment_prune", f"with {_WORDS} select w from w a where not exists (select 1 from w b where contains(a.w, b.w) and a.w <> b.w)")
def keyword_containment_prune(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: F.length(w).between(4, 24)))
    t = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(words).alias("w"))
    return G.prune_containing(t.groupBy("w").agg(F.count("*").alias("n")).where("n >= 5").select("w"))


@register(
    "near_copy_removal",
    """with s as (select doc_id id, substr(sha256(text), 1, 16) h, length(text) tokens from documents where text is not null),
p as (select a.id a, b.id b from s a join (select h, max(id) id from s group by h) b on a.h = b.h and a.id < b.id),
g as (select distinct case when x.tokens >= y.tokens then x.id else y.id end id from p join s x on p.a = x.id join s y on p.b = y.id)
select id, tokens from s where id not in (select id from g)""",
)
def near_copy_removal(spark, sf_dir):
    s = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), T.sha16(F.col("text")).alias("h"), F.length("text").alias("tokens"))
    last = s.groupBy("h").agg(F.max("id").alias("b"))
    pairs = s.join(last, "h").where("id < b").select(F.col("id").alias("a"), "b")
    return G.drop_near_copies(pairs, s.select("id", "tokens"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return G.k_means(_vectors(spark, sf_dir), 8)


def _neighbours(spark, sf_dir, k=8):
    """Each stated query row's nearest rows, as a graph."""
    ship(spark)
    rows = _vectors(spark, sf_dir)
    near = V.top_k(rows.where("id % 20 = 0"), rows, k, skip_self=True)
    return G.laplace_edges(near.select(F.col("qid").alias("a"), F.col("id").alias("b"), (1 - F.col("score")).alias("d")))


@register("pic_clusters")
def pic_clusters(spark, sf_dir):
    return G.power_iteration(_neighbours(spark, sf_dir), 4)


@register("label_propagation")
def label_propagation(spark, sf_dir):
    """The labels of every 20th row, spread over the graph of each row's nearest rows."""
    rows = _vectors(spark, sf_dir)
    near = pivots.search(rows, pivots.build(rows), 8, skip_self=True).found
    edges = G.laplace_edges(near.select(F.col("qid").alias("a"), F.col("id").alias("b"), (1 - F.col("score")).alias("d")))
    seeds = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("node"), "label", F.lit(1.0).alias("u"))
    return G.strongest(G.propagate_labels(cut(edges), seeds))  # the search runs once, not in every round


# --- decision trees: inline documents ---

_TREES = [
    ("t1", '{"tree_id":"t1","name":"Claim","root_node_id":"root","nodes":{"root":{"node_type":"root","question":"Covered?","left_child":"no","right_child":"age-check.long name"},"no":{"node_type":"leaf","answer":"Rejected"},"age-check.long name":{"node_type":"decision","question":"Under 60?","left_child":"missing","right_child":"yes"},"yes":{"node_type":"leaf","answer":"Paid"}}}'),
    ("t2", '{"tree_id":"t2","name":"List","root_node_id":"a","nodes":[{"node_id":"a","node_type":"root","question":"Go?","left_child":"b","right_child":"c"},{"node_id":"b","node_type":"leaf","answer":"No"},{"node_id":"c","node_type":"leaf","answer":"Yes"}]}'),
]


def _tree_nodes(spark):
    return R.nodes(spark.createDataFrame(_TREES, "tree_id string, json string"))


@register("tree_edges", "select * from (values ('t1', 'root', 'no', 'No'), ('t1', 'root', 'age-check.long name', 'Yes'), ('t1', 'age-check.long name', 'yes', 'Yes'), ('t2', 'a', 'b', 'No'), ('t2', 'a', 'c', 'Yes')) t(tree_id, parent, child, label)")
def tree_edges(spark, sf_dir):
    return R.edges(_tree_nodes(spark))


@register("tree_paths", "select * from (values ('t1', 'root', 0, 'root'), ('t1', 'no', 1, 'root/No/no'), ('t1', 'age-check.long name', 1, 'root/Yes/age-check.long name'), ('t1', 'yes', 2, 'root/Yes/age-check.long name/Yes/yes'), ('t2', 'a', 0, 'a'), ('t2', 'b', 1, 'a/No/b'), ('t2', 'c', 1, 'a/Yes/c')) t(tree_id, node, depth, path)")
def tree_paths(spark, sf_dir):
    nodes = _tree_nodes(spark)
    return R.paths(nodes, R.edges(nodes))


@register("tree_mermaid")
def tree_mermaid(spark, sf_dir):
    nodes = _tree_nodes(spark)
    return R.mermaid(nodes, R.edges(nodes))


@register("page_tables")
def page_tables(spark, sf_dir):
    ship(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return B.stitched(pages)


# --- streams: the batch answer is the oracle ---


@register("stream_window_counts", "select date_trunc('day', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def stream_window_counts(spark, sf_dir):
    found = streams.drain(streams.window_counts(streams.event_stream(spark, sf_dir)))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    "stream_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) sid from e)
select user_id, min(ts) as start, count(*) n from s group by user_id, sid""",
)
def stream_sessions(spark, sf_dir):
    found = streams.drain(streams.sessions(streams.event_stream(spark, sf_dir)))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_rate_cap")
def stream_rate_cap(spark, sf_dir):
    return streams.drain(streams.rate_cap(streams.event_stream(spark, sf_dir)), "append")


@register("stream_key_health")
def stream_key_health(spark, sf_dir):
    return streams.drain(streams.key_health(streams.event_stream(spark, sf_dir)), "append")


_CLOSED = "select * from events where ts <= (select max(ts) from events) - interval 1 hour"


@register(
    "stream_ordered_health",
    f"""with o as (select *, event_type in ('error', 'rate_error') bad, row_number() over (partition by user_id order by ts, event_id) i from ({_CLOSED})),
g as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) island from o),
s as (select *, count(*) filter (bad) over (partition by user_id, coalesce(island, 0) order by i rows between unbounded preceding and 1 preceding) streak from g),
u as (select *, case when bad then epoch_us(ts) / 1e6 + 60 * least(2 * (streak + 1), 30) end until from s),
l as (select *, last_value(until ignore nulls) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) cool from u)
select user_id, event_id, streak < 3 and epoch_us(ts) / 1e6 >= coalesce(cool, 0) healthy from l""",
)
def stream_ordered_health(spark, sf_dir):
    """Each key's state just before each event that the watermark has passed, in the order of time."""
    found = streams.drain(ordered.in_order(streams.event_stream(spark, sf_dir), ordered.KEY_HEALTH), "append")
    return found.withColumnRenamed("answer", "healthy")


@register(
    "stream_ordered_cap",
    f"""with recursive o as (select *, row_number() over (partition by user_id order by ts, event_id) i from ({_CLOSED})),
r as (select user_id, event_id, i, ts begun, 1 used from o where i = 1
  union all select o.user_id, o.event_id, o.i, case when o.ts - r.begun >= interval 60 seconds then o.ts else r.begun end, case when o.ts - r.begun >= interval 60 seconds then 1 else r.used + 1 end
  from r join o on o.user_id = r.user_id and o.i = r.i + 1)
select user_id, event_id, used <= 60 allowed from r""",
)
def stream_ordered_cap(spark, sf_dir):
    found = streams.drain(ordered.in_order(streams.event_stream(spark, sf_dir), ordered.RATE_CAP), "append")
    return found.withColumnRenamed("answer", "allowed")
