"""Queries of the composed retrieval pipelines.

Chunks are documents that have a vector (vec_id is doc_id); their document is the vector's label. The type,
table and section of a chunk come from its text and columns. A question is a benchmark text with
the vector of 20 times its id, asked inside that vector's document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import ocr
from quillstone.operators import knowledge, pipelines, rerank
from quillstone.plans.catalog import register
from quillstone.plans.retrieval import _BOOST_SQL, _QTYPE, _SET, _WORDS, STEP, _case
from quillstone.session import ship
from quillstone.sources.tables import table


def _chunks(spark, sf_dir):
    c = F.col("text")
    kind = (
        F.when(F.contains(c, F.lit("|")) & (F.length(c) < 2000), "table_row")
        .when(F.contains(c, F.lit("|")), "complete_table")
        .when(F.contains(c, F.lit("%")), "footnote")
        .when(F.length(c) < 250, "table_cell")
        .otherwise("text")
    )
    docs = table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), kind.alias("element_type"), (F.regexp_count(c, F.lit("[0-9]")) / 10).alias("importance"), F.col("source").alias("table_id"), F.concat("source", F.lit("/"), "lang").alias("parent_id"), c.rlike("₹|Rs|INR").alias("has_money"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("doc"))
    return vectors.join(docs, "id")


def _questions(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * STEP).alias("id"), F.col("item_id").alias("qid"), F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("doc"))
    return items.join(vectors, "id").drop("id")


def _run(spark, sf_dir, name, k=None):
    ship(spark)
    return knowledge.pipeline(name)(_questions(spark, sf_dir), _chunks(spark, sf_dir), k)


def _retrieve(least: int, each: int) -> str:
    """Up to the merged list: mg (qid, id, ord, ...)."""
    return f"""with ch as materialized (
  select doc_id id, text content, source tid, source || '/' || lang pid, len(regexp_extract_all(text, '[0-9]')) / 10 importance, embedding, e.label doc,
    case when contains(text, '|') and length(text) < 2000 then 'table_row' when contains(text, '|') then 'complete_table' when contains(text, '%') then 'footnote' when length(text) < 250 then 'table_cell' else 'text' end et
  from documents join embeddings e on doc_id = vec_id where text is not null),
qu as (select item_id qid, text question, embedding, e.label doc from benchmark join embeddings e on vec_id = item_id * {STEP}),
s as (select qid, question, ch.id, round(list_cosine_similarity(qu.embedding::double[], ch.embedding::double[]), 6) score from qu join ch using (doc)),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s),
t as (select qid, rank, score, lag(score) over (partition by qid order by rank) before from r where rank <= 15),
dr as (select *, case when before is null then null when before <= 0 then 1.0 else (before - score) / before end as drop from t),
e as (select *, sum(drop) over (partition by qid order by rank rows unbounded preceding) lost, first_value(score) over (partition by qid order by rank) best from dr),
g as (
  select qid, count(*) n, avg(drop) mean_drop,
    min(case when rank >= 4 and drop >= (case when best > 0.8 then 0.08 else 0.1 end) then rank end) cliff,
    min(case when rank >= 4 and score < best * (case when best > 0.8 then 0.75 else 0.7 end) then rank end) weak,
    min(case when rank >= 4 and lost > 0.25 then rank end) spent
  from e group by qid),
h as (select *, least(cliff, weak, spent) f from g),
dk as (select qid, case when n <= 1 then 4 else greatest(4, least(coalesce(f, case when mean_drop < 0.03 then least(n, 12) when mean_drop < 0.06 then 8 else 6 end), 15, n)) end k,
  case when n <= 1 then 'insufficient_data' when f is null then 'average_drop' when cliff = f then 'relative_drop' when weak = f then 'score_threshold' else 'cumulative_loss' end reason from h),
ca as materialized (select r.qid, question, k, reason, r.id, rank place, score, content, tid, pid, importance, et from r join dk using (qid) join ch using (id) where rank <= greatest({least}, {each} * k)),
cw as materialized (select qid, id, {_WORDS('content')} w from ca),
cs as (select qid, count(*) n, avg(len(w)) avgdl from cw group by 1),
tf as (select qid, id, dl, w, count(*) tf from (select qid, id, len(w) dl, unnest(w) w from cw) group by all),
df as (select qid, w, count(*) df from tf group by all),
i0 as (select qid, w, avgdl, ln((n - df + 0.5) / (df + 0.5)) idf from df join cs using (qid)),
fl as (select qid, avg(idf) * 0.25 f from i0 group by 1),
qw as (select qid, w, count(*) times from (select qid, unnest({_WORDS('question')}) w from qu) group by all),
sc as (select qid, id, round(sum((case when idf < 0 then f else idf end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) bm25
  from tf join i0 using (qid, w) join fl using (qid) join qw using (qid, w) group by all),
kr as (select ca.*, coalesce(bm25, 0.0) bm25, row_number() over (partition by ca.qid order by coalesce(bm25, 0.0) desc, place) keyword_rank from ca left join sc using (qid, id)),
ul as (select *, case when place <= 2 * k then 0 else 1 end list, case when place <= 2 * k then place else keyword_rank end pos from kr where place <= 2 * k or keyword_rank <= 2 * k),
un as (select *, row_number() over (partition by qid, substr(content, 1, 200) order by list, pos) again from ul),
mg as materialized (select * from (select *, row_number() over (partition by qid order by list, pos) ord from un where again = 1) where ord <= 3 * k)"""


@register(
    "traditional_retrieve",
    _retrieve(50, 3) + " select qid, id, ord as place, bm25, round(1 - 0.05::double * (ord - 1), 6) proxy from mg where ord <= k",
)
def traditional_retrieve(spark, sf_dir):
    return _run(spark, sf_dir, None).documents.select("qid", "id", "place", "bm25", pipelines.proxy(F.col("place")).alias("proxy"))


@register(
    "traditional_stats",
    _retrieve(50, 3)
    + """ select qid, any_value(k) k, any_value(reason) reason, (select count(*) from ca where ca.qid = mg.qid) candidates, least((select count(*) from ca where ca.qid = mg.qid), 2 * any_value(k)) keyword_hits,
  count(*) merged, count(*) filter (ord <= k) kept from mg group by qid""",
)
def traditional_stats(spark, sf_dir):
    return _run(spark, sf_dir, "traditional").answers()


_STRUCTURED = (
    _retrieve(60, 4)
    + f""",
o as (select *, row_number() over (partition by qid order by {_case('et', rerank.PRIORITY, 0)} desc, coalesce(importance, 0) desc, ord) so from mg),
c as (select qid, k, id, so ord, question, content, et, tid, pid, regexp_matches(content, '₹|Rs|INR') money, {_SET('question')} qs, {_SET('content')} cs, {_SET('substr(content, 1, 200)')} hs from o),
pn as (
  select a.qid, a.ord, least(0.3, coalesce(sum(case when b.ord is not null then (case when a.et = b.et then 0.02 else 0.0 end) + (case when coalesce(a.tid, 'none') = coalesce(b.tid, 'none') and coalesce(a.tid, 'none') <> 'none' then 0.05 else 0.0 end)
    + 0.1 * (case when len(a.hs) = 0 or len(b.hs) = 0 then 0.0 else len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))) end) end), 0.0)) penalty
  from c a left join c b on a.qid = b.qid and b.ord < a.ord group by 1, 2),
c1 as (select c.*, {_QTYPE.replace('lower(text)', 'lower(question)')} qt, len(list_intersect(qs, cs)) common, count(*) over (partition by qid) n from c),
c2 as (select *, case when len(qs) = 0 or len(cs) = 0 then 0.0 else common / (len(qs) + len(cs) - common) end base,
  count(*) over (partition by qid, tid) family, sum(case when common >= 2 then 1 else 0 end) over (partition by qid, tid) related,
  count(*) over (partition by qid, pid) siblings, sum(case when common >= 2 then 1 else 0 end) over (partition by qid, pid) sib from c1),
c3 as (select c2.*, round(base * {_case('et', rerank.WEIGHTS, 1.0)} * {_BOOST_SQL}
  * (case when tid is not null and et in ('table_row', 'table_cell') and family > 3 then 1.1 else 1.0 end)
  * (case when tid is not null and et in ('table_row', 'table_cell') and related > 1 then 1.15 else 1.0 end)
  * (case when pid is not null and siblings > 1 and sib > 1 then 1.1 else 1.0 end)
  * (case when qt = 'monetary' and (money or regexp_matches(content, '\\b\\d+\\s*%')) then (case when et = 'table_cell' then 1.2 when et in ('table_row', 'complete_table') then 1.05 else 1.0 end) else 1.0 end)
  * (1 - penalty), 6) score from c2 join pn using (qid, ord)),
c4 as (select *, row_number() over (partition by qid order by score desc, ord) rk from c3),
c5 as (select *, row_number() over (partition by qid, et order by rk) nth from c4 where rk <= 2 * k or n <= k),
c6 as (select *, row_number() over (partition by qid order by case when n <= k then 0 when nth <= {_case('et', rerank.QUOTA, 0)} then -({_case('et', rerank.PRIORITY, -1)}) else 9 end, case when n <= k then ord else rk end) place from c5),
fin as materialized (select * from c6 where place <= k)"""
)


@register("structure_aware_retrieve", _STRUCTURED + " select qid, id, et element_type, score, place, round(1 - 0.05::double * (place - 1), 6) proxy, et <> 'text' first_class from fin")
def structure_aware_retrieve(spark, sf_dir):
    kept = _run(spark, sf_dir, "structure_aware").documents
    return kept.select("qid", "id", F.col("et").alias("element_type"), "score", "place", pipelines.proxy(F.col("place")).alias("proxy"), (F.col("et") != "text").alias("first_class"))


@register(
    "structure_aware_answers",
    _STRUCTURED
    + f""",
tg as (select qid, place, et, {_case('et', {t: i for i, t in enumerate([*pipelines.TAGS, 'text'])}, 9)} turn, case {' '.join(f"when et = '{t}' then '{a}' || coalesce(tid, '{u}') || '{c}' || chr(10) || content || chr(10) || '{e}' || chr(10)" for t, (a, u, c, e) in pipelines.TAGS.items())} else content || chr(10) end part from fin),
ot as (select qid, string_agg(part, chr(10) order by turn, place) x from tg where turn < 4 group by 1),
tx as (select qid, '{pipelines.TEXT_TAGS[0]}' || chr(10) || string_agg(part, chr(10) order by place) || chr(10) || '{pipelines.TEXT_TAGS[1]}' x from tg where turn = 4 group by 1),
an as (select qid, any_value(k) k, count(*) kept, count(*) filter (et <> 'text') first_class, count(*) filter (et in ('complete_table', 'table_row', 'table_cell')) tables, count(*) filter (et = 'footnote') notes, lower(any_value(question)) low from fin group by 1)
select an.qid, k, kept, first_class, sha256(concat_ws(chr(10), ot.x, tx.x)) context_sha,
  case when tables >= 2 and ({' or '.join(f"contains(low, '{w}')" for w in ocr.TABLE_TERMS)}) then 'table' when notes >= 1 and ({' or '.join(f"contains(low, '{w}')" for w in ocr.FOOTNOTE_TERMS)}) then 'footnote' else 'structure' end prompt
from an left join ot using (qid) left join tx using (qid)""",
)
def structure_aware_answers(spark, sf_dir):
    """What goes to the answering model: the marked context (as its digest) and the prompt's kind."""
    kept = _run(spark, sf_dir, "structure_aware").documents.withColumn("label", F.col("table_id"))
    each = kept.groupBy("qid").agg(F.first("k").alias("k"), F.count("*").alias("kept"), F.sum((F.col("et") != "text").cast("long")).alias("first_class"))
    context = pipelines.tagged_context(kept).select("qid", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha"))
    return each.join(context, "qid").join(pipelines.prompts(kept), "qid")
