"""Queries over documents, pages and benchmark: cleaning, features, entities, chunks, web columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import ocr as O
from quillstone.functions import text as T
from quillstone.operators import chunks as C
from quillstone.operators import knowledge as K
from quillstone.operators.numbering import numbered
from quillstone.plans.catalog import register
from quillstone.session import ship
from quillstone.sources import detect as D
from quillstone.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null")


def _quoted(patterns: list[str]) -> list[str]:
    return ["'" + p.replace("'", "''") + "'" for p in patterns]


def _count(column: str, patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all({column}, {p}))" for p in _quoted(patterns))


_WS = r"'[ \t\n\r]+'"


@register("clean_text", rf"select doc_id, sha256(trim(regexp_replace(regexp_replace(text, '///|_x000D_|、', ' ', 'g'), {_WS}, ' ', 'g'))) clean_sha from documents where text is not null")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.clean_text(F.col("text")).cast("binary"), 256).alias("clean_sha"))


@register(
    "line_clean",
    r"""select doc_id, sha256(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> ''),
  lambda x: regexp_replace(x, '[ \t\r]+', ' ', 'g')), chr(10))) clean_sha from documents where text is not null""",
)
def line_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.line_clean(F.col("text")).cast("binary"), 256).alias("clean_sha"))


_NORM = r"regexp_replace(lower({c}), '[ \t\n\r!-/:-@\[-`{{-~]', '', 'g')"


@register(
    "normalise_dedupe",
    f"""select {_NORM.format(c='w')} norm, count(distinct w) spellings, count(*) uses from (
  select unnest(regexp_split_to_array(text, {_WS})) w from documents where text is not null) where w <> '' group by 1""",
)
def normalise_dedupe(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(T.normalise(F.col("w")).alias("norm")).agg(F.count("*").alias("spellings"), F.sum("n").alias("uses"))


def _sanitize_sql(c: str) -> str:
    s = rf"regexp_replace(trim({c}), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]*>', '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        s = f"replace({s}, '{a}', '{b}')"
    for p in T.DANGEROUS:
        s = f"regexp_replace({s}, '(?i){p}', '', 'g')"
    return f"regexp_replace({s}, {_WS}, ' ', 'g')"


@register("sanitize", f"with s as (select page_id, {_sanitize_sql('html')} s from pages where html is not null) select page_id, sha256(case when length(s) > 1000 then rtrim(substr(s, 1, 1000)) else s end) clean_sha from s")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.sha2(T.sanitize(F.col("html")).cast("binary"), 256).alias("clean_sha"))


@register(
    "question_filter",
    f"""with s as (select item_id, {_sanitize_sql('text')} s from benchmark where text is not null),
t as (select item_id, rtrim(case when length(s) > 1000 then rtrim(substr(s, 1, 1000)) else s end) s from s)
select item_id, case when regexp_matches(s, '[.?!]$') then s else s || '?' end question from t where length(trim(s)) >= 3""",
)
def question_filter(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", T.as_question(F.col("text")).alias("question")).where("question is not null")


@register(
    "expanded_queries",
    r"""with l as (select conv_id, turn, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), '^[\d.\-*+\s]*', ''), '^["'']+|["'']+$', '', 'g')) l from conversations where text is not null),
k as (select *, list_filter(l, lambda x: length(x) > 10)[1:3] k from l)
select conv_id, turn, case when len(k) > 0 then k else [text] end queries from k""",
)
def expanded_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", T.expanded_queries(F.col("text"), F.col("text")).alias("queries"))


@register(
    "pdf_garbage",
    "select doc_id, "
    + " + ".join("contains(text, '%s')::int" % m.replace("\n", "' || chr(10) || '") for m in T.PDF_MARKS_MORE)
    + " > 3 garbage, "
    + " + ".join("contains(text, '%s')::int" % m.replace("\n", "' || chr(10) || '") for m in T.PDF_MARKS)
    + " > 0 garbage_strict from documents where text is not null",
)
def pdf_garbage(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.pdf_garbage(F.col("text")).alias("garbage"), T.pdf_garbage(F.col("text"), strict=True).alias("garbage_strict"))


@register(
    "feature_counts",
    f"""select doc_id, {_count('text', T.MONEY)} money, {_count('text', T.EXCLUSION)} exclusions, {_count('text', T.POLICY_TERMS)} terms, {_count('text', T.CROSS_REFERENCES)} refs, {_count('text', T.LISTS)} lists
from documents where text is not null""",
)
def feature_counts(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", *[T.re_count(t, p).alias(n) for n, p in (("money", T.MONEY), ("exclusions", T.EXCLUSION), ("terms", T.POLICY_TERMS), ("refs", T.CROSS_REFERENCES), ("lists", T.LISTS))])


def _all(column: str, patterns: list[str], most: int) -> str:
    return f"flatten([{', '.join(f'regexp_extract_all({column}, {p})' for p in _quoted(patterns))}])[1:{most}]"


@register("feature_lists", f"select doc_id, {_all('text', T.MONEY, 10)} money, {_all('text', T.EXCLUSION, 5)} exclusions, {_all('text', T.POLICY_TERMS, 10)} terms, {_all('text', T.CROSS_REFERENCES, 5)} refs from documents where text is not null")
def feature_lists(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", *[T.re_all(t, p, n).alias(c) for c, p, n in (("money", T.MONEY, 10), ("exclusions", T.EXCLUSION, 5), ("terms", T.POLICY_TERMS, 10), ("refs", T.CROSS_REFERENCES, 5))])


_NOTE_SQL = [rf"(?i)\b{w}\s*:\s*\S" for w in ("Note", "Important", "Attention", "Warning")]
_TABULAR = " or ".join(f"regexp_matches(text, {p})" for p in _quoted(T.TABLES))


@register(
    "importance_score",
    f"""select doc_id, round((1 + ({_count('text', T.MONEY)}) * 2 + ({_count('text', T.POLICY_TERMS)}) * 1.5 + ({_count('text', T.EXCLUSION)}) * 3 + {_count('text', T.CROSS_REFERENCES)}
  + ({_count('text', _NOTE_SQL)}) * 4 + ({_count('text', T.LISTS)}) * 0.5 + case when {_TABULAR} then 5 else 0 end) * (1 + least(length(text) / 1000, 2.0) * 0.2), 6)::double importance
from documents where text is not null""",
)
def importance_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.importance(F.col("text")), 6).alias("importance"))


@register(
    "importance_rank",
    f"""with i as (select doc_id, source, 5 + ({_count('text', T.MONEY)}) * 3 + ({_count('text', T.POLICY_TERMS)}) * 2 + ({_count('text', T.EXCLUSION)}) * 4
  + least((len(regexp_extract_all(text, '\\n')) + len(regexp_extract_all(text, '<tr'))) * 0.5, 5.0) importance from documents where text is not null and length(trim(text)) >= 300)
select doc_id, importance::double importance, row_number() over (partition by source order by importance desc, doc_id desc) chunk_id from i""",
)
def importance_rank(spark, sf_dir):
    kept = _docs(spark, sf_dir).where("length(trim(text)) >= 300").select("doc_id", "source", T.importance(F.col("text"), "table").alias("importance"))
    return numbered(kept, ["source"], [F.col("importance").desc(), F.col("doc_id").desc()], "chunk_id").drop("source")


_ENTITY = ", ".join(f"struct_pack(kind := '{k}', found := list_distinct(regexp_extract_all(text, {_quoted([p])[0]})))" for k, p in T.ENTITIES.items())


@register("mentions_edges", f"with e as (select doc_id, unnest([{_ENTITY}]) e from documents where text is not null), n as (select doc_id, e.kind kind, unnest(e.found) name from e) select doc_id, kind, lower(trim(name)) name, count(*) spellings from n group by all")
def mentions_edges(spark, sf_dir):
    return _mentions(spark, sf_dir)


def _mentions(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(T.entities(F.col("text"))).alias("kind", "names"))
    return found.select("doc_id", "kind", F.explode("names").alias("n")).groupBy("doc_id", "kind", F.lower(F.trim("n")).alias("name")).agg(F.count("*").alias("spellings"))


_M = f"with e as (select doc_id, unnest([{_ENTITY}]) e from documents where text is not null), m as (select distinct doc_id, kind, lower(trim(name)) name from (select doc_id, e.kind kind, unnest(e.found) name from e))"


@register("entity_counts", _M + " select kind, count(distinct name) names, count(distinct doc_id) episodes, count(*) mentions from m group by 1")
def entity_counts(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return m.groupBy("kind").agg(F.countDistinct("name").alias("names"), F.countDistinct("doc_id").alias("episodes"), F.count("*").alias("mentions"))


@register("episode_entities", _M + " select doc_id, list_sort(list(kind || ':' || name)) entities from m group by 1")
def episode_entities(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), "name"))).alias("entities"))


@register("graph_stats", _M + " select label, n from (select 'Episode' label, count(*) n from documents where text is not null union all select 'Entity', count(*) from (select distinct kind, name from m) union all select 'MENTIONS', count(*) from m)")
def graph_stats(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    total = lambda df, label: df.agg(F.lit(label).alias("label"), F.count("*").alias("n"))
    return total(_docs(spark, sf_dir), "Episode").union(total(m.select("kind", "name").distinct(), "Entity")).union(total(m, "MENTIONS"))


@register("substring_search", "select doc_id, source, lang from documents where contains(lower(text), 'license') or contains(lower(source), 'license') or contains(lower(lang), 'license') order by doc_id limit 10")
def substring_search(spark, sf_dir):
    hit = lambda c: F.lower(c).contains("license")
    return table(spark, sf_dir, "documents").where(hit("text") | hit("source") | hit("lang")).orderBy("doc_id").limit(10).select("doc_id", "source", "lang")


@register("section_classes", "select doc_id, " + ", ".join(f"regexp_matches(text, {_quoted([p])[0]}) as is_{k}" for k, p in T.SECTIONS.items()) + " from documents where text is not null")
def section_classes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[F.col("text").rlike(p).alias(f"is_{k}") for k, p in T.SECTIONS.items()])


# --- chunks ---

_FIXED = """with d as (select doc_id, text, greatest(1, ceil((length(text) - 200) / 800.0))::int n from documents where text is not null and text <> ''),
c as (select doc_id, text, unnest(range(n)) i from d)"""


@register("chunk_fixed", _FIXED + " select doc_id, i chunk, i * 800 start, substr(text, i * 800 + 1, 1000) content from c")
def chunk_fixed(spark, sf_dir):
    return C.fixed_windows(_docs(spark, sf_dir))


@register("chunk_stats", _FIXED + " select doc_id, count(*) total_chunks, sum(length(substr(text, i * 800 + 1, 1000)))::bigint chars, max(i) last_index from c group by 1")
def chunk_stats(spark, sf_dir):
    return C.fixed_windows(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum(F.length("content")).alias("chars"), F.max("chunk").alias("last_index"))


def _chunked(make):
    def run(spark, sf_dir):
        ship(spark)
        return C.split_with(_docs(spark, sf_dir), make())

    return run


register("chunk_token")(_chunked(lambda: C.token_windows(make_spans=C.bpe_spans())))
register("chunk_words")(_chunked(C.token_windows))


@register("token_count")
def token_count(spark, sf_dir):
    """Tokens of the public byte-level vocabulary in each text."""
    ship(spark)
    return C.token_counts(_docs(spark, sf_dir))


@register("url_quote", "select item_id, 'https://example.org/screen?query=' || replace(url_encode(text), '%2F', '/') || '&limit=100' url from benchmark")
def url_quote(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.screen_url(F.col("text"), "https://example.org/screen").alias("url"))
register("chunk_recursive")(_chunked(C.recursive))
register("chunk_slide")(_chunked(C.slides))
register("chunk_section")(_chunked(C.sections))
register("chunk_fallback")(_chunked(C.fallback_chars))
register("chunk_budget")(_chunked(C.token_budget))


@register("chunk_policy")
def chunk_policy(spark, sf_dir):
    ship(spark)
    return C.apply_policy(_docs(spark, sf_dir), 1600, C.recursive())


@register("header_split", "select doc_id, 0::bigint as section, text content from documents where text is not null and not regexp_matches(text, '(?m)^#{1,4}\\s+\\S')")
def header_split(spark, sf_dir):
    return C.headers(_docs(spark, sf_dir)).select("doc_id", "section", "content")


_SENT = r"list_filter(regexp_split_to_array(text, '[.!?]+[ \n\t\r]+'), lambda s: trim(s) <> '')"
_LINEAR = f"""with s as (select doc_id, unnest({_SENT}) s, generate_subscripts({_SENT}, 1) - 1 sentence from documents where text is not null),
w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(s), {_WS}), lambda x: x <> '')) w from s),
p as (select *, lag(w) over (partition by doc_id order by sentence) q from w),
d as (select doc_id, sentence, case when q is null then null when len(w) = 0 or len(q) = 0 then 1.0 else round(1 - len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q))), 6) end d from p)"""


def _distances(spark, sf_dir):
    from pyspark.sql import Window

    sentences = F.filter(F.split("text", r"[.!?]+[ \n\t\r]+"), lambda s: F.trim(s) != "")
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(sentences).alias("sentence", "s")).withColumn("w", T.token_set(F.col("s")))
    before = F.lag("w").over(Window.partitionBy("doc_id").orderBy("sentence"))
    rows = rows.withColumn("q", before)
    return rows.select("doc_id", "sentence", F.when(F.col("q").isNotNull(), F.round(1 - T.jaccard(F.col("w"), F.col("q")), 6)).alias("d"))


@register("sentence_distances", _LINEAR + " select doc_id, sentence, d from d")
def sentence_distances(spark, sf_dir):
    return _distances(spark, sf_dir)


@register(
    "semantic_breaks",
    _LINEAR
    + """,
l as (select doc_id, quantile_cont(d, 0.85) lim from d group by 1)
select doc_id, sentence, coalesce(sum(case when d > lim then 1 else 0 end) over (partition by doc_id order by sentence rows unbounded preceding), 0)::bigint grp from d join l using (doc_id)""",
)
def semantic_breaks(spark, sf_dir):
    return C.semantic_groups(_distances(spark, sf_dir)).select("doc_id", "sentence", "grp")


# --- web columns ---


@register("html_strip", "select page_id, sha256(trim(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&nbsp;', ' '))) text_sha from pages where html is not null")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.sha2(T.strip_html(F.col("html")).cast("binary"), 256).alias("text_sha"))


@register("link_extract", "with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) href from pages) select page_id, href, count(*) times from l where href <> '' group by all")
def link_extract(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.where("href <> ''").groupBy("page_id", "href").agg(F.count("*").alias("times"))


@register("page_sections", "select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) title, len(regexp_extract_all(html, '<p>')) paragraphs, len(regexp_extract_all(html, '<li>')) items, length(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) article_chars from pages where html is not null")
def page_sections(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").where("html is not null").select(
        "page_id",
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count(h, F.lit("<p>")).alias("paragraphs"),
        F.regexp_count(h, F.lit("<li>")).alias("items"),
        F.length(F.regexp_extract(h, r"(?s)<article>(.*?)</article>", 1)).alias("article_chars"),
    )


_PRIVATE = " or ".join(f"contains(host, '{p}')" for p in ["localhost", "127.0.0.1", "0.0.0.0", "192.168.", "10.", *[f"172.{i}." for i in range(16, 32)]])


@register(
    "url_host_filter",
    f"""with u as (select page_id, trim(url) u, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host from pages)
select page_id, host, coalesce(length(u) between 10 and 2048 and regexp_matches(u, '(?i)^https?://[^/?#]+') and not ({_PRIVATE}), false) ok from u""",
)
def url_host_filter(spark, sf_dir):
    u = F.trim("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"), T.url_ok(F.col("url")).alias("ok"))


@register(
    "type_detect",
    """with e as (select page_id, lower(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)) ext, html from pages)
select page_id, case when ext = '.pdf' then 'pdf' when ext = '.docx' then 'docx' when ext = '.pptx' then 'pptx' when ext = '.xlsx' then 'xlsx' when ext in ('.jpg', '.jpeg', '.png', '.gif', '.bmp') then 'image'
  when ext = '.zip' then 'zip' when ext in ('.txt', '.text') then 'txt' when ext = '.eml' then 'eml' when starts_with(html, '%PDF') then 'pdf'
  when contains(substr(html, 1, 1000), 'From:') or contains(substr(html, 1, 1000), 'To:') then 'eml' else 'txt' end kind from e""",
)
def type_detect(spark, sf_dir):
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", D.document_type(F.lit(None).cast("string"), F.col("url"), content).alias("kind"))


@register(
    "route",
    """with e as (select page_id, octet_length(encode(coalesce(html, ''))) size, lower(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)) ext, url from pages)
select page_id, size, case when size > 1073741824 then 'oversize' when ext in ('.jpg', '.jpeg', '.png', '.gif', '.bmp') then 'image'
  when size < 524288 then 'direct' when ext = '.zip' then 'zip_rejected' else 'parse' end route from e""",
)
def route(spark, sf_dir):
    content = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size = F.octet_length(content)
    return table(spark, sf_dir, "pages").select("page_id", size.cast("long").alias("size"), D.route(size, F.lit("text/html"), F.col("url"), content).alias("route"))


@register("ocr_clean")
def ocr_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(O.clean_markdown(F.col("text")).cast("binary"), 256).alias("clean_sha"))


@register("table_extract")
def table_extract(spark, sf_dir):
    ship(spark)
    return O.extract_tables(_docs(spark, sf_dir))


@register(
    "prompt_kind",
    "select conv_id, turn, case when "
    + "(" + " or ".join(f"contains(lower(text), '{t}')" for t in O.TABLE_TERMS) + ") and turn >= 2 then 'table' when "
    + "(" + " or ".join(f"contains(lower(text), '{t}')" for t in O.FOOTNOTE_TERMS) + ") and turn >= 1 then 'footnote' else 'structure' end kind from conversations where text is not null",
)
def prompt_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", O.prompt_kind(F.col("text"), F.col("turn"), F.col("turn")).alias("kind"))


@register(
    "cluster_terms",
    """with d as (select lang as cluster, doc_id id, text from documents where text is not null and lang is not null),
w as (select cluster, id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) w from d),
df as (select w, count(distinct id) df from w group by 1), tf as (select cluster, w, count(*) tf from w group by all), n as (select count(distinct id) n from d),
s as (select cluster, w, round(tf * ln((n + 1) / df), 6) score from tf join df using (w), n),
r as (select *, row_number() over (partition by cluster order by score desc, w) as rank from s)
select * from r where rank <= 15""",
)
def cluster_terms(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("lang is not null").select(F.col("lang").alias("cluster"), F.col("doc_id").alias("id"), "text")
    return K.cluster_terms(docs, 15)


@register(
    "cluster_representatives",
    """with v as (select vec_id id, label as cluster, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings),
c as (select cluster, i, avg(x) c from v group by all), d as (select cluster, id, round(sqrt(sum((x - c) * (x - c))), 6) d from v join c using (cluster, i) group by all),
u as (select cluster, id, d, sum(10 + id % 7) over (partition by cluster order by d, id rows unbounded preceding)::bigint used from d)
select * from u where used <= 100""",
)
def cluster_representatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("v"))
    d = K.centre_distances(rows).withColumn("d", F.round("d", 6)).withColumn("tokens", F.lit(10) + F.col("id") % 7)
    return K.representatives(d, 100).select("cluster", "id", "d", "used")


@register("policy_graph_totals")
def policy_graph_totals(spark, sf_dir):
    ship(spark)
    parts = K.policy_graph(_docs(spark, sf_dir))
    totals = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in parts.items()]
    return totals[0].union(totals[1]).union(totals[2])
