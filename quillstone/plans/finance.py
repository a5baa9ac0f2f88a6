"""Queries for screening, history, series, request health, conversations and relational SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import screener as S
from quillstone.plans.catalog import register
from quillstone.sources import stores
from quillstone.sources.tables import register_views, table

# --- companies and their ratios ---

PARAMETERS = {
    "Market Capitalization": "cap",
    "Sales": "sales",
    "Orders": "orders",
    "Average order": "avg_order",
    "Current balance": "balance",
    "Price to sales": "p_s",
}
_RATIOS = """with r as (
  select c_custkey, c_name, c_acctbal balance, coalesce(sum(o_totalprice), 0) sales, count(o_orderkey) orders
  from customer left join orders on c_custkey = o_custkey group by all),
k as (select *, balance * 100 cap, case when orders > 0 then sales / orders end avg_order, case when sales <> 0 then balance * 100 / sales end p_s from r)
"""


def _ratios(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("sales"), F.count("*").alias("orders"))
    rows = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.select("c_custkey", "c_name", F.col("c_acctbal").alias("balance"), F.coalesce("sales", F.lit(0.0)).alias("sales"), F.coalesce("orders", F.lit(0)).alias("orders"))
    cap = F.col("balance") * 100
    return rows.withColumn("cap", cap).withColumn("avg_order", F.when(F.col("orders") > 0, F.col("sales") / F.col("orders"))).withColumn("p_s", F.try_divide(cap, F.col("sales")))


@register("screener_filter", _RATIOS + "select c_custkey, round(cap, 4) cap, round(sales, 2) sales from k where cap > 500000 and orders >= 5 and p_s < 1")
def screener_filter(spark, sf_dir):
    predicate = S.parse("Market Capitalization > 500000 AND Orders >= 5 AND Price to sales < 1", PARAMETERS)
    return _ratios(spark, sf_dir).where(predicate).select("c_custkey", F.round("cap", 4).alias("cap"), F.round("sales", 2).alias("sales"))


@register("screener_arith", _RATIOS + "select c_custkey, orders from k where (sales - cap) / nullif(orders, 0) > 50000 + 2 * balance or balance * 2 <= -1000")
def screener_arith(spark, sf_dir):
    predicate = S.parse("(Sales - Market Capitalization) / Orders > 50000 + 2 * Current balance OR Current balance * 2 <= -1000", PARAMETERS)
    return _ratios(spark, sf_dir).where(predicate).select("c_custkey", "orders")


@register("screener_top100", _RATIOS + "select c_custkey, c_name, round(sales, 2) sales from k where sales > 100000 order by k.sales desc, c_custkey limit 100")
def screener_top100(spark, sf_dir):
    found = S.screen(_ratios(spark, sf_dir), "Sales > 100000", PARAMETERS, [F.col("sales").desc(), "c_custkey"])
    return found.select("c_custkey", "c_name", F.round("sales", 2).alias("sales"))


@register("company_lookup", "select q, min(c_custkey) code from (select 'customer#' || lpad((i * 20)::varchar, 9, '0') q from range(1, 8) t(i)) join customer on contains(lower(c_name), q) group by 1")
def company_lookup(spark, sf_dir):
    names = spark.range(1, 8).select(F.concat(F.lit("customer#"), F.lpad((F.col("id") * 20).cast("string"), 9, "0")).alias("q"))
    found = table(spark, sf_dir, "customer").join(F.broadcast(names), F.lower("c_name").contains(F.col("q")))
    return found.groupBy("q").agg(F.min("c_custkey").alias("code"))


_YEARLY = "with y as (select o_custkey, year(o_orderdate) as yr, round(sum(o_totalprice), 2) sales from orders group by all)"


def _history(spark, sf_dir):
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("sales"))
    return S.history(yearly, "o_custkey", "yr", "sales")


_W = "over (partition by o_custkey order by yr)"


@register("yoy_growth", f"{_YEARLY} select o_custkey, yr, lag(sales) {_W} preceding_year, round((sales - lag(sales) {_W}) / nullif(lag(sales) {_W}, 0) * 100, 6) growth, round(sales - lag(sales) {_W}, 6) change from y")
def yoy_growth(spark, sf_dir):
    return _history(spark, sf_dir).select("o_custkey", "yr", "preceding_year", "growth", "change")


@register("n_years_back", f"{_YEARLY} select o_custkey, yr, lag(sales, 3) {_W} years_back, round((pow(sales / nullif(lag(sales, 3) {_W}, 0), 1.0 / 3) - 1) * 100, 6) compound_growth from y")
def n_years_back(spark, sf_dir):
    return _history(spark, sf_dir).select("o_custkey", "yr", "years_back", "compound_growth")


@register("average_median", f"{_YEARLY} select o_custkey, yr, round(sum(sales) over w, 2) / count(sales) over w average, round(median(sales) over w, 6) median from y window w as (partition by o_custkey order by yr rows 2 preceding)")
def average_median(spark, sf_dir):
    return _history(spark, sf_dir).select("o_custkey", "yr", "average", "median")


# --- series and health over events ---

_DAILY = "with d as (select event_type, cast(ts as date) as day, round(sum(value), 6) v from events group by all)"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


@register("series_tail180", _DAILY + " select event_type, strftime(day, '%Y-%m-%d') as label, v as value from (select *, row_number() over (partition by event_type order by day desc) r from d) where r <= 180")
def series_tail180(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.col("day").desc())
    return _daily(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 180").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("label"), F.col("v").alias("value"))


@register("chart_points", _DAILY + " select event_type, list(strftime(day, '%Y-%m-%d') order by day) labels, list(v order by day) as \"values\" from d group by 1")
def chart_points(spark, sf_dir):
    rows = _daily(spark, sf_dir).select("event_type", F.struct(F.date_format("day", "yyyy-MM-dd").alias("label"), F.col("v").alias("value")).alias("p"))
    points = rows.groupBy("event_type").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return points.select("event_type", F.col("p.label").alias("labels"), F.col("p.value").alias("values"))


@register("moving_avg_50_200", _DAILY + " select event_type, strftime(day, '%Y-%m-%d') as label, round(sum(v) over w50, 2) / count(v) over w50 dma50, round(sum(v) over w200, 2) / count(v) over w200 dma200 from d window w50 as (partition by event_type order by day rows 49 preceding), w200 as (partition by event_type order by day rows 199 preceding)")
def moving_avg_50_200(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("day")
    # the sum is rounded, not the mean: both engines then divide the same numbers
    mean = lambda n: F.round(F.sum("v").over(w.rowsBetween(1 - n, 0)), 2) / F.count("v").over(w.rowsBetween(1 - n, 0))
    return _daily(spark, sf_dir).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("label"), mean(50).alias("dma50"), mean(200).alias("dma200"))


@register("rate_cap_minute", "select user_id, date_trunc('minute', ts) as minute_start, count(*) n, count(*) > 60 capped from events group by all")
def rate_cap_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute_start")).agg(F.count("*").alias("n"), (F.count("*") > 60).alias("capped"))


@register("error_rate_by_user", "select user_id, count(*) total, count(*) filter (event_type = 'error') errors, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end) * 100, 6) success_rate from events group by 1")
def error_rate_by_user(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("errors"), F.round(F.avg((~bad).cast("double")) * 100, 6).alias("success_rate"))


_KEYS = """with e as (select user_id, ts, event_id, event_type = 'error' bad from events),
g as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) run from e),
c as (select user_id, run, sum(bad::int) streak from g group by all),
h as (select user_id, max(streak) worst from c group by 1)"""


@register("health_summary", _KEYS + " select count(*) total_keys, count(*) filter (worst < 3) healthy, round(count(*) filter (worst < 3) * 100.0 / count(*), 6) healthy_percent, max(worst)::bigint worst from h")
def health_summary(spark, sf_dir):
    """A key (user) is unhealthy after three failures in a row."""
    bad = (F.col("event_type") == "error").cast("int")
    run = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select("user_id", bad.alias("bad"), F.sum(1 - bad).over(run).alias("run"))
    worst = e.groupBy("user_id", "run").agg(F.sum("bad").alias("streak")).groupBy("user_id").agg(F.max("streak").alias("worst"))
    fine = (F.col("worst") < 3).cast("long")
    return worst.agg(F.count("*").alias("total_keys"), F.sum(fine).alias("healthy"), F.round(F.sum(fine) * 100 / F.count("*"), 6).alias("healthy_percent"), F.max("worst").alias("worst"))


@register("request_log", "select cast(ts as date) as day, count(*) requests, count(distinct user_id) callers, round(sum(value), 2) / count(value) mean_value, count(*) filter (event_type = 'error') failed from events group by 1")
def request_log(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.countDistinct("user_id").alias("callers"), (F.round(F.sum("value"), 2) / F.count("value")).alias("mean_value"), F.sum((F.col("event_type") == "error").cast("long")).alias("failed")
    )


@register("props_json", "select event_type, json_extract_string(props, '$.k')::bigint % 10 bucket, count(*) n, sum(json_extract_string(props, '$.k')::bigint)::bigint total from events group by all")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@register("json_exists", "select event_type, bool_or(json_extract_string(props, '$.k') = '7') cached from events group by 1")
def json_exists(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_or(F.get_json_object("props", "$.k") == "7").alias("cached"))


# --- conversations ---


@register("conv_latest", "select conv_id, max(turn) last_turn, arg_max(role, turn) last_role, count(*) turns from conversations group by 1")
def conv_latest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"))


@register("first_user_title", "select conv_id, case when length(t) > 50 then substr(t, 1, 47) || '...' else t end title from (select conv_id, arg_min(text, turn) t from conversations where role = 'user' group by 1)")
def first_user_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", T.short_title(F.col("t")).alias("title"))


@register("role_counts", "select role, count(*) n, count(distinct conv_id) conversations, max(turn) longest from conversations group by 1")
def role_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


@register(
    "date_buckets",
    """with e as (select cast(ts as date) as day from events), t as (select date '2024-01-30' today)
select case when day = today then 'today' when day = today - 1 then 'yesterday' when day > today - 7 then 'last_week' when day > today - interval 1 month then 'last_month' else 'older' end bucket, count(*) n from e, t group by 1""",
)
def date_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(T.date_bucket(F.to_date("ts"), F.to_date(F.lit("2024-01-30"))).alias("bucket")).agg(F.count("*").alias("n"))


# --- stores ---


@register(
    "upsert_merge",
    """with n as (select c_custkey, c_name, c_acctbal + 1 c_acctbal from customer where c_acctbal < 0 union all select c_custkey + 1000000, c_name, c_acctbal from customer where c_acctbal > 9000)
select c_custkey, c_name, round(c_acctbal, 2) c_acctbal from customer where c_custkey not in (select c_custkey from n) union all select c_custkey, c_name, round(c_acctbal, 2) from n""",
)
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_acctbal < 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).union(old.where("c_acctbal > 9000").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return stores.upsert(old, new, "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@register("delete_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return stores.delete(table(spark, sf_dir, "customer").select("c_custkey"), gone, "c_custkey")


@register("batch_numbers", "select source, batch, count(*) n, min(doc_id) first_id from (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 95 batch from documents) group by all")
def batch_numbers(spark, sf_dir):
    rows = stores.batch_numbers(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@register("namespace_ready", "select label, count(*) vectors, count(*) >= 25 ready from embeddings group by 1")
def namespace_ready(spark, sf_dir):
    return stores.namespace_counts(table(spark, sf_dir, "embeddings"), "label", 25)


@register("cache_keys", "select page_id, substr(sha256(url), 1, 16) as key, 'doc_' || substr(sha256(url), 1, 16) namespace from pages")
def cache_keys(spark, sf_dir):
    key = stores.cache_key(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.concat(F.lit("doc_"), key).alias("namespace"))


@register("cache_stats", "select count(distinct url) entries, count(*) files, round(sum(octet_length(encode(html))) / 1048576.0, 6)::double megabytes from pages")
def cache_stats(spark, sf_dir):
    return stores.cache_stats(table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.octet_length("html").alias("size")))


@register("graph_merge", "select n_nationkey k, coalesce(n_name, r_name) v from nation full join region on n_nationkey = r_regionkey")
def graph_merge(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return stores.merge_graph(old, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), ["k"])


@register("keyword_lines", "select n_nationkey // 10 line, string_agg(n_name, '; ' order by n_nationkey) content from nation group by 1")
def keyword_lines(spark, sf_dir):
    return stores.keyword_lines(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("w")))


# --- any SQL over the views: the same text on both sides ---

SQL = {
    "sql_join_inner": "select n_name, count(*) customers, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey group by n_name",
    "sql_join_left": "select r_name, count(n_nationkey) nations from region left join nation on r_regionkey = n_regionkey group by r_name",
    "sql_join_full": "select coalesce(c.k, s.k) k, customers, suppliers from (select c_nationkey k, count(*) customers from customer group by c_nationkey) c full join (select s_nationkey k, count(*) suppliers from supplier group by s_nationkey) s on c.k = s.k",
    "sql_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)",
    "sql_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by rollup(l_returnflag, l_linestatus)",
    "sql_cube": "select o_orderstatus, o_orderpriority, count(*) n from orders group by cube(o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "select p_brand, p_size, count(*) n from part group by grouping sets ((p_brand), (p_size), ())",
    "sql_rank_window": "select * from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) t where r <= 3",
    "sql_frames": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) s, ntile(4) over (partition by o_custkey order by o_orderkey) q from orders",
    "sql_set_ops": "select c_nationkey k from customer intersect select s_nationkey from supplier union all (select n_nationkey from nation except select c_nationkey from customer)",
    "sql_cte_recursive": "with recursive t(n, f) as (select 1, 1 union all select n + 1, f * (n + 1) from t where n < 10) select n, f from t",
    "sql_subquery_correlated": "select p_partkey from part p where p_retailprice > (select avg(p_retailprice) from part q where q.p_brand = p.p_brand)",
    "sql_distinct": "select count(distinct l_suppkey) suppliers, count(distinct l_partkey) parts from lineitem",
    "sql_having": "select o_custkey, count(*) n from orders group by o_custkey having count(*) > 12",
    "sql_case_pivot": "select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) f, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) o from orders group by o_orderpriority",
    "sql_pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc_price, round(avg(l_discount), 6) avg_disc, count(*) count_order from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus",
    "sql_shipping_priority": "select o_orderkey, cast(sum(cast(l_extendedprice as decimal(15, 2)) * (1 - cast(l_discount as decimal(15, 2)))) as double) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by o_orderkey",
    "sql_local_supplier": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by n_name",
}


def _sql(text: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        return stores.run_sql(spark, text + ";")

    return run


for _name, _text in SQL.items():
    register(_name, _text)(_sql(_text))
