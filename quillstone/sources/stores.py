"""Tables as stores: upsert, delete, counts, caches, namespaces, graph merge, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.numbering import numbered

BATCH = 95


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in place of those with the same key; the last of several new rows is theirs to order."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def with_ids(rows: DataFrame, key: str) -> DataFrame:
    """Missing keys become a hash of the row, so that a retry gives the same."""
    return rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json(F.struct(*rows.columns)), 256)))


def batch_numbers(rows: DataFrame, group: str, order: str, size: int = BATCH) -> DataFrame:
    return numbered(rows, [group], [F.col(order)], "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def batches_ok(batches: DataFrame, share: float = 0.8) -> DataFrame:
    """batches (group, ok): whether enough batches of a group went well."""
    return batches.groupBy("grp").agg(F.avg(F.col("ok").cast("double")).alias("rate")).withColumn("success", F.col("rate") >= share)


def namespace_counts(rows: DataFrame, namespace: str, at_least: int) -> DataFrame:
    n = rows.groupBy(namespace).agg(F.count("*").alias("vectors"))
    return n.withColumn("ready", F.col("vectors") >= at_least)


def ready(counts: DataFrame, expected: Column, share: float = 0.8) -> DataFrame:
    return counts.withColumn("indexed", F.col("vectors") >= expected * share)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)


def cache_stats(entries: DataFrame) -> DataFrame:
    """entries (key, size): counts, files and megabytes."""
    return entries.agg(F.countDistinct("key").alias("entries"), F.count("*").alias("files"), F.round(F.sum("size") / (1024 * 1024), 6).alias("megabytes"))


def merge_graph(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Idempotent merge: keys once; on a match the old value stays where it is not null."""
    values = [c for c in old.columns if c not in key]
    joined = old.alias("o").join(new.dropDuplicates(key).alias("n"), key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in values])


def export_edges(edges: DataFrame, size: int = 2000) -> DataFrame:
    """Upper triangle with weight, numbered in batches."""
    kept = edges.where((F.col("k1") < F.col("k2")) & (F.col("weight") > 0))
    part = kept.withColumn("part", F.pmod(F.xxhash64("k1"), F.lit(64)))
    w = Window.partitionBy("part").orderBy("k1", "k2")
    return part.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def keyword_lines(keywords: DataFrame, per: int = 10) -> DataFrame:
    """keywords (i, w) as numbered lines of ten, joined by '; '."""
    line = F.floor(F.col("i") / per).alias("line")
    return keywords.groupBy(line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), "; ").alias("content"))


def append_log(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends request rows with their derived counts."""
    rows.withColumn("n_questions", F.size("questions")).withColumn("n_answers", F.size("answers")).write.mode("append").parquet(path)


def save_trees(trees: DataFrame, path: str) -> None:
    """Tree documents by url hash and topic, with their number of nodes."""
    n = F.size(F.map_keys(F.from_json("json", "nodes map<string,string>")["nodes"]))
    trees.withColumn("url_hash", cache_key(F.col("url"))).withColumn("n_nodes", n).write.mode("append").partitionBy("url_hash", "topic").parquet(path)


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """Any SQL text over the registered views: trimmed, without one trailing semicolon."""
    text = query.strip()
    return spark.sql(text[:-1] if text.endswith(";") else text)


def resolve_sources(rows: DataFrame) -> DataFrame:
    """rows (id, text, meta json) with the first of the metadata's source, file_name, filename, else the id; empty texts go."""
    keys = [F.nullif(F.get_json_object("meta", f"$.{k}"), F.lit("")) for k in ("source", "file_name", "filename")]
    return rows.where("text <> ''").withColumn("source", F.coalesce(*keys, F.col("id").cast("string")))


def update(rows: DataFrame, where: Column, **values) -> DataFrame:
    """rows with columns set where a condition holds."""
    return rows.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def latest(rows: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.col(by).desc_nulls_last())
    return out.limit(limit) if limit else out


def clear_tagged(nodes: DataFrame, edges: DataFrame, tag: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A graph without the nodes of a tag and the edges that touch them."""
    gone = nodes.where(tag).select(F.col(key).alias("gone"))
    left = nodes.join(gone, F.col(key) == F.col("gone"), "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone, F.col(end) == F.col("gone"), "left_anti")
    return left, edges


def counts_match(nodes: DataFrame, edges: DataFrame, expected_nodes: int, expected_edges: int) -> DataFrame:
    """One row: the totals and whether they are those expected."""
    n = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return n.withColumn("ok", (F.col("nodes") == expected_nodes) & (F.col("edges") == expected_edges))


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Every matrix or list of a graph as a table of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def cached(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (url) with whether the cache (key) has them."""
    keys = entries.select(F.col("key").alias("known")).distinct()
    return urls.withColumn("key", cache_key(F.col("url"))).join(keys, F.col("key") == F.col("known"), "left").withColumn("cached", F.col("known").isNotNull()).drop("known")


def clear_cache(entries: DataFrame, url: str | None = None) -> DataFrame:
    """The cache without one url's entry, or empty."""
    return entries.where(F.lit(False)) if url is None else entries.where(F.col("key") != cache_key(F.lit(url)))
