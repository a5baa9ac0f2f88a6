"""Decision trees as rows: nodes, edges to nodes that exist, paths, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import node_id

NODE = "struct<node_id:string,node_type:string,question:string,left_child:string,right_child:string,answer:string,reasoning:string,confidence:double>"


def nodes(trees: DataFrame) -> DataFrame:
    """(tree_id, name, root, node_id, ...) from trees (tree_id, json); nodes may be a map or a list."""
    head = "tree_id string, name string, root_node_id string"
    both = trees.select(
        "tree_id",
        F.from_json("json", f"{head}, nodes map<string,{NODE}>").alias("m"),
        F.from_json("json", f"{head}, nodes array<{NODE}>").alias("l"),
    )
    as_list = F.transform(F.map_entries("m.nodes"), lambda e: e["value"].withField("node_id", e["key"]))
    rows = both.select("tree_id", F.coalesce("m.name", "l.name").alias("name"), F.coalesce("m.root_node_id", "l.root_node_id").alias("root"), F.explode(F.when(F.size("l.nodes") > 0, F.col("l.nodes")).otherwise(as_list)).alias("n"))
    return rows.select("tree_id", "name", "root", "n.*")


def edges(node_rows: DataFrame) -> DataFrame:
    """(tree_id, parent, child, label): No to the left, Yes to the right, only to nodes that exist."""
    pairs = node_rows.select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array(F.struct(F.col("left_child").alias("child"), F.lit("No").alias("label")), F.struct(F.col("right_child").alias("child"), F.lit("Yes").alias("label")))).alias("e"))
    pairs = pairs.select("tree_id", "parent", "e.child", "e.label").where("child is not null")
    return pairs.join(node_rows.select("tree_id", F.col("node_id").alias("child")), ["tree_id", "child"], "left_semi").select("tree_id", "parent", "child", "label")


def paths(node_rows: DataFrame, edge_rows: DataFrame, deepest: int = 64) -> DataFrame:
    """(tree_id, node, depth, path) of all nodes that the root reaches; at most ``deepest`` steps, so circles end."""
    front = node_rows.where("node_id = root").select("tree_id", F.col("node_id").alias("node"), F.lit(0).alias("depth"), F.col("node_id").alias("path"))
    found, depth = front, 0
    while depth < deepest:
        depth += 1
        front = front.join(edge_rows, (front["tree_id"] == edge_rows["tree_id"]) & (front["node"] == edge_rows["parent"])).select(
            front["tree_id"], F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.lit("/"), "label", F.lit("/"), "child").alias("path")
        )
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def mermaid(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(tree_id, diagram): one flowchart a tree; ids are short and unique."""
    same = Window.partitionBy("tree_id", node_id(F.col("node_id"))).orderBy("node_id")
    nth = F.row_number().over(same) - 1
    ids = node_rows.withColumn("id", F.concat(node_id(F.col("node_id")), F.when(nth > 0, F.concat(F.lit("_"), nth)).otherwise(F.lit(""))))
    plain = lambda c, d: F.translate(F.coalesce(c, F.lit(d)), '"|', "'-")
    q = plain(F.col("question"), "Unknown")
    shape = F.when(F.col("node_type") == "root", F.concat("id", F.lit('[["'), q, F.lit('"]]'))).when(F.col("node_type") == "leaf", F.concat("id", F.lit('(["'), plain(F.col("answer"), "Result"), F.lit('"])'))).otherwise(F.concat("id", F.lit('{"'), q, F.lit('"}')))
    boxes = ids.select("tree_id", F.lit(0).alias("part"), F.concat(F.lit("    "), shape).alias("line"))
    of = ids.select("tree_id", "node_id", "id")
    arrows = edge_rows.join(of.select("tree_id", F.col("node_id").alias("parent"), F.col("id").alias("a")), ["tree_id", "parent"]).join(of.select("tree_id", F.col("node_id").alias("child"), F.col("id").alias("b")), ["tree_id", "child"])
    arrows = arrows.select("tree_id", F.lit(1).alias("part"), F.concat(F.lit("    "), "a", F.lit(" -->|"), "label", F.lit("| "), "b").alias("line"))
    styles = ids.select("tree_id", F.lit(2).alias("part"), F.concat(F.lit("class "), "id", F.lit(" "), F.when(F.col("node_type").isin("root", "leaf"), F.col("node_type")).otherwise(F.lit("decision")), F.lit("Style")).alias("line"))
    lines = boxes.union(arrows).union(styles).groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("x"))
    return lines.select("tree_id", F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("diagram"))


def flow_edges(flows: DataFrame) -> DataFrame:
    """(flow_id, parent, child, label) from flows (flow_id, json) with branches and next_nodes."""
    step = "struct<node_id:string,type:string,branches:array<struct<condition:string,label:string,next_node:string>>,next_nodes:array<string>>"
    rows = flows.select("flow_id", F.explode(F.from_json("json", f"start_node string, nodes array<{step}>")["nodes"]).alias("n"))
    nexts = F.concat(
        F.coalesce(F.transform("n.branches", lambda b: F.struct(b["next_node"].alias("child"), F.coalesce(b["label"], b["condition"]).alias("label"))), F.array().cast("array<struct<child:string,label:string>>")),
        F.coalesce(F.transform("n.next_nodes", lambda x: F.struct(x.alias("child"), F.lit(None).cast("string").alias("label"))), F.array().cast("array<struct<child:string,label:string>>")),
    )
    pairs = rows.select("flow_id", F.col("n.node_id").alias("parent"), F.explode(nexts).alias("e")).select("flow_id", "parent", "e.*")
    return pairs.join(rows.select("flow_id", F.col("n.node_id").alias("child")), ["flow_id", "child"], "left_semi").select("flow_id", "parent", "child", "label")
