"""Weak and strong components of a tie table, by rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import storage


def linked(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Each round takes the smallest label among neighbours and then that label's own label, so
    labels jump in doubling steps. Hot nodes are no matter: labels of neighbours are pre-aggregated, and
    the join on the far end can be split. Each round is a table in the shared folder; that before it is deleted."""
    spark = links.sparkSession
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    edges, edges_path = storage.stored(both.where("u <> v"), "edges")
    labels, path = storage.stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("target"), F.col("label").alias("further"))
        jumped = lower.join(jump, F.col("label") == F.col("target"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        before = path
        labels, path = storage.stored(jumped.select("node", "label", (F.col("old") != F.col("label")).alias("moved")), "labels")
        storage.discard(spark, before)
        if labels.where("moved").isEmpty():
            storage.discard(spark, edges_path)
            return labels.select("node", F.col("label").alias("component"))


def weak(ties: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of ties (src, dst); with nodes (node) also of those without ties."""
    found = linked(ties, "src", "dst")
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(start: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(node, mark): the smallest mark that reaches a node along edges (u, v) between nodes of one label."""
    spark = start.sparkSession
    marks, path = storage.stored(start.select("node", "mark", F.lit(True).alias("fresh")), label)
    while not marks.where("fresh").isEmpty():
        near = marks.where("fresh").join(edges, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("mark").alias("reached"))
        after = marks.drop("fresh").join(near, "node", "full")
        after = after.select("node", F.least("mark", "reached").alias("mark"), (F.col("reached").isNotNull() & (F.col("mark").isNull() | (F.col("reached") < F.col("mark")))).alias("fresh"))
        before = path
        marks, path = storage.stored(after, label)
        storage.discard(spark, before)
    return marks.select("node", "mark")


def strong(ties: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component of directed ties.

    Rounds of colouring: the smallest node that reaches a node colours it; within a colour, what also reaches the colour's own node
    is one component and leaves. A round settles at least one component of each colour that is left."""
    edges = storage.materialize(ties.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct(), "arcs")
    left = storage.materialize((nodes.select("node") if nodes is not None else edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))).distinct(), "left")
    settled = None
    while not left.isEmpty():
        colours = _spread(left.select("node", F.col("node").alias("mark")), edges, "colours")
        paint = colours.withColumnRenamed("mark", "colour")
        inside = edges.join(paint.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(paint.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v").where("cu = cv")
        back = storage.materialize(inside.select(F.col("v").alias("u"), F.col("u").alias("v")), "inside")
        found = _spread(paint.where("node = colour").select("node", F.col("node").alias("mark")), back, "back").withColumnRenamed("mark", "component")
        found = storage.materialize(found, "strong")
        settled = found if settled is None else settled.unionByName(found)
        left = storage.materialize(left.join(found, "node", "left_anti"), "left")
        edges = storage.materialize(edges.join(left.withColumnRenamed("node", "u"), "u", "left_semi").join(left.withColumnRenamed("node", "v"), "v", "left_semi"), "arcs")
    return settled if settled is not None else left.select("node", F.col("node").alias("component"))


def sizes(components: DataFrame) -> DataFrame:
    """One row: components, nodes, share of the largest."""
    per = components.groupBy("component").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), (F.max("n") / F.sum("n")).alias("largest_share"))
