"""Communities of a tie table: Louvain, two-mode communities, comparison of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave import kernels, storage
from kinweave.operators import centrality
from kinweave.operators.ties import project

#: Rounds of simultaneous moves before a network too large for a kernel is contracted.
MOVES = 6


def louvain(ties: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """(node, community) on symmetrised weights; communities are named by their smallest node, nodes without ties are alone.

    A network beyond the kernel's bound is first contracted by rounds in which half of the nodes, drawn by a hash, move to the neighbouring community
    of largest gain; the kernel ends the work on what is left."""
    spark = ties.sparkSession
    arcs = storage.materialize(centrality.both_ways(ties), "arcs")
    nodes = storage.materialize(centrality.all_nodes(ties, nodes), "nodes")
    label = nodes.select("node", F.col("node").alias("part"))
    small, loops = arcs, spark.createDataFrame([], f"node {nodes.schema['node'].dataType.simpleString()}, loop double")
    level = 0
    while small.limit(centrality.KERNEL_TIES + 1).count() > centrality.KERNEL_TIES:
        parts = _moves(small, loops, resolution, seed + level)
        before = small.count()
        grouped = small.join(parts.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
        inside = grouped.where("a = b").groupBy(F.col("a").alias("node")).agg((F.sum("w") / 2).alias("loop"))
        kept = loops.join(parts, "node").select(F.col("part").alias("node"), "loop")
        loops = storage.materialize(inside.unionByName(kept).groupBy("node").agg(F.sum("loop").alias("loop")), "loops")
        small = storage.materialize(grouped.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "arcs")
        label = storage.materialize(label.join(parts.select(F.col("node").alias("part"), F.col("part").alias("to")), "part", "left").select("node", F.coalesce("to", "part").alias("part")), "label")
        level += 1
        if small.count() == before:
            break
    ends = storage.materialize(label.select(F.col("part").alias("node")).distinct(), "ends")
    network = centrality.held(small, ends)
    if network is not None:
        found = network.table(spark, part=kernels.louvain(network.rows, resolution, seed)).select("node", F.col("part").alias("to"))
        label = label.join(found.withColumnRenamed("node", "part"), "part").select("node", "to")
    else:
        label = label.select("node", F.col("part").alias("to"))
    label = storage.materialize(label, "communities")
    first = label.groupBy("to").agg(F.min("node").alias("community"))
    return label.join(first, "to").select("node", "community")


def _moves(arcs: DataFrame, loops: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(node, part) after some rounds of simultaneous moves by gain in modularity."""
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(loops, "node", "left").select("node", (F.col("k") + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"))
    degree = storage.materialize(degree, "degree")
    total = degree.agg(F.sum("k").alias("all")).collect()[0]["all"]
    parts = degree.select("node", F.col("node").alias("part"))
    for i in range(MOVES):
        weight = degree.join(parts, "node").groupBy("part").agg(F.sum("k").alias("held"))
        to = arcs.join(parts.select(F.col("node").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("node"), "part").agg(F.sum("w").alias("to"))
        mine = degree.join(parts.withColumnRenamed("part", "mine"), "node")
        seen = to.join(mine, "node").join(weight, "part")
        own = F.when(F.col("part") == F.col("mine"), F.col("k")).otherwise(0.0)
        seen = seen.withColumn("gain", F.col("to") - resolution * F.col("k") * (F.col("held") - own) / total)
        best = seen.groupBy("node", "mine").agg(F.max(F.struct("gain", "part")).alias("best"), F.max(F.when(F.col("part") == F.col("mine"), F.col("gain"))).alias("stay"))
        turn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(2)) == 0
        moved = F.when(turn & (F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12), F.col("best.part")).otherwise(F.col("mine"))
        parts = storage.materialize(best.select("node", moved.alias("part")), "parts")
    return parts


def two_mode(ties: DataFrame, modes: DataFrame, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """(node, community) of a two-mode network (src, dst), modes (node, mode): Louvain on the projection of mode 0; a node of mode 1 joins the community
    that most of its members are in, the lowest on ties; one whose members are unknown is alone."""
    low = modes.where("mode = 0").select("node")
    turned = ties.select("src", "dst").unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    members = storage.materialize(turned.join(low.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("person"), F.col("dst").alias("event")), "members")
    pairs = project(members).select("src", "dst", F.col("shared").cast("double").alias("w"))
    people = louvain(pairs, low, resolution, seed)
    votes = members.join(people, F.col("person") == F.col("node")).groupBy("event", "community").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("n"), "community"))
    events = votes.withColumn("place", first).where("place = 1").select(F.col("event").alias("node"), "community")
    rest = modes.where("mode = 1").select("node").join(events, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    return people.unionByName(rest)


def by_size(partition: DataFrame) -> DataFrame:
    """(node, community, number, size): communities numbered from 0 by size, equal ones by name."""
    size = partition.groupBy("community").agg(F.count("*").alias("size"))
    ranked = size.withColumn("number", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)  # a row for each community
    return partition.join(ranked, "community").select("node", "community", "number", "size")


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, was): new communities and the old one that each shares most members with, one to one, largest overlaps first."""
    shared = old.select("node", F.col("community").alias("was")).join(new, "node").groupBy("community", "was").agg(F.count("*").alias("n"))
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("n"), "community", "was"))
    mutual = shared.withColumn("a", rank("community")).withColumn("b", rank("was")).where("a = 1 AND b = 1")
    return new.select("community").distinct().join(mutual.select("community", "was"), "community", "left")


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) and adjusted Rand index of two partitions (node, community), over common nodes."""
    cells = one.select("node", F.col("community").alias("x")).join(other.select("node", F.col("community").alias("y")), "node").groupBy("x", "y").agg(F.count("*").alias("n"))
    cells = storage.materialize(cells, "cells")
    rows, columns = cells.groupBy("x").agg(F.sum("n").alias("a")), cells.groupBy("y").agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n").cast("double").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    with_all = lambda t: t.join(F.broadcast(total.select("all")))
    mutual = with_all(cells.join(rows, "x").join(columns, "y")).agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"))
    spread = lambda t, c: with_all(t).agg((-F.sum(F.col(c) / F.col("all") * F.log(F.col(c) / F.col("all")))).alias(f"h{c}"), F.sum(F.col(c) * (F.col(c) - 1) / 2).alias(f"p{c}"))
    row = mutual.join(F.broadcast(spread(rows, "a"))).join(F.broadcast(spread(columns, "b"))).join(F.broadcast(total))
    mean = (F.col("ha") + F.col("hb")) / 2
    expected = F.col("pa") * F.col("pb") / (F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("pa") + F.col("pb")) / 2
    return row.select(F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"), F.when(top != expected, (F.col("pairs") - expected) / (top - expected)).otherwise(1.0).alias("ari"))
