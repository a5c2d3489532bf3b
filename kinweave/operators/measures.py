"""Node, group and whole-network measures of a tie table (src, dst, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import ranked as ranked_sums
from kinweave.operators.ties import symmetrised


def degrees(ties: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree, strength, contacts); a mutual tie counts twice in degree, once in contacts."""
    ends = ties.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out"), "w").unionByName(
        ties.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("out"), "w")
    )
    alters = ends.groupBy("node", "other").agg(F.sum("out").alias("out"), F.count("*").alias("n"), F.sum("w").alias("w"))
    sums = alters.groupBy("node").agg(F.sum("n").alias("degree"), F.sum("out").alias("out_degree"), F.sum("w").alias("strength"), F.count("*").alias("contacts"), F.sum((F.col("n") == 2).cast("bigint")).alias("mutual"))
    return sums.withColumn("in_degree", F.col("degree") - F.col("out_degree"))


def reciprocity(ties: DataFrame) -> DataFrame:
    """(node, reciprocity): twice the mutual ties over all ties of the node."""
    return degrees(ties).select("node", (2.0 * F.col("mutual") / F.col("degree")).alias("reciprocity"))


def summary(ties: DataFrame) -> DataFrame:
    """One row: nodes, ties, density, mean degree, overall reciprocity, weights."""
    marks = degrees(ties).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("mutual"), F.lit(0)).alias("mutual"))
    sums = ties.agg(F.count("*").alias("ties"), F.min("w").alias("least_w"), F.max("w").alias("most_w"), F.avg("w").alias("mean_w"))
    n, m = F.col("nodes"), F.col("ties")
    density = F.when(n > 1, m / (n * (n - 1))).otherwise(0.0)
    return sums.join(F.broadcast(marks)).select("nodes", "ties", density.alias("density"), F.when(n > 0, m / n).alias("mean_degree"), F.when(m > 0, F.col("mutual") / m).alias("reciprocity"), "least_w", "most_w", "mean_w")


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: Gini coefficient. Ranks come from running counts of distinct values, in ranges."""
    counts = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("k"))
    ranked = ranked_sums.running(counts, F.col("x"), "k").withColumn("ranks", F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2)
    return ranked.agg((2 * F.sum(F.col("ranks") * F.col("x")) / (F.sum("k") * F.sum(F.col("x") * F.col("k"))) - (F.sum("k") + 1) / F.sum("k")).alias("gini"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, c) of each triangle once, of pairs (u, v) entered both ways.

    Each pair points from its lower end by (degree, id), so that no node has more than about sqrt(2m) outgoing
    pairs and hubs don't make quadratic joins."""
    degree = pairs.groupBy("u").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    up = ranked.where(F.struct("d", "u") < F.struct(F.col("e").alias("d"), F.col("v").alias("u"))).select("u", "v", "e")
    one, other = up.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("e").alias("eb")), up.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("e").alias("ec"))
    wedges = one.join(other, "a").where(F.struct(F.col("eb").alias("d"), F.col("b").alias("i")) < F.struct(F.col("ec").alias("d"), F.col("c").alias("i")))
    return wedges.join(up.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def clustering(ties: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering), unweighted and symmetrised; below two contacts clustering is 0."""
    pairs = symmetrised(ties)
    degree = pairs.groupBy("u").agg(F.count("*").alias("d"))
    per_node = triangles(pairs).select(F.explode(F.array("a", "b", "c")).alias("u")).groupBy("u").agg(F.count("*").alias("triangles"))
    n, t = F.col("d"), F.coalesce("triangles", F.lit(0))
    return degree.join(per_node, "u", "left").select(F.col("u").alias("node"), n.alias("degree"), t.alias("triangles"), F.when(n > 1, 2.0 * t / (n * (n - 1))).otherwise(0.0).alias("clustering"))


def transitivity(ties: DataFrame) -> DataFrame:
    """One row: closed share of all connected triples, mean clustering, triangles."""
    triples = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return clustering(ties).agg((F.sum("triangles") / 3).cast("bigint").alias("triangles"), F.when(triples > 0, F.sum("triangles") / triples).otherwise(0.0).alias("transitivity"), F.avg("clustering").alias("mean_clustering"))


def mixing(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """(from_group, to_group, ties, weight) of ties with both ends in groups (node, grp)."""
    a, b = groups.select(F.col("node").alias("src"), F.col("grp").alias("from_group")), groups.select(F.col("node").alias("dst"), F.col("grp").alias("to_group"))
    return ties.join(a, "src").join(b, "dst").groupBy("from_group", "to_group").agg(F.count("*").alias("ties"), F.sum("w").alias("weight"))


def ei_index(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: (external - internal) / (external + internal), by count and by weight; null without coded ties."""
    sign = F.when(F.col("from_group") == F.col("to_group"), -1.0).otherwise(1.0)
    return mixing(ties, groups).agg((F.sum(sign * F.col("ties")) / F.sum("ties")).alias("ei"), (F.sum(sign * F.col("weight")) / F.sum("weight")).alias("ei_weighted"))


def top_nodes(values: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k largest; equal values by node."""
    return values.where(F.col(column).isNotNull()).orderBy(F.desc(column), "node").limit(k)

