"""How well a planted truth is found again: ties, communities, brokers, ranks, shifts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import communities

#: Readings of a score.
GOOD, WEAK = 0.6, 0.25


def average_ranks(values: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, the smallest first, equal values at the mean of their places."""
    over = Window.orderBy(column)
    return values.withColumn(out, F.rank().over(over) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2)


def spearman(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rank correlation of two values (node, value) over common nodes, and how many there are."""
    both = one.select("node", F.col("value").alias("x")).join(other.select("node", F.col("value").alias("y")), "node").where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    sums = ranked.agg(F.count("*").alias("n"), F.stddev_pop("rx").alias("a"), F.stddev_pop("ry").alias("b"), F.covar_pop("rx", "ry").alias("c"))
    return sums.select("n", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("rho"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def welch(values: DataFrame) -> DataFrame:
    """One row: Welch's t of the values (grp 0 or 1, value) of two groups, with a two-sided p from the normal distribution."""
    sums = values.groupBy().agg(*[f(F.when(F.col("grp") == g, F.col("value"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    se = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    row = sums.select((F.col("m1") - F.col("m0")).alias("diff"), F.when(se > 0, (F.col("m1") - F.col("m0")) / se).alias("t"))
    tail = F.udf(lambda t: None if t is None else 2 * (1 - normal_cdf(abs(t))), "double")  # one row
    return row.withColumn("p", tail("t"))


def tie_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, found pairs, both, precision and recall; directions don't count."""
    pair = lambda t: t.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    met = pair(found).withColumn("f", F.lit(1)).join(pair(truth).withColumn("t", F.lit(1)), ["a", "b"], "full").agg(F.count("t").alias("true"), F.count("f").alias("found"), F.count(F.col("t") + F.col("f")).alias("both"))
    return met.select("*", F.when(F.col("found") > 0, F.col("both") / F.col("found")).alias("precision"), F.when(F.col("true") > 0, F.col("both") / F.col("true")).alias("recall"))


def precision_at(values: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
    """One row: the share of the k highest (by default as many as there are true ones) that are true (node)."""
    k = k if k is not None else truth.count()
    top = values.where("value IS NOT NULL").orderBy(F.desc("value"), "node").limit(max(k, 1)).select("node")
    return top.join(truth.withColumn("t", F.lit(1)), "node", "left").agg((F.count("t") / F.count("*")).alias("precision"))


def shift_found(shifts: DataFrame, window: int, tolerance: int = 1) -> DataFrame:
    """One row: whether a shift lies within some windows of the planted one, and how far the nearest is."""
    return shifts.agg(F.min(F.abs(F.col("window") - window)).alias("nearest")).select("nearest", F.coalesce(F.col("nearest") <= tolerance, F.lit(False)).alias("found"))


def reading(score: float | None) -> str:
    return "not measured" if score is None else "recovered" if score >= GOOD else "weak" if score >= WEAK else "not recovered"


def partition_recovery(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (nmi, ari) of found communities against true groups (node, community)."""
    return communities.agreement(found, truth)


def node_mapping(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """(person, node, how): people of a truth (person, key, label) met by key, then by a label that one of each side has."""
    by_key = truth.join(nodes.select(F.col("node_id").alias("node"), "key"), "key").select("person", "node", F.lit("key").alias("how"))
    single = lambda t, c: t.join(t.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c), c)
    rest = truth.join(by_key.select("person"), "person", "left_anti").select("person", F.lower(F.trim("label")).alias("name"))
    free = nodes.join(by_key.select(F.col("node").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("node"), F.lower(F.trim("label")).alias("name"))
    by_label = single(rest, "name").join(single(free, "name"), "name").select("person", "node", F.lit("label").alias("how"))
    return by_key.unionByName(by_label)
