"""Measures of a tie table (src, dst, w) that need a partition of its nodes or the ties among contacts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import ranked as ranked_sums
from kinweave.operators.measures import mixing, triangles
from kinweave.operators.ties import symmetrised


def centralization(ties: DataFrame) -> DataFrame:
    """One row: Freeman degree centralization of the symmetrised ties; null below three nodes."""
    degree = symmetrised(ties).groupBy("u").agg(F.count("*").alias("d"))
    n = F.col("n")
    sums = degree.agg(F.count("*").alias("n"), F.max("d").alias("most"), F.sum("d").alias("all"))
    return sums.select(F.when(n > 2, (F.col("most") * n - F.col("all")) / ((n - 1) * (n - 2))).alias("centralization"))


def degree_assortativity(ties: DataFrame) -> DataFrame:
    """One row: correlation of the out-degree of a tie's start with the in-degree of its end; null without variance."""
    out, into = ties.groupBy("src").agg(F.count("*").alias("d_out")), ties.groupBy("dst").agg(F.count("*").alias("d_in"))
    pairs = ties.select("src", "dst").join(out, "src").join(into, "dst").agg(F.stddev_pop("d_out").alias("a"), F.stddev_pop("d_in").alias("b"), F.covar_pop("d_out", "d_in").alias("c"))
    return pairs.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("assortativity"))


def group_ties(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, internal, external, internal_weight, external_weight, ei); a tie between two groups is external to both."""
    m = mixing(ties, groups)
    inside = F.col("from_group") == F.col("to_group")
    rows = m.select(F.col("from_group").alias("grp"), "ties", "weight", inside.alias("inside")).unionByName(m.where(~inside).select(F.col("to_group").alias("grp"), "ties", "weight", F.lit(False).alias("inside")))
    total = lambda c, i: F.coalesce(F.sum(F.when(F.col("inside") == i, F.col(c))), F.lit(0))
    sums = rows.groupBy("grp").agg(total("ties", True).alias("internal"), total("ties", False).alias("external"), total("weight", True).alias("internal_weight"), total("weight", False).alias("external_weight"))
    return sums.withColumn("ei", (F.col("external") - F.col("internal")) / (F.col("external") + F.col("internal")))


def group_assortativity(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: Newman's coefficient over the mixing shares; null where one group holds all ties."""
    m = mixing(ties, groups).select("from_group", "to_group", "ties")
    ends = m.select(F.col("from_group").alias("grp"), F.col("ties").alias("a"), F.lit(0).alias("b"), F.when(F.col("from_group") == F.col("to_group"), F.col("ties")).otherwise(0).alias("same"))
    ends = ends.unionByName(m.select(F.col("to_group").alias("grp"), F.lit(0).alias("a"), F.col("ties").alias("b"), F.lit(0).alias("same")))
    per = ends.groupBy("grp").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("same").alias("same"))
    sums = per.agg(F.sum("a").cast("double").alias("m"), F.sum("same").alias("same"), F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    expected = F.col("ab") / (F.col("m") * F.col("m"))
    return sums.select(F.when(expected < 1, (F.col("same") / F.col("m") - expected) / (1 - expected)).alias("assortativity"))


def modularity(ties: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: Newman modularity of a given partition on symmetrised weights, over ties with both ends in it."""
    m = mixing(ties, groups)
    inside = F.when(F.col("from_group") == F.col("to_group"), F.col("weight")).otherwise(0.0)
    ends = m.select(F.col("from_group").alias("grp"), "weight", inside.alias("within")).unionByName(m.select(F.col("to_group").alias("grp"), "weight", F.lit(0.0).alias("within")))
    per = ends.groupBy("grp").agg(F.sum("weight").alias("s"), F.sum("within").alias("within"))
    sums = per.agg((F.sum("s") / 2).alias("w"), F.sum("within").alias("within"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return sums.select(F.when(F.col("w") > 0, F.col("within") / F.col("w") - resolution * F.col("ss") / (4 * F.col("w") * F.col("w"))).alias("modularity"))


def brokerage(ties: DataFrame) -> DataFrame:
    """(node, constraint, effective_size) after Burt, on the mutual weights of contacts.

    The two-step sums run over paths v-q-j whose ends are contacts too: wedges that a triangle closes."""
    both = ties.select("src", "dst", "w").unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")
    mutual = both.groupBy("src", "dst").agg(F.sum("w").alias("m"))
    per = mutual.groupBy("src").agg(F.sum("m").alias("total"), F.max("m").alias("most"))
    p = mutual.join(per, "src").select("src", "dst", (F.col("m") / F.col("total")).alias("p"), (F.col("m") / F.col("most")).alias("share"))
    contact = p.select(F.col("src").alias("v"), F.col("dst").alias("j"), F.col("p").alias("p_vj"))
    pairs = mutual.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    found = triangles(pairs)
    # each triangle closes six two-step paths v-q-j; the weights of its ends are joined on, wedges that nothing closes are never made
    turns = ", ".join(f"struct({x} AS v, {y} AS q, {z} AS j)" for x, y, z in permutations("abc"))
    steps = found.select(F.explode(F.expr(f"array({turns})")).alias("s")).select("s.*")
    vq = p.select(F.col("src").alias("v"), F.col("dst").alias("q"), F.col("p").alias("p_vq"))
    qj = p.select(F.col("src").alias("q"), F.col("dst").alias("j"), F.col("p").alias("p_qj"))
    jq = p.select(F.col("src").alias("j"), F.col("dst").alias("q"), F.col("share").alias("share_jq"))
    closed = steps.join(vq, ["v", "q"]).join(qj, ["q", "j"]).join(jq, ["q", "j"])
    indirect = closed.groupBy("v", "j").agg(F.sum(F.col("p_vq") * F.col("p_qj")).alias("via"), F.sum(F.col("p_vq") * F.col("share_jq")).alias("redundant"))
    via, redundant = F.coalesce("via", F.lit(0.0)), F.coalesce("redundant", F.lit(0.0))
    met = contact.join(indirect, ["v", "j"], "left")
    return met.groupBy(F.col("v").alias("node")).agg(F.sum(F.pow(F.col("p_vj") + via, F.lit(2))).alias("constraint"), F.sum(1 - redundant).alias("effective_size"))


def ranks(values: DataFrame, column: str) -> DataFrame:
    """(node, value, rank, tied): competition ranks, largest first, null values left out. Ranks come from counts of distinct values."""
    held = values.where(F.col(column).isNotNull()).select("node", F.col(column).alias("value"))
    counts = held.groupBy("value").agg(F.count("*").alias("tied"))
    return held.join(ranked_sums.running(counts, -F.col("value"), "tied").select("value", "tied", (F.col("before") + 1).alias("rank")), "value")


def quantiles(values: DataFrame, column: str, at: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(q, value): quantiles by linear interpolation, nulls left out; null values for an empty table."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    points = total.select(F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q"), ((F.col("n") - 1) * F.col("q")).alias("h"))
    # the values of the two ranks about each point: those whose run of ranks holds them
    met = ranked_sums.running(counts, F.col("x"), "k").join(F.broadcast(points), (F.col("before") <= F.ceil("h")) & (F.col("before") + F.col("k") > F.floor("h")))
    low, high = F.min("x"), F.max("x")
    found = met.groupBy("q", "h").agg((low + (high - low) * (F.col("h") - F.floor("h"))).alias("value"))
    return points.join(found.select("q", "value"), "q", "left").select("q", "value")


def two_mode_summary(affiliations: DataFrame) -> DataFrame:
    """One row for affiliations (person, event): people, events, affiliations, density, mean sizes."""
    pairs = affiliations.where("person IS NOT NULL AND event IS NOT NULL").distinct()
    sums = pairs.agg(F.count_distinct("person").alias("people"), F.count_distinct("event").alias("events"), F.count("*").alias("affiliations"))
    n, m, k = F.col("people"), F.col("events"), F.col("affiliations")
    return sums.select("*", F.when(k > 0, k / (n * m)).alias("density"), F.when(k > 0, k / n).alias("events_each"), F.when(k > 0, k / m).alias("people_each"))


def coder_agreement(codes: DataFrame, one: str, other: str) -> DataFrame:
    """One row: items, share of equal codes and Cohen's kappa of two coders; items that one left blank don't count."""
    table = codes.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).alias("x"), F.col(other).alias("y")).agg(F.count("*").alias("n"))
    ends = table.select(F.col("x").alias("code"), F.col("n").alias("a"), F.lit(0).alias("b"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).alias("same"))
    ends = ends.unionByName(table.select(F.col("y").alias("code"), F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("same")))
    per = ends.groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("same").alias("same"))
    sums = per.agg(F.sum("a").alias("items"), F.sum("same").alias("same"), F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    share, chance = F.col("same") / F.col("items"), F.col("ab") / (F.col("items") * F.col("items"))
    return sums.select("items", share.alias("agreement"), F.when(chance < 1, (share - chance) / (1 - chance)).alias("kappa"))
