"""Groups of nodes and personal networks: mixing with densities, group tables, numeric assortativity, ego measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import centrality, structure
from kinweave.operators.measures import mixing


def mixing_table(ties: DataFrame, groups: DataFrame, directed: bool = True) -> DataFrame:
    """(from_group, to_group, ties, weight, density); undirected ties between groups are entered both ways. Possible ties within a group of n are
    n(n - 1), half that undirected; between groups the product of sizes."""
    size = groups.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n"))
    m = mixing(ties, groups.where("grp IS NOT NULL"))
    if not directed:
        m = m.unionByName(m.where("from_group <> to_group").select(F.col("to_group").alias("from_group"), F.col("from_group").alias("to_group"), "ties", "weight"))
        m = m.groupBy("from_group", "to_group").agg(F.sum("ties").alias("ties"), F.sum("weight").alias("weight"))
    a, b = size.select(F.col("grp").alias("from_group"), F.col("n").alias("na")), size.select(F.col("grp").alias("to_group"), F.col("n").alias("nb"))
    m = m.join(a, "from_group").join(b, "to_group")
    possible = F.when(F.col("from_group") == F.col("to_group"), F.col("na") * (F.col("na") - 1) / (1 if directed else 2)).otherwise(F.col("na") * F.col("nb"))
    return m.select("from_group", "to_group", "ties", "weight", F.when(possible > 0, F.col("ties") / possible).alias("density"))


def group_table(ties: DataFrame, groups: DataFrame, directed: bool = True) -> DataFrame:
    """(grp, size, internal, external, internal_weight, external_weight, density, external_density, ei) of every group, also of those without ties."""
    known = groups.where("grp IS NOT NULL")
    size = known.groupBy("grp").agg(F.count("*").alias("size"))
    total = size.agg(F.sum("size").alias("all"))
    sums = structure.group_ties(ties, known).drop("ei")
    t = size.join(sums, "grp", "left").join(F.broadcast(total)).fillna(0, ["internal", "external", "internal_weight", "external_weight"])
    n, outside, way = F.col("size"), F.col("all") - F.col("size"), 2 if directed else 1
    within, between = n * (n - 1) / (1 if directed else 2), n * outside * way
    both = F.col("internal") + F.col("external")
    return t.select(
        "grp", "size", "internal", "external", "internal_weight", "external_weight", F.when(within > 0, F.col("internal") / within).alias("density"),
        F.when(between > 0, F.col("external") / between).alias("external_density"), F.when(both > 0, (F.col("external") - F.col("internal")) / both).alias("ei"),
    )


def assortativity(ties: DataFrame, groups: DataFrame, directed: bool = True, weighted: bool = False) -> DataFrame:
    """One row: Newman's coefficient over tie ends with a group; undirected ties count in both directions. Null where one group holds all."""
    arcs = ties.select("src", "dst", "w") if directed else ties.select("src", "dst", "w").unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    m = mixing(arcs, groups.where("grp IS NOT NULL")).select("from_group", "to_group", (F.col("weight") if weighted else F.col("ties")).cast("double").alias("x"))
    ends = m.select(F.col("from_group").alias("grp"), F.col("x").alias("a"), F.lit(0.0).alias("b"), F.when(F.col("from_group") == F.col("to_group"), F.col("x")).otherwise(0.0).alias("same"))
    ends = ends.unionByName(m.select(F.col("to_group").alias("grp"), F.lit(0.0).alias("a"), F.col("x").alias("b"), F.lit(0.0).alias("same")))
    sums = ends.groupBy("grp").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("same").alias("same")).agg(F.sum("a").alias("m"), F.sum("same").alias("same"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    expected = F.col("ab") / (F.col("m") * F.col("m"))
    return sums.select(F.when((F.col("m") > 0) & (expected != 1), (F.col("same") / F.col("m") - expected) / (1 - expected)).alias("assortativity"))


def numeric_assortativity(ties: DataFrame, values: DataFrame, directed: bool = True) -> DataFrame:
    """One row: correlation of a number (node, value) at the two ends of ties, both known; undirected ties both ways; null without variance."""
    arcs = ties.select("src", "dst") if directed else ties.select("src", "dst").unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    known = values.where("value IS NOT NULL AND NOT isnan(cast(value AS double))")
    met = arcs.join(known.select(F.col("node").alias("src"), F.col("value").cast("double").alias("x")), "src").join(known.select(F.col("node").alias("dst"), F.col("value").cast("double").alias("y")), "dst")
    sums = met.agg(F.stddev_pop("x").alias("a"), F.stddev_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    return sums.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).alias("assortativity"))


def ego_measures(ties: DataFrame, nodes: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """(node, size, strength, among, density, effective_size, efficiency, constraint) of each node's personal network."""
    arcs = centrality.both_ways(ties)
    sums = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("size"), F.sum("w").alias("strength"))
    density = centrality.ego_density(ties, directed)
    burt = structure.brokerage(ties)
    k = F.col("size")
    possible = k * (k - 1) if directed else k * (k - 1) / 2
    t = sums.join(density, "node", "left").join(burt, "node", "left")
    t = t.select("node", "size", "strength", F.round(F.coalesce(F.col("ego_density") * possible, F.lit(0.0))).cast("bigint").alias("among"), F.col("ego_density").alias("density"), "effective_size", (F.col("effective_size") / k).alias("efficiency"), "constraint")
    if nodes is None:
        return t
    return nodes.select("node").distinct().join(t, "node", "left").fillna(0, ["size", "strength", "among"])


def ego_composition(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, value, count): contacts of each node by group."""
    arcs = centrality.both_ways(ties)
    return arcs.join(groups.where("grp IS NOT NULL").select(F.col("node").alias("dst"), F.col("grp").alias("value")), "dst").groupBy(F.col("src").alias("node"), "value").agg(F.count("*").alias("count"), F.sum("w").alias("weight"))


def ego_homophily(ties: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, known, diversity, diversity_normalized, homophily, homophily_weighted, ei): Blau's index of contacts' groups, its share of the most that
    the number of groups allows, share of contacts like ego by count and by weight, and ego's E-I index."""
    known = groups.where("grp IS NOT NULL")
    kinds = known.agg(F.count_distinct("grp").alias("kinds"))
    own = known.select("node", F.col("grp").alias("own"))
    parts = ego_composition(ties, groups).join(own, "node", "left")
    like = F.col("value") == F.col("own")
    sums = parts.groupBy("node").agg(
        F.sum("count").alias("known"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.sum("weight").alias("weight"), F.max("own").alias("own"),
        F.coalesce(F.sum(F.when(like, F.col("count"))), F.lit(0)).alias("same"), F.coalesce(F.sum(F.when(like, F.col("weight"))), F.lit(0.0)).alias("same_weight"),
    ).join(F.broadcast(kinds))
    blau = 1 - F.col("squares") / (F.col("known") * F.col("known"))
    mine = F.col("own").isNotNull()
    return sums.select(
        "node", "known", blau.alias("diversity"), F.when(F.col("kinds") > 1, blau / (1 - 1 / F.col("kinds"))).alias("diversity_normalized"),
        F.when(mine, F.col("same") / F.col("known")).alias("homophily"), F.when(mine & (F.col("weight") > 0), F.col("same_weight") / F.col("weight")).alias("homophily_weighted"),
        F.when(mine, (F.col("known") - 2 * F.col("same")) / F.col("known")).alias("ei"),
    )


def simple_ego(alters: int, ties: int) -> dict[str, float | None]:
    """Closed-form measures of an interview with equally strong ties: effective size n - 2t/n and what follows from it."""
    if not alters:
        return {"size": 0, "ties": 0, "density": None, "effective_size": None, "efficiency": None}
    effective = alters - 2 * ties / alters
    return {"size": alters, "ties": ties, "density": 2 * ties / (alters * (alters - 1)) if alters > 1 else None, "effective_size": effective, "efficiency": effective / alters}


def histogram(groups: DataFrame) -> DataFrame:
    """(grp, size), largest first, then by name."""
    return groups.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "grp")


def group_means(values: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """(grp, members, known, mean) of a node measure."""
    return groups.where("grp IS NOT NULL").join(values, "node", "left").groupBy("grp").agg(F.count("*").alias("members"), F.count(column).alias("known"), F.avg(column).alias("mean"))


def top_share(values: DataFrame, column: str, k: int = 10) -> DataFrame:
    """One row: share of a measure's total that the k largest hold."""
    top = values.where(F.col(column).isNotNull()).orderBy(F.desc(column), "node").limit(k).agg(F.sum(column).alias("top"))
    return values.agg(F.sum(column).alias("all")).join(F.broadcast(top)).select(F.when(F.col("all") > 0, F.col("top") / F.col("all")).alias("share"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """(node, value, percentile): the share of values that are no larger, from counts of distinct values."""
    ranked = structure.ranks(values, column)
    n = values.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(n)).select("node", "value", ((F.col("n") - F.col("rank") + 1) / F.col("n")).alias("percentile"))


def removal(ties: DataFrame, groups: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(when, ties, cross_ties, pieces, largest_share, mean_path) before and after the nodes in gone (node) leave."""
    from kinweave.operators import components

    rows = None
    left = ties.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    for when, t, who in (("before", ties, nodes), ("after", left, nodes.join(gone, "node", "left_anti"))):
        cross = mixing(t, groups.where("grp IS NOT NULL")).where("from_group <> to_group").agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("cross_ties"))
        size = components.sizes(components.weak(t, who)).select(F.col("components").alias("pieces"), "largest_share")
        n = who.count()
        steps = centrality.path_lengths(t, who, directed=False, most_sources=400 if n > 2500 else n).select("mean_path")
        row = t.agg(F.lit(when).alias("when"), F.count("*").alias("ties")).join(F.broadcast(cross)).join(F.broadcast(size)).join(F.broadcast(steps))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def tie_runs(values: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """(shown, members): values that look equal at the shown precision, with how many look so."""
    return values.where(F.col(column).isNotNull()).groupBy(F.round(column, digits).alias("shown")).agg(F.count("*").alias("members")).where("members > 1")


def standouts(values: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """(node, shown, next): those that share the largest value at the shown precision, and the next value below."""
    shown = values.where(F.col(column).isNotNull()).select("node", F.round(column, digits).alias("shown"))
    top = shown.select("shown").distinct().orderBy(F.desc("shown")).limit(2)
    marks = top.agg(F.max("shown").alias("top"), F.when(F.count("*") > 1, F.min("shown")).alias("next"))
    return shown.join(F.broadcast(marks)).where("shown = top").select("node", "shown", "next")


def shown_part(ties: DataFrame, strengths: DataFrame, most_nodes: int, most_ties: int) -> DataFrame:
    """Ties among the strongest nodes, the heaviest of them: what a drawing has room for."""
    strong = strengths.orderBy(F.desc("strength"), "node").limit(most_nodes).select("node")
    among = ties.join(strong.withColumnRenamed("node", "src"), "src", "left_semi").join(strong.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return among.orderBy(F.desc("w"), "src", "dst").limit(most_ties)


def first_by(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return table.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


#: Attributes that keep books on people rather than group them, prefixes of flags, and names that say what group someone belongs to, best first.
BOOKKEEPING = "responded response completed finished consent deleted deactivated admin owner bot is_bot isbot verified invited invitation kind ego tz tz_offset time_zone timezone".split()
FLAGS = ("is", "has", "was")
GROUP_NAMES = [r"^(dept|department)s?$", r"^(team|squad)s?$", r"^(groups?|drawn_?group)$", r"^(division|unit|org_?unit|section|function|cohort|class|homeroom)$", r"(^|[_\s-])(dept|department)([_\s-]|$)", r"(^|[_\s-])(team|group|division|unit)([_\s-]|$)"]


def groupable(key: str, kind: str) -> bool:
    """Whether an attribute of this name and type may group people: categories and ranks, no flags, no bookkeeping."""
    import re

    flag = re.match(r"^(?:%s)(?:[_\s-]|(?=[A-Z]))" % "|".join(FLAGS), key) is not None
    return kind in ("categorical", "ordinal") and not flag and key.lower() not in BOOKKEEPING


def default_grouping(schema: DataFrame, least: int = 3, most: int = 15, coverage: float = 0.5) -> str | None:
    """The attribute to group by: 3 to 15 values, known for half the people, named like a department, team or group; None if there is none. schema as model.attribute_schema has it."""
    import re

    rows = [r for r in schema.collect() if groupable(r["key"], r["type"]) and least <= r["distinct"] <= most and r["coverage"] >= coverage]  # a row for each attribute
    ranked = [(next((i for i, p in enumerate(GROUP_NAMES) if re.search(p, r["key"], re.I)), None), -r["coverage"], r["key"]) for r in rows]
    named = sorted(x for x in ranked if x[0] is not None)
    return named[0][2] if named else None


def resolved(nodes: DataFrame, reference: str) -> DataFrame:
    """(node_id, key, label) that a reference may mean: the node of that key, else those whose key or label equals it in any case, else those that contain it; at most ten."""
    text = reference.strip().lower()
    key, label = F.lower("key"), F.lower(F.coalesce("label", F.lit("")))
    rank = F.when(F.col("key") == reference.strip(), 0).when((key == text) | (label == text), 1).when(key.contains(text) | label.contains(text), 2)
    found = nodes.withColumn("rank", rank).where(F.col("rank").isNotNull() & F.lit(text != ""))
    best = found.agg(F.min("rank").alias("best"))
    return found.join(F.broadcast(best)).where("rank = best").orderBy("key").limit(10).select("node_id", "key", "label")


def activity_bins(events: DataFrame, bins: int = 60) -> DataFrame:
    """(bin, start, events) of equal spans from the first to the last dated event, empty ones included; no rows without a span."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t)")
    dated = events.where("t IS NOT NULL").select(micros.alias("at"))
    ends = dated.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("hi > lo")
    step = (F.col("hi") - F.col("lo")) / bins
    counts = dated.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("at") - F.col("lo")) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("events"))
    spine = ends.select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    start = F.expr("timestampadd(MICROSECOND, cast(lo + bin * step AS bigint), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return spine.join(counts, "bin", "left").select("bin", start.alias("start"), F.coalesce("events", F.lit(0)).alias("events"))
