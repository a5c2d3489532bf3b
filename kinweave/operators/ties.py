"""Weighted ties from event records: turn-taking, copresence, declared ties, affiliation projection.

A tie table is (src, dst, w, n): the summed weight and the number of evidence rows. Each builder takes any
table of the named columns, skips rows with a null end, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the tie rules.
ADJACENCY_MINUTES, ADJACENCY_WEIGHT, MOST_PEOPLE = 10, 0.5, 25


def adjacency_evidence(messages: DataFrame, minutes: float = ADJACENCY_MINUTES, extra: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, t, *extra, *carry) where a message follows another actor's within the window in its context.

    messages: (event_id, t, actor, context, addressed). Only unaddressed messages reply, but each is a
    predecessor. extra: columns that sequences don't cross, such as a calendar window. A context is cut into spans as long as the
    window: a predecessor lies in the same span or is the last of the one before, so a hot context spreads over as many tasks as it has spans."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t)")
    width = int(minutes * 60_000_000)
    timed = messages.where("t IS NOT NULL AND context IS NOT NULL AND actor IS NOT NULL").withColumn("at", micros)
    timed = timed.withColumn("span", F.floor(F.col("at") / max(1, width)))
    place = [*extra, "context", "span"]
    order = F.struct("at", "event_id")
    tails = timed.groupBy(*place).agg(F.max(F.struct("at", "event_id", "actor")).alias("tail"))
    tails = tails.select(*extra, "context", (F.col("span") + 1).alias("span"), "tail")
    inside = Window.partitionBy(*place).orderBy(order)
    seen = timed.withColumn("before", F.lag(F.struct("at", "event_id", "actor")).over(inside)).join(tails, place, "left")
    seen = seen.withColumn("before", F.coalesce("before", "tail"))
    met = seen.where((~F.col("addressed")) & (F.col("before.actor") != F.col("actor")) & (F.col("at") - F.col("before.at") <= width))
    return met.select(F.col("actor").alias("src"), F.col("before.actor").alias("dst"), "t", *extra, *carry)


def build(evidence: DataFrame, amount: float = 1.0, least: float = 0.0) -> DataFrame:
    """Sums evidence (src, dst[, amount]) to ties whose raw weight is above zero and at least the given one."""
    value = F.col("amount") * amount if "amount" in evidence.columns else F.lit(float(amount))
    sums = evidence.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum(value).alias("w"), F.count("*").alias("n"))
    return sums.where((F.col("w") > 0) & (F.col("w") >= least))


def copresence_evidence(presence: DataFrame, most: int = MOST_PEOPLE, normalised: bool = True) -> DataFrame:
    """(src, dst, amount) for each pair at an event; presence: (event, person). Events beyond ``most`` people are
    left out by the rule itself, before anyone is gathered, so an event's pairs are bounded."""
    there = presence.where("event IS NOT NULL AND person IS NOT NULL").distinct()
    small = there.groupBy("event").agg(F.count("*").alias("size")).where(F.col("size").between(2, most))
    people = there.join(small, "event").groupBy("event").agg(F.array_sort(F.collect_list("person")).alias("people"))
    share = (F.lit(1.0) / (F.size("people") - 1)) if normalised else F.lit(1.0)
    first = people.select("people", share.alias("amount"), F.posexplode("people").alias("i", "src"))
    return first.select("src", F.explode(F.expr("slice(people, i + 2, size(people))")).alias("dst"), "amount")


#: Persons of one block of an event in a projection.
BLOCK = 256


def project(affiliations: DataFrame, least_shared: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """(*extra, src, dst, shared, newman[, layer_mask]) of pairs of persons by the events they share; affiliations: (person, event[, layer_mask]).

    A hub's persons are dealt to blocks of bounded size, which meet two by two, so its pairs are made in as many tasks as it has pairs of blocks."""
    masked = "layer_mask" in affiliations.columns
    place = [*extra, "event"]
    known = affiliations.where("person IS NOT NULL AND event IS NOT NULL")
    pairs = known.groupBy(*place, "person").agg(F.bit_or("layer_mask").alias("mask")) if masked else known.select(*place, "person").distinct().withColumn("mask", F.lit(0))
    sizes = pairs.groupBy(*place).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = pairs.join(sizes, place).withColumn("own", F.pmod(F.xxhash64("person"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    one = dealt.where("own = i").select(*place, "i", "j", "size", F.col("person").alias("x"), F.col("mask").alias("mask_x"))
    other = dealt.where("own = j").select(*place, "i", "j", F.col("person").alias("y"), F.col("mask").alias("mask_y"))
    met = one.join(other, [*place, "i", "j"]).where("i < j OR x < y")
    mask = [F.bit_or(F.col("mask_x").bitwiseOR(F.col("mask_y"))).alias("layer_mask")] if masked else []
    sums = met.groupBy(*extra, F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.count("*").alias("shared"), F.sum(1.0 / (F.col("size") - 1)).alias("newman"), *mask)
    return sums.where(F.col("shared") >= least_shared)


def symmetrised(ties: DataFrame) -> DataFrame:
    """(u, v) of each tied pair, both ways, once."""
    return ties.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(ties.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u <> v").distinct()


#: Roles of a target that name a rule of their own; those of a broadcast are left out but for replies.
ADDRESSED_ROLES, MOST_TARGETS = ("reply", "mention", "dm", "to", "cc", "bcc"), 25


def addressed_evidence(messages: DataFrame, targets: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(src, dst, rule, t) of messages (event_id, t, actor, parent) and their targets (event_id, person, role).

    A (rule, target) counts once in a message. With more than ``most`` distinct addressees only replies count. A message
    with a parent and no reply target replies to the parent's actor. Ties to oneself are left out."""
    listed = targets.where(F.col("role").isin(*ADDRESSED_ROLES)).select("event_id", "person", "role").distinct()
    sized = listed.groupBy("event_id").agg(F.count_distinct(F.when(F.col("role") != "reply", F.col("person"))).alias("size"), F.max((F.col("role") == "reply").cast("int")).alias("replies"))
    sent = messages.where("actor IS NOT NULL").join(sized, "event_id", "left")
    named = listed.join(sent.select("event_id", "t", "actor", "size"), "event_id").where((F.col("role") == "reply") | (F.col("size") <= most))
    named = named.select(F.col("actor").alias("src"), F.col("person").alias("dst"), F.col("role").alias("rule"), "t")
    parents = messages.select(F.col("event_id").alias("parent"), F.col("actor").alias("dst"))
    fallback = sent.where("parent IS NOT NULL AND coalesce(replies, 0) = 0").join(parents, "parent").select(F.col("actor").alias("src"), "dst", F.lit("reply").alias("rule"), "t")
    return named.unionByName(fallback).where("dst IS NOT NULL AND src <> dst")


def weighted(ties: DataFrame, how: str = "count") -> DataFrame:
    """Ties with w as it is (count), its log(1 + w) (log) or 1 (binary)."""
    return ties.withColumn("w", {"count": F.col("w"), "log": F.log1p("w"), "binary": F.lit(1.0)}[how])
