"""Counts over calendar windows, their coverage and their shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the shift rule.
BASELINE, LEAST_BASELINE, FLAG_AT, MAD_SCALE, MEAN_SCALE, LEVEL_SHARE = 8, 4, 3.5, 1.4826, 1.2533, 0.05


def activity(events: DataFrame, window: str = "day") -> DataFrame:
    """(series, win, events, actors) for events (series, t, actor), gaps between a series' ends filled with 0; undated rows don't count."""
    dated = events.where("t IS NOT NULL AND series IS NOT NULL").select("series", "actor", F.date_trunc(window, F.col("t")).cast("date").alias("win"))
    counts = dated.groupBy("series", "win").agg(F.count("*").alias("events"), F.count_distinct("actor").alias("actors"))
    ends = counts.groupBy("series").agg(F.min("win").alias("a"), F.max("win").alias("b"))
    step = {"day": F.make_dt_interval(days=F.lit(1)), "week": F.make_dt_interval(days=F.lit(7)), "month": F.make_ym_interval(months=F.lit(1))}[window]
    spine = ends.select("series", F.explode(F.sequence("a", "b", step)).alias("win"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(counts, ["series", "win"], "left").select("series", "win", zero("events"), zero("actors"))


def _median(values):
    ordered = F.array_sort(values)
    n = F.size(values)
    at = lambda i: F.element_at(ordered, i.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2


def shifts(counts: DataFrame, column: str = "events") -> DataFrame:
    """(series, win, value, median, z, flagged) against the eight windows before; z is null with fewer than four of them.

    A series' windows are calendar steps, so a series is small at any number of events."""
    before = Window.partitionBy("series").orderBy("win").rowsBetween(-BASELINE, -1)
    held = counts.select("series", "win", F.col(column).cast("double").alias("value")).withColumn("base", F.collect_list("value").over(before)).where(F.size("base") > 0)
    held = held.withColumn("median", _median(F.col("base")))
    held = held.withColumn("off", F.transform("base", lambda x: F.abs(x - F.col("median"))))
    mean_off = F.aggregate("off", F.lit(0.0), lambda a, x: a + x) / F.size("off")
    scale = F.greatest(MAD_SCALE * _median(F.col("off")), MEAN_SCALE * mean_off, LEVEL_SHARE * F.abs("median"), F.sqrt(F.greatest(F.col("median"), F.lit(1.0))), F.lit(1e-9))
    z = F.when(F.size("base") >= LEAST_BASELINE, (F.col("value") - F.col("median")) / scale)
    return held.withColumn("z", z).select("series", "win", "value", "median", "z", F.coalesce(F.abs("z") >= FLAG_AT, F.lit(False)).alias("flagged"))


def coverage(events: DataFrame) -> DataFrame:
    """(series, first, last, dated, share): what each source holds of all dated events (series, t)."""
    per = events.where("t IS NOT NULL AND series IS NOT NULL").groupBy("series").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("dated"))
    return per.join(F.broadcast(per.agg(F.sum("dated").alias("all")))).select("series", "first", "last", "dated", (F.col("dated") / F.col("all")).alias("share"))
