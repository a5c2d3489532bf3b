"""Running sums and row numbers over a whole table, in as many tasks as the values have ranges.

A global window is one task. Here values are cut in ranges at approximate quantiles, which are the same wherever they are computed; each range is
summed on its own and what lies before a range is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def with_range(table: DataFrame, by: Column, ranges: int = RANGES) -> DataFrame:
    """Adds _by and _range, the number of range ends below the value; nulls of ``by`` are in range 0."""
    table = table.withColumn("_by", by.cast("double"))
    at = ", ".join(str(i / ranges) for i in range(1, ranges))
    ends = table.agg(F.expr(f"percentile_approx(_by, array({at}), 1000)").alias("_ends"))  # one row
    below = F.size(F.filter("_ends", lambda e: e < F.col("_by")))
    return table.join(F.broadcast(ends)).withColumn("_range", F.when(F.col("_by").isNull() | F.col("_ends").isNull(), 0).otherwise(below)).drop("_ends")


def running(table: DataFrame, by: Column, amount: str, out: str = "before", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row the sum of the amount over all rows that come before it in ascending order of ``by`` and then of the tie columns."""
    ranged = with_range(table, by)
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum")).withColumn("_earlier", F.coalesce(F.sum("_sum").over(order), F.lit(0)))  # at most RANGES rows
    inside = Window.partitionBy("_range").orderBy("_by", *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(earlier.select("_range", "_earlier")), "_range")
    return joined.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("_earlier")).drop("_by", "_range", "_earlier")


def numbered(table: DataFrame, by: Column, out: str = "number", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's number, from 1, in ascending order of ``by`` and then of the tie columns."""
    return running(table.withColumn("_one", F.lit(1)), by, "_one", out, ties).withColumn(out, F.col(out) + 1).drop("_one")
