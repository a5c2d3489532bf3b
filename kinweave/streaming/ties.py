"""Ties of a stream of events: windowed tie counts with a watermark, and turn-taking with the last message of each context as state.

The batch rules are the measure: on a finished stream in order of time both give the same ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinweave.operators.ties import ADJACENCY_MINUTES

#: How late an event may come.
LATE = "1 hour"


def tie_counts(events: DataFrame, window: str = "1 week", late: str = LATE, offset: str = "4 days") -> DataFrame:
    """(win, src, dst, n, w) of addressed events (event_id, t, actor, weight, targets) by window, each once a target; windows of weeks start on Mondays (the epoch was a Thursday, 4 days before one)."""
    timed = events.withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", late)
    named = timed.select("ts", F.col("actor").alias("src"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.explode(F.array_distinct("targets.node")).alias("dst")).where("src <> dst")
    grouped = named.groupBy(F.window("ts", window, startTime=offset).alias("span"), "src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return grouped.select(F.col("span.start").cast("timestamp_ntz").alias("win"), "src", "dst", "n", "w")


def turns(events: DataFrame, minutes: float = ADJACENCY_MINUTES) -> DataFrame:
    """(src, dst, t, context) where an unaddressed message follows another actor's within the window in its context; events (event_id, t, actor, context, addressed).

    State is one message a context. Messages of a micro-batch are ordered by time; one that is older than the context's last message is too late for the order and makes no tie."""
    width = pd.Timedelta(minutes=minutes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        at, number, actor = state.get if state.exists else (None, None, None)
        out = []
        for r in rows.itertuples():
            here = (r.t, r.event_id)
            if at is not None and here < (pd.Timestamp(at), number):
                continue
            if at is not None and not r.addressed and r.actor != actor and r.t - pd.Timestamp(at) <= width:
                out.append((r.actor, actor, r.t, key[0]))
            at, number, actor = r.t.to_pydatetime(), int(r.event_id), int(r.actor)
        if at is not None:
            state.update((at, number, actor))
        yield pd.DataFrame(out, columns=["src", "dst", "t", "context"])

    timed = events.where("t IS NOT NULL AND context IS NOT NULL AND actor IS NOT NULL").select("event_id", "t", "actor", "context", "addressed")
    return timed.groupBy("context").applyInPandasWithState(step, "src bigint, dst bigint, t timestamp_ntz, context bigint", "at timestamp_ntz, event_id bigint, actor bigint", "append", GroupStateTimeout.NoTimeout)
