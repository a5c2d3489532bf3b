"""Networks over time: windows, a series of networks, shifts in it, and comparison of the periods before and after a date.

Events get the number of their window, and evidence and ties are kept apart by it, so all windows are built in one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import shiftrules, storage
from kinweave.functions import ranked
from kinweave.model import Dataset
from kinweave.operators import construct
from kinweave.settings import Settings

#: Fixed values of the choice of windows and ranges.
MOST_WINDOWS, LEAST_WEEKS, MOST_WEEKS, RANGE_SHARE, RANGE_SPAN, RANGE_EVENTS, MATERIAL_SHARE, CARRIER_SHARE, MOST_NODES = 520, 12, 260, 0.95, 0.5, 20, 0.05, 0.25, 200
DAY = timedelta(days=1)


@dataclass(frozen=True)
class Window:
    number: int
    start: datetime
    end: datetime
    label: str


def floor_to(t: datetime, unit: str) -> datetime:
    """The start of the UTC day, Monday week or month."""
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        return day - timedelta(days=day.weekday())
    return day.replace(day=1) if unit == "month" else day


def add_unit(t: datetime, unit: str) -> datetime:
    if unit == "month":
        return (t.replace(day=1) + timedelta(days=32)).replace(day=1)
    return t + (DAY if unit == "day" else 7 * DAY)


def label_for(t: datetime, unit: str) -> str:
    return t.strftime({"month": "%Y-%m", "week": "w/c %Y-%m-%d"}.get(unit, "%Y-%m-%d"))


def windows(first: datetime, last: datetime, window: str | timedelta = "week", step: timedelta | None = None) -> list[Window]:
    """Calendar windows from the floor of the first time; fixed or sliding ones from the first time itself. Ends are exclusive."""
    out: list[Window] = []
    if isinstance(window, timedelta):
        start = first
        while start <= last:
            out.append(Window(len(out), start, start + window, start.strftime("%Y-%m-%d %H:%M")))
            start += step or window
        return out
    start = floor_to(first, window)
    while start <= last:
        end = add_unit(start, window)
        out.append(Window(len(out), start, end, label_for(start, window)))
        start = end
    return out


def count_windows(first: datetime, last: datetime, unit: str) -> int:
    if unit == "month":
        return (last.year - first.year) * 12 + last.month - first.month + 1
    return (last - floor_to(first, unit)) // (DAY if unit == "day" else 7 * DAY) + 1


def choose_window(first: datetime, last: datetime, window: str | timedelta = "auto", most: int = MOST_WINDOWS) -> str | timedelta:
    """'auto' takes weeks where there are 12 to 260 of them, days for less, months for more; units that would be too many get coarser, and beyond
    months equal spans of whole days."""
    if isinstance(window, timedelta):
        return window
    units = ["day", "week", "month"]
    if window == "auto":
        weeks = count_windows(first, last, "week")
        window = "day" if weeks < LEAST_WEEKS else "week" if weeks <= MOST_WEEKS else "month"
    for unit in units[units.index(window) :]:
        if count_windows(first, last, unit) <= most:
            return unit
    return math.ceil((last - first + timedelta(milliseconds=1)) / most / DAY) * DAY


def suggested_range(events: DataFrame, share: float = RANGE_SHARE, most_span: float = RANGE_SPAN) -> DataFrame:
    """(start, end, share): the shortest span of whole days with this share of the dated events, if it is at most half of the full span and there are
    20 events; else no row. Times are numbered and each is met with that of the event which ends its span."""
    dated = events.where("t IS NOT NULL").select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t)").alias("at"))
    numbers = storage.materialize(ranked.numbered(dated, F.col("at"), "i", ("event_id",)), "numbered")
    whole = numbers.agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    sized = whole.withColumn("k", F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))).where(f"n >= {RANGE_EVENTS}")
    low = numbers.join(F.broadcast(sized)).select("i", F.col("at").alias("low"), (F.col("i") + F.col("k") - 1).alias("to"), "first", "last", "n")
    best = low.join(numbers.select(F.col("i").alias("to"), F.col("at").alias("high")), "to").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("span"), "low", "high")).alias("b"), F.max("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n"))
    fits = best.where("b IS NOT NULL AND last > first").where(F.col("b.span") <= most_span * (F.col("last") - F.col("first")))
    day = 86_400_000_000
    ends = fits.select((F.floor(F.col("b.low") / day) * day).alias("x"), ((F.floor(F.col("b.high") / day) + 1) * day).alias("y"), "n")
    inside = numbers.join(F.broadcast(ends)).where("at >= x AND at < y").groupBy("x", "y", "n").agg(F.count("*").alias("held"))
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return inside.select(at("x").alias("start"), at("y").alias("end"), (F.col("held") / F.col("n")).alias("share"))


def bounds(events: DataFrame) -> tuple[datetime, datetime] | None:
    row = events.agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()[0]
    return (row["a"], row["b"]) if row["a"] is not None else None


def windowed(events: DataFrame, plan: list[Window], window: str | timedelta, step: timedelta | None = None) -> DataFrame:
    """Dated events with the number of their window, ``win``; in sliding windows an event is in several. Numbers come from arithmetic, not from a join."""
    first, last = plan[0].start, plan[-1].end
    held = events.where((F.col("t") >= F.lit(first).cast("timestamp_ntz")) & (F.col("t") < F.lit(last).cast("timestamp_ntz")))
    start = F.lit(first).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("t"))
    if window == "month":
        return held.withColumn("win", ((F.year("t") - first.year) * 12 + F.month("t") - first.month).cast("int"))
    size = {"day": DAY, "week": 7 * DAY}.get(window, window)
    size_us, step_us = size // timedelta(microseconds=1), (step or size) // timedelta(microseconds=1)
    if step_us == size_us:
        return held.withColumn("win", F.floor(micros / size_us).cast("int"))
    high = F.floor(micros / step_us).cast("int")
    low = F.greatest(F.floor((micros - size_us) / step_us).cast("int") + 1, F.lit(0))
    return held.where(low <= high).withColumn("win", F.explode(F.sequence(low, F.least(high, F.lit(len(plan) - 1)))))


@dataclass(frozen=True)
class Series:
    """windows (win, start, end, label, coverage, events, nodes, ties), network (win, metric, value), turnover (win, formed, dissolved, persisted,
    jaccard), nodes (win, node, degree, in_degree, out_degree, strength), activity (win, node, events)."""

    plan: list[Window]
    window: str | timedelta
    windows: DataFrame
    network: DataFrame
    turnover: DataFrame
    nodes: DataFrame
    activity: DataFrame
    groups: DataFrame | None
    ties: DataFrame


def series(ds: Dataset, s: Settings, window: str | timedelta = "week", step: timedelta | None = None, start: datetime | None = None, end: datetime | None = None, groups: DataFrame | None = None, most: int = MOST_WINDOWS) -> Series | None:
    """The network of every window under the same settings; turn-taking doesn't cross windows, isolates don't count. groups: (node, grp) for cross-group
    shares. None without dated events."""
    start, end = start or s.start, end or s.end
    dated = ds.events.where("t IS NOT NULL")
    if start is not None:
        dated = dated.where(F.col("t") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        dated = dated.where(F.col("t") < F.lit(end).cast("timestamp_ntz"))
    reach = bounds(dated)
    if reach is None:
        return None
    first, last = start or reach[0], (end - timedelta(microseconds=1)) if end else reach[1]
    window = window if step else choose_window(first, last, window, most)
    plan = windows(first, last, window, step)
    if len(plan) > most:
        raise ValueError(f"{len(plan)} windows; the limit is {most}")
    held = windowed(dated, plan, window, step)
    plain = replace(s, start=None, end=None, include_isolates=False)
    net = construct.build(ds.with_events(held), plain, ("win",))
    ties = storage.materialize(net.ties, "windowed")
    spark = dated.sparkSession
    table = spark.createDataFrame([(w.number, w.start, w.end, w.label) for w in plan], "win int, start timestamp_ntz, end timestamp_ntz, label string")
    seen = lambda w: max(0.0, (min(w.end, last + timedelta(microseconds=1)) - max(w.start, first)) / (w.end - w.start))
    share = spark.createDataFrame([(w.number, float(seen(w))) for w in plan], "win int, coverage double")
    nodes = node_series(ties, net.directed)
    zero = lambda t, c: F.coalesce(F.col(c), F.lit(0)).alias(c)  # noqa: E731, ARG005
    counted = held.groupBy("win").agg(F.count("*").alias("events"))
    tied = ties.groupBy("win").agg(F.count("*").alias("ties"))
    people = nodes.groupBy("win").agg(F.count("*").alias("nodes"))
    rows = table.join(share, "win").join(counted, "win", "left").join(people, "win", "left").join(tied, "win", "left")
    rows = storage.materialize(rows.select("win", "start", "end", "label", "coverage", zero(rows, "events"), zero(rows, "nodes"), zero(rows, "ties")), "windows")
    barred = ds.nodes.where("is_bot").select(F.col("node_id").alias("actor")) if s.exclude_bots else None
    acted = held.join(barred, "actor", "left_anti") if barred is not None else held
    activity = acted.groupBy("win", F.col("actor").alias("node")).agg(F.count("*").alias("events"))
    by_group = None
    if groups is not None:
        by_group = activity.join(groups.where("grp IS NOT NULL"), "node").groupBy("win", "grp").agg(F.sum("events").alias("events"))
    metrics = network_series(ties, rows, net.directed, groups, activity)
    return Series(plan, window, rows, metrics, turnover(ties, table), nodes, activity, by_group, ties)


def node_series(ties: DataFrame, directed: bool) -> DataFrame:
    """(win, node, degree, in_degree, out_degree, strength) of those with ties in the window."""
    ends = ties.select("win", F.col("src").alias("node"), F.lit(1).alias("out"), "w").unionByName(ties.select("win", F.col("dst").alias("node"), F.lit(0).alias("out"), "w"))
    sums = ends.groupBy("win", "node").agg(F.count("*").alias("degree"), F.sum("out").alias("out_degree"), F.sum("w").alias("strength"))
    if not directed:
        return sums.select("win", "node", "degree", F.col("degree").alias("in_degree"), F.col("degree").alias("out_degree"), "strength")
    return sums.select("win", "node", "degree", (F.col("degree") - F.col("out_degree")).alias("in_degree"), "out_degree", "strength")


def network_series(ties: DataFrame, rows: DataFrame, directed: bool, groups: DataFrame | None, activity: DataFrame) -> DataFrame:
    """(win, metric, value): nodes, ties, density, mean degree, reciprocity, transitivity, activity, and with groups the share of coded ties that cross them."""
    base = rows.where("nodes > 0").select("win", F.expr("stack(4, 'nodes', cast(nodes AS double), 'ties', cast(ties AS double), 'density', if(nodes > 1, ties / (nodes * (nodes - 1.0D)), 0.0D) * " + ("1" if directed else "2") + ", 'mean_degree', ties / cast(nodes AS double) * " + ("1" if directed else "2") + ") AS (metric, value)"))
    pairs = ties.select("win", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).groupBy("win", "x", "y").agg(F.count("*").alias("ways"))
    parts = [base]
    if directed:
        parts.append(pairs.groupBy("win").agg(F.lit("reciprocity").alias("metric"), (F.sum(F.when(F.col("ways") > 1, 2).otherwise(0)) / F.sum("ways")).alias("value")))
    both = pairs.select("win", F.col("x").alias("u"), F.col("y").alias("v")).unionByName(pairs.select("win", F.col("y").alias("u"), F.col("x").alias("v")))
    degree = both.groupBy("win", "u").agg(F.count("*").alias("d"))
    up = both.join(degree, ["win", "u"]).join(degree.select("win", F.col("u").alias("v"), F.col("d").alias("e")), ["win", "v"]).where(F.struct("d", "u") < F.struct(F.col("e").alias("d"), F.col("v").alias("u")))
    one, other = up.select("win", F.col("u").alias("a"), F.col("v").alias("b"), F.col("e").alias("eb")), up.select("win", F.col("u").alias("a"), F.col("v").alias("c"), F.col("e").alias("ec"))
    wedges = one.join(other, ["win", "a"]).where(F.struct(F.col("eb").alias("d"), F.col("b").alias("i")) < F.struct(F.col("ec").alias("d"), F.col("c").alias("i")))
    closed = wedges.join(up.select("win", F.col("u").alias("b"), F.col("v").alias("c")), ["win", "b", "c"]).groupBy("win").agg(F.count("*").alias("closed"))
    triples = degree.groupBy("win").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("triples"))
    parts.append(triples.join(closed, "win", "left").select("win", F.lit("transitivity").alias("metric"), F.when(F.col("triples") > 0, 3 * F.coalesce("closed", F.lit(0)) / F.col("triples")).otherwise(0.0).alias("value")))
    total = activity.groupBy("win").agg(F.sum("events").cast("double").alias("value"))
    parts.append(rows.select("win").join(total, "win", "left").select("win", F.lit("activity").alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value")))
    if groups is not None:
        known = groups.where("grp IS NOT NULL")
        coded = ties.join(known.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(known.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst")
        sums = coded.groupBy("win").agg(F.count("*").cast("double").alias("coded"), F.count_if(F.col("a") != F.col("b")).alias("cross"))
        parts += [sums.select("win", F.lit("cross_share").alias("metric"), (F.col("cross") / F.col("coded")).alias("value")), sums.select("win", F.lit("coded_ties").alias("metric"), F.col("coded").alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def turnover(ties: DataFrame, table: DataFrame) -> DataFrame:
    """(win, ties, formed, dissolved, persisted, jaccard) of every window, also of those without ties, against the one before; in the first one all ties are formed."""
    held = ties.select("win", "src", "dst").distinct()
    after = held.select((F.col("win") + 1).alias("win"), "src", "dst", F.lit(1).alias("was"))
    both = held.withColumn("is", F.lit(1)).join(after, ["win", "src", "dst"], "full").groupBy("win").agg(F.count("is").alias("ties"), F.count(F.col("is") + F.col("was")).alias("persisted"), F.count("was").alias("had"))
    rows = table.select("win").join(both, "win", "left").fillna(0, ["ties", "persisted", "had"])
    union = F.col("ties") + F.col("had") - F.col("persisted")
    return rows.select("win", "ties", (F.col("ties") - F.col("persisted")).alias("formed"), (F.col("had") - F.col("persisted")).alias("dissolved"), "persisted", F.when((F.col("win") > 0) & (union > 0), F.col("persisted") / union).alias("jaccard"))


def source_coverage(ds: Dataset, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(source, start, end, events, in_range, share, material): what each source holds of the dated events; material ones hold 5 % of those in range."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("t") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (F.col("t") < F.lit(end).cast("timestamp_ntz"))
    per = ds.events.where("t IS NOT NULL").groupBy("source").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("events"), F.count_if(inside).alias("in_range"))
    total = per.agg(F.sum("in_range").alias("all"))
    share = F.when(F.col("all") > 0, F.col("in_range") / F.col("all")).otherwise(0.0)
    return per.join(F.broadcast(total)).select("source", "start", "end", "events", "in_range", share.alias("share"), (share >= MATERIAL_SHARE).alias("material"))


def node_sources(ds: Dataset, least: float = CARRIER_SHARE) -> DataFrame:
    """(node, source, share): sources with at least a quarter of what a node did or received."""
    acted = ds.events.select(F.col("actor").alias("node"), "source")
    got = ds.events.select(F.explode("targets.node").alias("node"), "source")
    counts = acted.unionByName(got).where("node IS NOT NULL").groupBy("node", "source").agg(F.count("*").alias("n"))
    total = counts.groupBy("node").agg(F.sum("n").alias("all"))
    return counts.join(total, "node").select("node", "source", (F.col("n") / F.col("all")).alias("share")).where(F.col("share") >= least)


def shift_table(ts: Series, metric: str = "degree", most_nodes: int = MOST_NODES) -> DataFrame:
    """(target, id, metric, win, value): the series to scan; node series of the most active people, with 0 where they have no ties."""
    long = lambda target, table, value, name, id_="": table.select(F.lit(target).alias("target"), F.lit(id_).alias("id") if isinstance(id_, str) else id_.cast("string").alias("id"), (F.lit(name) if isinstance(name, str) else name).alias("metric"), "win", value.cast("double").alias("value"))
    t = ts.turnover
    parts = [
        long("network", ts.network.where("metric NOT IN ('mean_degree', 'coded_ties')"), F.col("value"), F.col("metric")),
        long("network", t, F.col("jaccard"), "tie_retention"), long("network", t.where("win > 0"), F.col("formed"), "ties_formed"), long("network", t.where("win > 0"), F.col("dissolved"), "ties_dissolved"),
    ]
    if ts.groups is not None:
        spine = ts.windows.select("win").join(F.broadcast(ts.groups.select("grp").distinct()))
        parts.append(long("group", spine.join(ts.groups, ["win", "grp"], "left"), F.coalesce("events", F.lit(0)), "activity", F.col("grp")))
    busy = ts.activity.groupBy("node").agg(F.sum("events").alias("n")).orderBy(F.desc("n"), "node").limit(most_nodes).select("node")
    spine = ts.windows.select("win").join(F.broadcast(busy))
    parts.append(long("node", spine.join(ts.nodes, ["win", "node"], "left"), F.coalesce(metric, F.lit(0)), metric, F.col("node")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


COUNTS = ("ties", "nodes", "activity", "degree", "in_degree", "out_degree", "ties_formed", "ties_dissolved")


def detect_shifts(ts: Series, ds: Dataset, method: str = "robust", metric: str = "degree", threshold: float | None = None, most_nodes: int = MOST_NODES) -> DataFrame:
    """(target, id, metric, window, end, direction, z, value, baseline, level, held, span, held_to_end, ...): shifts of all series, largest first.

    Windows with less than 60 % coverage, quiet weekends of daily series, and windows beside a source's start or end aren't tested; a person's
    series minds the sources that carry that person. A series is at most MOST_WINDOWS values, scanned by one task each."""
    rows = ts.windows.orderBy("win").collect()  # at most MOST_WINDOWS
    n = len(rows)
    coverage, weekday = [r["coverage"] for r in rows], [r["start"].isoweekday() for r in rows]
    value_of = lambda t, c: {r["win"]: r[c] for r in t.collect()}
    total = value_of(ts.network.where("metric = 'activity'"), "value")
    coded = value_of(ts.network.where("metric = 'coded_ties'"), "value")
    skip_weekends = ts.window == "day" and shiftrules.quiet_weekends(weekday, [total.get(i, 0.0) for i in range(n)], coverage)
    skipped = [c < shiftrules.LEAST_COVERAGE or (skip_weekends and d > 5) for c, d in zip(coverage, weekday)]
    after_weekend = [skip_weekends and i > 0 and weekday[i - 1] == 7 for i in range(n)]
    ties = [float(r["ties"]) for r in rows]
    coded_ties = [float(coded.get(i, ties[i])) for i in range(n)]
    at = lambda t: next((i for i, r in enumerate(rows) if r["start"] <= t < r["end"]), -1)
    sources = source_coverage(ds, ts.plan[0].start, ts.plan[-1].end).collect()  # at most 65,535
    # an export's first and last events aren't changes in behaviour, but those of the whole range are its own ends
    ends = lambda r: {e for e in (at(r["start"]),) if e > 0} | {e for e in (at(r["end"]),) if 0 <= e < n - 1}
    edges_of = {r["source"]: sorted(ends(r)) for r in sources}
    whole = sorted({e for r in sources if r["material"] for e in edges_of[r["source"]]})
    table = shift_table(ts, metric, most_nodes)
    carried = node_sources(ds).groupBy(F.col("node").cast("string").alias("id")).agg(F.collect_set("source").alias("sources"))
    table = table.join(carried.withColumn("target", F.lit("node")), ["target", "id"], "left")
    robust = method == "robust"

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        target, id_, name = frame["target"].iloc[0], frame["id"].iloc[0], frame["metric"].iloc[0]
        x = [math.nan] * n
        for win, value in zip(frame["win"], frame["value"]):
            x[int(win)] = float(value) if value is not None else math.nan
        tied = name in ("tie_retention", "ties_formed", "ties_dissolved")
        x = [math.nan if skipped[i] or (tied and after_weekend[i]) else v for i, v in enumerate(x)]
        if target == "node":
            mine = frame["sources"].iloc[0]
            edges = sorted({e for s in (mine if mine is not None else []) for e in edges_of.get(int(s), [])})
        else:
            edges = whole
        for e in edges:
            for i in range(max(0, e - 1), min(n, e + 2)):
                x[i] = math.nan
        at_most = threshold if threshold is not None else shiftrules.THRESHOLDS[target][0 if robust else 1]
        count = name in COUNTS

        def find(part: list[float], start: int) -> list[dict]:
            noise = shiftrules.noise_floor(name, (coded_ties if name == "cross_share" else ties)[start:]) if target == "network" else None
            return shiftrules.robust(part, at_most, count=count, noise=noise) if robust else shiftrules.cusum(part, at_most, count=count, noise=noise)

        found = shiftrules.between_edges(x, edges, find)
        return pd.DataFrame([{"target": target, "id": id_, "metric": name, **{k: f[k] for k in KEPT}} for f in found], columns=["target", "id", "metric", *KEPT])

    schema = "target string, id string, metric string, window int, end int, peak int, length int, direction string, z double, value double, baseline double, level double, held int, span int, held_to_end boolean, last_held int"
    found = table.groupBy("target", "id", "metric").applyInPandas(scan, schema)
    return found.join(F.broadcast(ts.windows.select(F.col("win").alias("window"), "label")), "window").orderBy(F.desc(F.abs("z")), "target", "id", "metric", "window")


KEPT = ["window", "end", "peak", "length", "direction", "z", "value", "baseline", "level", "held", "span", "held_to_end", "last_held"]


def levels_after(shifts: DataFrame, values: DataFrame) -> DataFrame:
    """Shifts with level_after: the median of a series' values from a shift until the next one; values (target, id, metric, win, value)."""
    from pyspark.sql import Window as Over

    keys = ["target", "id", "metric"]
    spans = shifts.withColumn("until", F.lead("window").over(Over.partitionBy(*keys).orderBy("window")))
    spans = spans.select(*keys, "window", "until")
    met = spans.join(values, keys).where((F.col("win") >= F.col("window")) & (F.col("until").isNull() | (F.col("win") < F.col("until"))))
    return shifts.join(met.groupBy(*keys, "window").agg(F.percentile("value", F.lit(0.5)).alias("level_after")), [*keys, "window"], "left")


@dataclass(frozen=True)
class Comparison:
    """paired (metric, n, before, after, diff, sd, dz, p), turnover, changes (node, metric, before, after, diff), mixing, groups, cautions."""

    paired: DataFrame
    turnover: DataFrame
    changes: DataFrame
    mixing: DataFrame | None
    groups: DataFrame | None
    cautions: DataFrame


def compare(ds: Dataset, s: Settings, date: datetime, span: timedelta | None = None, groups: DataFrame | None = None, reps: int = 2000, seed: int = 1) -> Comparison:
    """Equal spans either side of a date; events on the date count as after. p by event relabelling: under no change each event was as likely in
    either period, so labels are drawn anew for each replicate and the mean difference of people summed again."""
    dated = ds.events.where("t IS NOT NULL")
    reach = bounds(dated)
    if reach is None:
        raise ValueError("no dated events")
    span = span or min(date - reach[0], reach[1] + timedelta(microseconds=1) - date)
    if span <= timedelta(0):
        raise ValueError("the date must have events on both sides")
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    held = dated.where((F.col("t") >= lit(date - span)) & (F.col("t") < lit(date + span))).withColumn("period", (F.col("t") >= lit(date)).cast("int"))
    plain = replace(s, start=None, end=None, include_isolates=False)
    events = ds.with_events(held)
    net = construct.build(events, plain, ("period",))
    ties = storage.materialize(net.ties, "periods")
    nodes = node_series(ties.withColumnRenamed("period", "win"), net.directed).withColumnRenamed("win", "period")
    metrics = ["degree", "in_degree", "out_degree", "strength"]
    value = lambda m, p: F.coalesce(F.max(F.when(F.col("period") == p, F.col(m))).cast("double"), F.lit(0.0))
    wide = nodes.groupBy("node").agg(*[value(m, p).alias(f"{m}_{p}") for m in metrics for p in (0, 1)])
    stacked = ", ".join(f"'{m}', {m}_0, {m}_1" for m in metrics)
    changes = wide.select("node", F.expr(f"stack({len(metrics)}, {stacked}) AS (metric, before, after)")).withColumn("diff", F.col("after") - F.col("before"))
    changes = storage.materialize(changes, "changes")
    sums = changes.groupBy("metric").agg(F.count("*").alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"), F.avg("diff").alias("diff"), F.coalesce(F.stddev("diff"), F.lit(0.0)).alias("sd"))
    sums = sums.withColumn("dz", F.when(F.col("sd") > 0, F.col("diff") / F.col("sd")))
    found = construct.evidence(events, plain)
    p = relabelled(found, held, plain, net.directed, reps, seed) if "adjacency" not in s.active() else None
    paired = sums.join(p, "metric", "left") if p is not None else sums.withColumn("p", F.lit(None).cast("double"))
    mix, by_group = None, None
    if groups is not None:
        known = groups.where("grp IS NOT NULL")
        coded = ties.join(known.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(known.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst")
        e = F.count_if(F.col("a") != F.col("b"))
        mix = coded.groupBy("period").agg(F.count_if(F.col("a") == F.col("b")).alias("within"), e.alias("across")).select("*", ((F.col("across") - F.col("within")) / (F.col("across") + F.col("within"))).alias("ei"), (F.col("across") / (F.col("across") + F.col("within"))).alias("cross_share"))
        by_group = held.join(known.withColumnRenamed("node", "actor"), "actor").groupBy("grp").agg(F.count_if(F.col("period") == 0).alias("before"), F.count_if(F.col("period") == 1).alias("after"))
        by_group = by_group.withColumn("ratio", F.when(F.col("before") > 0, F.col("after") / F.col("before")))
    marks = source_coverage(ds, date - span, date + span).where("material")
    edge = lambda c, kind: marks.where((F.col(c) > lit(date - span + DAY)) & (F.col(c) < lit(date + span - DAY))).select("source", F.lit(kind).alias("kind"), F.col(c).alias("t"))
    table = ties.sparkSession.createDataFrame([(0,), (1,)], "win int")
    change = turnover(ties.withColumnRenamed("period", "win"), table).where("win = 1").drop("win")
    return Comparison(paired, change, changes, mix, by_group, edge("start", "starts").unionByName(edge("end", "ends")))


def relabelled(found: DataFrame, events: DataFrame, s: Settings, directed: bool, reps: int, seed: int) -> DataFrame:
    """(metric, p) of the change in count metrics. Summed over people a change in degree is twice that in the number of ties, so a replicate needs only
    the ties' amounts in either period. Replicate 0 is the observed split. Evidence is summed by tie and event first and each replicate's labels come
    from a hash of event and replicate, so replicates are a grouping column, not a loop."""
    if directed:
        found = found.withColumn("e", F.explode(F.expr("if(symmetric, array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)), array(struct(a AS src, b AS dst)))"))).select("*", "e.*")
    else:
        found = found.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b"))
    weight = F.create_map(*[x for r in s.active() for x in (F.lit(r), F.lit(float(s.rules[r].weight)))])
    amounts = found.groupBy("src", "dst", "event_id").agg(F.sum(F.col("amount") * weight[F.col("rule")]).alias("x")).join(events.select("event_id", "period"), "event_id")
    amounts = storage.materialize(amounts, "amounts")
    spread = amounts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    drawn = F.when(F.col("rep") == 0, F.col("period")).otherwise(F.pmod(F.xxhash64("event_id", "rep", F.lit(seed)), F.lit(2)).cast("int"))
    raw = spread.withColumn("side", drawn).groupBy("rep", "src", "dst", "side").agg(F.sum("x").alias("raw")).where((F.col("raw") > 0) & (F.col("raw") >= s.min_weight))
    sign = F.when(F.col("side") == 1, 1.0).otherwise(-1.0)
    sums = raw.groupBy("rep").agg(F.sum(sign).alias("m"), F.sum(sign * construct.transformed(F.col("raw"), s.weighting)).alias("w"))
    all_reps = found.sparkSession.range(reps + 1).select(F.col("id").cast("int").alias("rep"))
    sums = storage.materialize(all_reps.join(sums, "rep", "left").fillna(0.0), "replicates")
    seen = sums.where("rep = 0").select(F.col("m").alias("m0"), F.col("w").alias("w0"))
    near = lambda x, x0: F.abs(x) >= F.abs(x0) - 1e-9 * F.greatest(F.lit(1.0), F.abs(x0))
    counts = sums.where("rep > 0").join(F.broadcast(seen)).agg(F.count_if(near(F.col("m"), F.col("m0"))).alias("m"), F.count_if(near(F.col("w"), F.col("w0"))).alias("w"))
    p = lambda c: (F.col(c) + 1) / (reps + 1)
    return counts.select(F.explode(F.create_map(F.lit("degree"), p("m"), F.lit("in_degree"), p("m"), F.lit("out_degree"), p("m"), F.lit("strength"), p("w"))).alias("metric", "p"))


def departures(ds: Dataset, today: datetime | None = None) -> DataFrame:
    """(node, events, last, silent_days): people with five events or more who fell silent for 14 days and 15 % of the span at least, in data of 28 days or more."""
    dated = ds.events.where("t IS NOT NULL AND actor IS NOT NULL")
    whole = dated.agg(F.min("t").alias("first"), F.max("t").alias("final"))
    if today is not None:
        whole = whole.withColumn("final", F.lit(today).cast("timestamp_ntz"))
    span = F.timestamp_diff("SECOND", F.col("first"), F.col("final")) / 86400
    per = dated.groupBy(F.col("actor").alias("node")).agg(F.count("*").alias("events"), F.max("t").alias("last")).join(F.broadcast(whole))
    silent = F.timestamp_diff("SECOND", F.col("last"), F.col("final")) / 86400
    return per.where((span >= 28) & (F.col("events") >= 5) & (silent >= F.greatest(F.lit(14.0), 0.15 * span))).select("node", "events", "last", silent.alias("silent_days"))

