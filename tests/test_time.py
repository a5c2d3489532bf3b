"""Windows, shift rules, series of networks, comparisons and null models."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from graphs import CLASS, MAJORS, groups, ties
from pyspark.sql import functions as F

from kinweave import shiftrules
from kinweave.functions import ranked
from kinweave.model import Dataset
from kinweave.operators import centrality, measures, structure, timewin, uncertainty
from kinweave.settings import Settings

D = dt.datetime
BY = Settings(directed=True).with_rules(to=True)


def dataset(spark, rows, sources=((0,),)):
    """rows: (time, actor, target or None[, source]) in one channel."""
    data = [(i, t, a, 1, [{"node": b, "role": "to"}] if b else [], r[0] if r else 0) for i, (t, a, b, *r) in enumerate(rows)]
    events = spark.createDataFrame(data, "event_id bigint, t timestamp_ntz, actor bigint, context bigint, targets array<struct<node: bigint, role: string>>, source bigint")
    nodes = spark.range(1, 40).withColumnRenamed("id", "node_id")
    contexts = spark.createDataFrame([(1, "channel")], "context_id bigint, kind string")
    return Dataset.of(nodes, events, contexts, spark.createDataFrame([(s[0],) for s in sources], "source_id bigint"))


def test_windows():
    plan = timewin.windows(D(2024, 1, 31, 12), D(2024, 3, 1), "month")
    assert [(w.start, w.label) for w in plan] == [(D(2024, 1, 1), "2024-01"), (D(2024, 2, 1), "2024-02"), (D(2024, 3, 1), "2024-03")] and plan[0].end == D(2024, 2, 1)
    assert [w.label for w in timewin.windows(D(2024, 1, 3), D(2024, 1, 8), "week")] == ["w/c 2024-01-01", "w/c 2024-01-08"]
    slid = timewin.windows(D(2024, 1, 1), D(2024, 1, 3), dt.timedelta(days=2), dt.timedelta(days=1))
    assert [(w.start.day, w.end.day) for w in slid] == [(1, 3), (2, 4), (3, 5)]
    assert timewin.choose_window(D(2024, 1, 1), D(2024, 2, 1)) == "day" and timewin.choose_window(D(2024, 1, 1), D(2024, 9, 1)) == "week" and timewin.choose_window(D(2010, 1, 1), D(2024, 9, 1)) == "month"
    assert timewin.choose_window(D(2020, 1, 1), D(2024, 1, 1), "day") == "week"
    assert timewin.choose_window(D(1900, 1, 1), D(2024, 1, 1), "month", most=100) == dt.timedelta(days=453)


def test_window_numbers(spark):
    ds = dataset(spark, [(D(2024, 1, 1), 1, 2), (D(2024, 1, 2, 23), 1, 2), (D(2024, 1, 3), 1, 2)])
    plan = timewin.windows(D(2024, 1, 1), D(2024, 1, 3), dt.timedelta(days=2), dt.timedelta(days=1))
    got = sorted((r.event_id, r.win) for r in timewin.windowed(ds.events, plan, dt.timedelta(days=2), dt.timedelta(days=1)).collect())
    assert got == [(i, w.number) for i, t in enumerate([D(2024, 1, 1), D(2024, 1, 2, 23), D(2024, 1, 3)]) for w in plan if w.start <= t < w.end]


def test_robust_rule():
    step = [10 + (-1) ** i for i in range(12)] + [20.0] * 8
    found = shiftrules.robust(step)
    assert len(found) == 1 and found[0]["window"] == 12 and found[0]["direction"] == "up" and found[0]["held_to_end"] and found[0]["level"] == 20
    assert found[0]["z"] == pytest.approx((20 - 10) / max(1.4826 * 1, 1.2533 * 1, 0.5), rel=1e-9)
    assert shiftrules.robust([7.0] * 30) == [] and shiftrules.robust([7.0] * 12 + [7.3] * 4) == []
    assert len(shiftrules.robust([7.0] * 12 + [9.0] + [7.0] * 5)) == 1
    back = shiftrules.robust([10.0] * 8 + [20, 20] + [10.0] * 6)[0]
    assert back["held"] == 2 and back["span"] == 8 and back["last_held"] == 9 and not back["held_to_end"]
    assert shiftrules.robust(step[:12] + [math.nan] * 2 + step[14:])[0]["window"] == 14
    assert shiftrules.robust([100.0] * 10 + [125.0]) and not shiftrules.robust([100.0] * 10 + [125.0], count=True)


def test_cusum_rule():
    step = [10 + (-1) ** i for i in range(12)] + [14.0] * 10
    found = shiftrules.cusum(step)
    assert found and found[0]["direction"] == "up" and found[0]["window"] in (11, 12) and found[0]["z"] > 5
    # against the definition, step by step
    base = step[:8]
    scale = max(1.4826 * 1.0, 1.2533 * 1.0, 0.5)
    hi, signals = 0.0, []
    for t in range(8, len(step)):
        hi = max(0.0, hi + (step[t] - 10) / scale - 0.5)
        if hi > 5:
            signals.append(t)
            hi = 0.0
    assert [f["end"] for f in found if f["direction"] == "up"] == signals and np.median(base) == 10
    assert shiftrules.cusum([5.0] * 40) == []


def test_edges_weekends_and_adjusted_p():
    x = [1.0, 2, 3, 4, 5, 6, 7, 8]
    assert shiftrules.between_edges(x, [3], lambda part, start: [{"window": 0, "end": len(part) - 1, "peak": 0, "last_held": 0}]) == [
        {"window": 0, "end": 1, "peak": 0, "last_held": 0}, {"window": 5, "end": 7, "peak": 5, "last_held": 5}]
    days = [1, 2, 3, 4, 5, 6, 7] * 2
    assert shiftrules.quiet_weekends(days, [2.0 if d > 5 else 10.0 for d in days], [1.0] * 14) and not shiftrules.quiet_weekends(days, [10.0] * 14, [1.0] * 14)
    assert shiftrules.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_series_of_networks(spark):
    """Turn-taking doesn't cross a window; windows without ties are there; the second window keeps one of two ties."""
    week = lambda k, h=0: D(2024, 1, 1) + dt.timedelta(weeks=k, hours=h)
    rows = [(week(0), 1, 2), (week(0, 1), 1, 3), (week(1), 1, 2), (week(1, 2), 2, 1), (week(3), 4, 5), (week(4) - dt.timedelta(minutes=2), 6, None), (week(4), 7, None)]
    ds = dataset(spark, rows)
    who = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(1, 8)], "node bigint, grp string")
    ts = timewin.series(ds, Settings(directed=True).with_rules(to=True, adjacency=True), groups=who)
    got = [tuple(r) for r in ts.turnover.orderBy("win").collect()]
    assert got == [(0, 2, 2, 0, 0, None), (1, 2, 1, 1, 1, pytest.approx(1 / 3)), (2, 0, 0, 2, 0, 0.0), (3, 1, 1, 0, 0, 0.0), (4, 0, 0, 1, 0, 0.0)]
    values = {(r.win, r.metric): r.value for r in ts.network.collect()}
    assert values[1, "reciprocity"] == 1 and values[0, "density"] == pytest.approx(2 / 6) and values[0, "cross_share"] == 0.5 and values[2, "activity"] == 0
    coverage = [r.coverage for r in ts.windows.orderBy("win").collect()]
    assert coverage[:4] == [1, 1, 1, 1] and coverage[4] < 0.01
    assert {(r.win, r.node): r.degree for r in ts.nodes.collect()}[1, 1] == 2
    assert timewin.series(ds.with_events(ds.events.where("false")), BY) is None


def test_shifts_of_a_dataset(spark):
    rng = random.Random(1)
    rows, undisturbed = [], D(2024, 1, 1)
    for k in range(24):
        for _ in range(30 if k < 14 else 90):
            a, b = rng.sample(range(1, 12), 2)
            rows.append((undisturbed + dt.timedelta(weeks=k, minutes=rng.randrange(10_000)), a, b))
    ds = dataset(spark, rows)
    ts = timewin.series(ds, BY)
    found = timewin.detect_shifts(ts, ds).collect()
    assert any(r.target == "network" and r.metric == "activity" and r.window == 14 and r.direction == "up" and r.held_to_end for r in found)
    assert all(r.window >= 13 for r in found)
    cusums = timewin.detect_shifts(ts, ds, "cusum").collect()
    assert any(r.metric == "activity" and r.window in (13, 14) for r in cusums)
    # the same jump where a second source begins is the export's, not people's
    joined = dataset(spark, [(t, a, b, int(t >= undisturbed + dt.timedelta(weeks=14) and i % 3)) for i, (t, a, b) in enumerate(rows)], ((0,), (1,)))
    again = timewin.detect_shifts(timewin.series(joined, BY), joined).collect()
    assert not any(r.metric == "activity" and r.target == "network" and 13 <= r.window <= 15 for r in again)
    table = timewin.shift_table(ts)
    level = timewin.levels_after(timewin.detect_shifts(ts, ds), table).where("metric = 'activity' AND target = 'network'").collect()[0]
    assert level.level_after == 90


def test_before_and_after(spark):
    rng = random.Random(4)
    date = D(2024, 3, 1)
    rows = []
    for day in range(-20, 20):
        for _ in range(4 if day < 0 else 12):
            a, b = rng.sample(range(1, 10), 2)
            rows.append((date + dt.timedelta(days=day, minutes=rng.randrange(1400)), a, b))
    ds = dataset(spark, rows)
    who = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(1, 10)], "node bigint, grp string")
    c = timewin.compare(ds, BY, date, dt.timedelta(days=20), who, reps=99)
    paired = {r.metric: r for r in c.paired.collect()}
    assert paired["strength"].n == 9 and paired["strength"].diff == pytest.approx(2 * (240 - 80) / 9) and paired["strength"].p == pytest.approx(1 / 100)
    assert paired["strength"].dz == pytest.approx(paired["strength"]["diff"] / paired["strength"].sd)
    row = c.turnover.collect()[0]
    assert row.formed - row.dissolved == paired["degree"].diff * 9 / 2
    assert {r.grp: (r.before, r.after) for r in c.groups.collect()}.keys() == {"x", "y"} and c.mixing.count() == 2 and c.cautions.count() == 0
    flat = timewin.compare(dataset(spark, [(t, a, b) for t, a, b in rows if t < date]), BY, date - dt.timedelta(days=10), reps=99)
    assert {r.metric: r.p for r in flat.paired.collect()}["strength"] > 0.05


def test_ranges_and_departures(spark):
    dense = [(D(2024, 5, 1) + dt.timedelta(hours=i), 1 + i % 3, 5) for i in range(96)]
    ds = dataset(spark, [(D(2008, 1, 1), 9, 5), (D(2012, 1, 1), 9, 5), *dense])
    row = timewin.suggested_range(ds.events).collect()[0]
    assert row.start >= D(2024, 5, 1) and row.end <= D(2024, 5, 5) and row.share >= 0.95
    assert timewin.suggested_range(dataset(spark, dense).events).count() == 0
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), 1, 2) for i in range(60)] + [(D(2024, 1, 1) + dt.timedelta(days=i), 3, 2) for i in range(20)] + [(D(2024, 1, 2), 4, 2)]
    assert [r.node for r in timewin.departures(dataset(spark, rows)).collect()] == [3]
    carried = {(r.node, r.source) for r in timewin.node_sources(dataset(spark, [(D(2024, 1, 1), 1, 2, s) for s in (0, 0, 0, 0, 1)], ((0,), (1,)))).collect()}
    assert carried == {(1, 0), (2, 0)}


def test_running_sums(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([1.5, 2.0, -3.0, rng.random()])) for i in range(500)]
    table = spark.createDataFrame(data, "node bigint, x double")
    order = sorted(data, key=lambda r: (r[1], r[0]))
    got = {r.node: r.number for r in ranked.numbered(table, F.col("x"), ties=("node",)).collect()}
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    x = np.sort([v for _, v in data])
    q = {r.q: r.value for r in structure.quantiles(table, "x").collect()}
    assert [q[p] for p in (0.025, 0.5, 0.975)] == pytest.approx(np.quantile(x, [0.025, 0.5, 0.975]).tolist())
    ranks = {r.node: (r["rank"], r.tied) for r in structure.ranks(table, "x").collect()}
    values = [v for _, v in data]
    assert ranks == {i: (1 + sum(w > v for w in values), values.count(v)) for i, v in data}
    shifted = x - x.min()
    n = len(shifted)
    assert measures.gini(table.withColumn("x", F.col("x") - float(x.min())), "x").collect()[0].gini == pytest.approx(2 * (np.arange(1, n + 1) * shifted).sum() / (n * shifted.sum()) - (n + 1) / n)
    assert structure.quantiles(table.where("false"), "x").where("value IS NOT NULL").count() == 0


def test_null_model(spark):
    t = ties(spark, CLASS)
    rows = {(r.statistic, r.node): r for r in uncertainty.null_model(t, False, groups(spark, MAJORS), reps=60, node_statistics_=("constraint", "effective_size", "betweenness")).collect()}
    assert rows["assortativity", None].observed == pytest.approx(0.75, abs=5e-4) and rows["ei", None].observed == pytest.approx(-0.667, abs=5e-4)
    assert rows["assortativity", None].mean == pytest.approx(-0.0738, abs=0.09) and rows["ei", None].mean == pytest.approx(0.432, abs=0.12)
    assert rows["assortativity", None].p == pytest.approx(1 / 61) and rows["ei of CS", None].observed == pytest.approx(-0.429, abs=5e-4)
    assert rows["modularity", None].observed == pytest.approx(0.5, abs=0.02) and ("reciprocity", None) not in rows
    burt = {r.node: r.constraint for r in structure.brokerage(t).collect()}
    between = {r.node: r.betweenness for r in centrality.shortest_paths(t, directed=False).collect()}
    assert all(rows["constraint", n].observed == pytest.approx(burt[n]) and rows["betweenness", n].observed == pytest.approx(between[n]) for n in burt)
    sizes = {r.node: r.effective_size for r in structure.brokerage(t).collect()}
    assert all(rows["effective_size", n].observed == pytest.approx(sizes[n]) for n in sizes)


def test_rewiring_keeps_degrees():
    from kinweave import kernels

    rng = np.random.default_rng(3)
    for directed in (True, False):
        pairs = {(a, b) for a, b in rng.integers(0, 30, (120, 2)).tolist() if a != b and (directed or (b, a) not in {(a, b)})}
        pairs = pairs if directed else {tuple(sorted(p)) for p in pairs}
        src, dst = np.array(sorted(pairs)).T
        a, b = kernels.rewired(src, dst, directed, 2000, rng)
        key = (lambda x, y: (x, y)) if directed else (lambda x, y: tuple(sorted((x, y))))
        assert len({key(x, y) for x, y in zip(a.tolist(), b.tolist())}) == len(src) and (a != b).all()
        count = lambda v: np.bincount(v, minlength=30)
        assert (count(a) == count(src)).all() and (count(b) == count(dst)).all() if directed else (count(a) + count(b) == count(src) + count(dst)).all()
        assert {key(x, y) for x, y in zip(a.tolist(), b.tolist())} != pairs


def test_ranks_under_resampling(spark):
    rng = random.Random(2)
    rows = [(D(2024, 1, 1) + dt.timedelta(hours=i), 1 if i % 2 else rng.randint(2, 8), rng.randint(9, 14)) for i in range(300)]
    ds = dataset(spark, rows)
    got = {r.node: r for r in uncertainty.resample_ranks(ds, BY, "strength", reps=20).collect()}
    assert got[1]["rank"] == 1 and got[1].lo == got[1].hi == 1 and got[1].top_share == 1 and got[30].value == 0
    reading = {r.node: r.reading for r in uncertainty.stability(uncertainty.resample_ranks(ds, BY, "strength", reps=20), top=3).collect()}
    assert reading[1] == "settled" and reading[30] in ("outside", "settled")
    many = uncertainty.resampled(ds, 20).events.where("rep > 0")
    assert many.agg(F.avg("mult")).collect()[0][0] > 1 and abs(many.agg(F.sum("mult")).collect()[0][0] / 6000 - 1) < 0.05
    few = {r.node: r["rank"] for r in uncertainty.resample_ranks(ds, BY, "betweenness", reps=2).collect()}
    assert len(few) == 39
