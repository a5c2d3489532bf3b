"""Worlds with a known truth, streams, reports, and what measures apply."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave import settings, synth
from kinweave.model import Dataset
from kinweave.operators import applicability, centrality, communities, construct, recovery, ties, timewin
from kinweave.settings import Settings
from kinweave.sinks import report
from kinweave.streaming import ties as streamed

BY = Settings(directed=False).with_rules(dm=True, reply=True)


@pytest.fixture(scope="module")
def bridged(spark):
    return synth.generate(spark, synth.Spec(people=60, groups=3, inside=0.4, across=0.0, brokers=2, seed=3))


def test_world_is_found_again(spark, bridged):
    ds, w = bridged
    net = construct.build(ds, BY)
    row = recovery.tie_recall(net.ties, w.ties).collect()[0]
    assert row.precision == 1 and row.recall > 0.9
    found = communities.louvain(net.pairs(), net.nodes.select(F.col("node_id").alias("node")))
    truth = w.people.where("NOT broker").select("node", F.col("grp").alias("community"))
    parts = recovery.partition_recovery(found, truth).collect()[0]
    assert parts.nmi > 0.8 and recovery.reading(parts.nmi) == "recovered" and recovery.reading(None) == "not measured" and recovery.reading(0.3) == "weak"
    between = centrality.shortest_paths(net.pairs(), directed=False).select("node", F.col("betweenness").alias("value"))
    assert recovery.precision_at(between, w.people.where("broker").select("node")).collect()[0].precision >= 0.5
    again, _ = synth.generate(spark, synth.Spec(people=60, groups=3, inside=0.4, across=0.0, brokers=2, seed=3))
    key = lambda d: d.events.agg(F.count("*"), F.sum(F.xxhash64("event_id", "t", "actor").cast("decimal(38,0)"))).collect()[0]
    assert key(again) == key(ds)


def test_views_and_changes(spark, bridged):
    ds, w = bridged
    rows = synth.interactions(w)
    total = rows.count()
    assert rows.agg(F.min("t"), F.max("t")).collect()[0][0] >= w.spec.start and rows.where("actor = target").count() == 0
    ego = synth.observed(rows, w, "ego", ego=5)
    assert ego.where("actor <> 5 AND target <> 5").count() == 0 and synth.observed(rows, w, "authored", ego=5).where("actor <> 5").count() == 0
    assert 0 < synth.observed(rows, w, "sample", rate=0.3).count() < 0.6 * total and synth.observed(rows, w, "chat", chat=1).select("context").distinct().count() == 1
    weekend = rows.where(F.weekday("t") > 4).count()
    assert weekend < 0.1 * total
    silo, truth = synth.generate(spark, synth.Spec(people=60, groups=3, across=0.1, change="silo", change_at=0.5, days=140, seed=5))
    ts = timewin.series(silo, BY, "week", groups=truth.people.select("node", F.col("grp").cast("string").alias("grp")))
    share = {r.win: r.value for r in ts.network.where("metric = 'cross_share'").collect()}
    assert share[2] > 0.05 and share[17] == 0
    found = timewin.detect_shifts(ts, silo)
    assert recovery.shift_found(found.where("metric IN ('cross_share', 'ties', 'activity', 'tie_retention')"), 10, 2).collect()[0].found
    assert set(synth.PRESETS) >= {"workplace", "online", "professional", "personal", "community", "survey"}


def test_planted_words_and_moods(spark, bridged):
    _, w = bridged
    told = synth.cascade(w, [2, 3], ["zorb", "quix"], p0=0.6)
    by = {(term, node): (t, frm) for term, node, t, frm in told}
    assert by["zorb", 2][1] is None and len(told) > 20 and all(frm is None or by[term, frm][0] < t for term, _, t, frm in told)
    uses = spark.createDataFrame([(term, n, t) for term, n, t, _ in told], "term string, node bigint, t timestamp_ntz")
    rows = synth.with_text(synth.interactions(w), w, {0: 0.9, 1: -0.9}, [synth.Mood(-1.5, grp=0, from_day=60)], uses)
    held = rows.join(w.people.select(F.col("node").alias("actor"), "grp"), "actor")
    good, bad = F.col("text").rlike("|".join(synth.GOOD)), F.col("text").rlike("|".join(synth.BAD))
    mid = dt.datetime(2024, 3, 1)
    count = lambda where, what: held.where(where).where(what).count()
    assert count(F.col("grp") == 1, good) == 0 and count((F.col("grp") == 0) & (F.col("t") < mid), bad) == 0 and count((F.col("grp") == 0) & (F.col("t") > mid), bad) > 0
    early = held.where("text LIKE '%zorb%'").join(uses.where("term = 'zorb'").select(F.col("node").alias("actor"), F.col("t").alias("since")), "actor", "left").where("since IS NULL OR since > t")
    assert held.where("text LIKE '%zorb%'").count() > 0 and early.count() == 0


def test_ranks_and_tests(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 9.0)], "node bigint, value double")
    y = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0), (4, 8.0), (5, 1.0)], "node bigint, value double")
    row = recovery.spearman(x, y).collect()[0]
    assert row.n == 4 and row.rho == pytest.approx(0.9486833)
    t = recovery.welch(spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 5.0), (1, 9.0)], "grp int, value double")).collect()[0]
    assert t["diff"] == 4 and t.t == pytest.approx(4 / (1 / 3 + 7 / 3) ** 0.5) and 0.01 < t.p < 0.02


def test_streams_equal_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(i, start + dt.timedelta(minutes=3 * i), [1, 2, 2, 3, 1][i % 5], 1 + i % 2, i % 4 == 0, [{"node": 9, "role": "to"}] if i % 4 == 0 else []) for i in range(60)]
    schema = "event_id bigint, t timestamp_ntz, actor bigint, context bigint, addressed boolean, targets array<struct<node: bigint, role: string>>"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = streamed.turns(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).outputMode("append").start()
    done.awaitTermination(120)
    got = sorted((r.src, r.dst, r.t) for r in spark.table("turns").collect())
    want = sorted((r.src, r.dst, r.t) for r in ties.adjacency_evidence(spark.createDataFrame(rows, schema)).collect())
    assert got == want and want
    late = spark.createDataFrame([(99, start + dt.timedelta(days=60), 1, 1, True, [{"node": 2, "role": "to"}])], schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("weight", F.lit(1.0))
    done = streamed.tie_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).outputMode("append").start()
    done.awaitTermination(120)
    closed = {(r.win, r.src, r.dst): r.n for r in spark.table("counts").collect()}
    batch = {}
    for _, _, a, _, addressed, _ in rows:
        if addressed:
            batch[dt.datetime(2024, 1, 1), a, 9] = batch.get((dt.datetime(2024, 1, 1), a, 9), 0) + 1
    assert closed == batch


def small(spark, view="full", fmt="slack"):
    nodes = spark.createDataFrame([(i, f"n{i}", i == 5) for i in range(1, 6)], "node_id bigint, key string, is_bot boolean")
    rows = [(1, "message", dt.datetime(2024, 1, 1), 1, 1, None, [(2, "to")], "hi"), (2, "message", None, 2, 1, 1, [(1, "reply")], None), (3, "message", dt.datetime(2024, 1, 3), 5, None, 77, [], "x")]
    events = spark.createDataFrame(rows, "event_id bigint, type string, t timestamp_ntz, actor bigint, context bigint, parent bigint, targets array<struct<node: bigint, role: string>>, text string")
    contexts = spark.createDataFrame([(1, "channel", "private")], "context_id bigint, kind string, visibility string")
    return Dataset.of(nodes, events, contexts, spark.createDataFrame([(0, fmt, view)], "source_id bigint, format string, view string"))


def test_reports(spark, tmp_path):
    ds = small(spark)
    table = report.import_report(ds)
    row = table.collect()[0]
    assert (row.events, row.undated, row.untargeted, row.with_text, row.people, row.bots, row.bot_events, row.unresolved, row.type_message, row.role_to, row.layer_private) == (3, 1, 1, 2, 3, 1, 1, 1, 3, 1, 1)
    text = report.readable(table)
    assert "3 events of 3 people" in text and "1 by bots" in text
    s = settings.default_settings(ds)
    assert report.methods(s, [("Betweenness", {"approx": None})]) == report.methods(s, [("Betweenness", {"approx": None})]) and "- reply: weight 1" in report.methods(s)
    report.save(ds, str(tmp_path / "d"))
    again = report.load(spark, str(tmp_path / "d"))
    assert again.events.count() == 3 and sorted(map(tuple, again.nodes.select("node_id", "key").collect())) == sorted(map(tuple, ds.nodes.select("node_id", "key").collect()))
    report.saved_json(ds, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "events")).count() == 3


def test_applicability(spark):
    net = construct.build(small(spark, "ego"), Settings(directed=True).with_rules(to=True, reply=True))
    f = applicability.facts(net, {"team": ("categorical", 0.5)})
    assert (f.nodes, f.ties, f.isolates, f.pieces, f.dated, f.events) == (4, 2, 2, 1, 2, 3)
    got = applicability.applicability(f)
    assert got["betweenness"][0] == "na" and got["constraint"][0] == "caution" and got["groups"][0] == "caution" and got["hierarchy"][0] == "na" and got["two_mode_density"][0] == "na" and got["detect_shifts"][0] == "caution"
    level = lambda **k: applicability.applicability(applicability.Facts(**({"nodes": 50, "ties": 80, "events": 10, "dated": 10, "days": 300, "messages": 500, "with_text": 500, "pieces": 1, "attributes": {"team": ("categorical", 1.0)}} | k)))
    assert level()["betweenness"] == ("ok", []) and level(directed=False)["reciprocity"][0] == "na" and level(two_mode=True, modes=(5, 5))["clustering"][0] == "na" and level(two_mode=True, modes=(5, 5))["two_mode_density"][0] == "ok"
    assert level(views=["authored"])["pagerank"][0] == "na" and level(views=["sample"])["density"][0] == "caution" and level(ties=0)["degree"][0] == "na" and level(nodes=2)["density"][0] == "na"
    assert level(rules=["copresence"])["clustering"][0] == "caution" and level(dated=0)["time_series"][0] == "na" and level(with_text=0)["topics"][0] == "na" and level(pieces=3)["closeness"][0] == "caution" and level(nodes=5000)["betweenness"][0] == "caution"
    assert set(applicability.GLOSSARY) & set(applicability.MEASURES)
