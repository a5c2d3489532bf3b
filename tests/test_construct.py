"""Evidence rules and filters on the smallest inputs that tell them apart."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinweave import model, settings
from kinweave.model import Dataset
from kinweave.operators import construct
from kinweave.settings import Settings, TieFilter, TwoMode

START = dt.datetime(2024, 1, 1, 9)
BASE = Settings(directed=True)


def dataset(spark, events, bots=(), kind="channel", visibility="public", sources=None, modes=None):
    """events: (id, type, minute, actor, targets, more); people are 1 to 60, all in context 1."""
    rows = []
    for i, (kind_of, minute, actor, targets, *more) in enumerate(events):
        more = more[0] if more else {}
        t = None if minute is None else START + dt.timedelta(minutes=minute)
        rows.append((more.get("id", i), kind_of, t, actor, more.get("context", 1), more.get("parent"), float(more.get("weight", 1)), more.get("source", 0), [{"node": n, "role": r} for n, r in targets], more.get("attrs")))
    schema = "event_id bigint, type string, t timestamp_ntz, actor bigint, context bigint, parent bigint, weight double, source bigint, targets array<struct<node: bigint, role: string>>, attrs map<string, array<string>>"
    nodes = [(n, f"p{n}", n in bots, (modes or {}).get(n)) for n in range(1, 61)]
    contexts = spark.createDataFrame([(1, kind, visibility, "chat"), (2, kind, "private", "mail")], "context_id bigint, kind string, visibility string, medium string")
    held = spark.createDataFrame(sources or [(0, None, None)], "source_id bigint, directed boolean, tie_fields array<string>")
    return Dataset.of(spark.createDataFrame(nodes, "node_id bigint, key string, is_bot boolean, mode int"), spark.createDataFrame(rows, schema), contexts, held)


def found(ds, s):
    return sorted((r.a, r.b, r.rule, round(r.amount, 6)) for r in construct.evidence(ds, s).collect())


def fates(ds, s):
    return {r.fate: r.events for r in construct.fates(ds, s).collect()}


def test_replies(spark):
    by = BASE.with_rules(reply=True)
    parent = ("message", 0, 3, [(9, "to")], {"id": 0})
    assert found(dataset(spark, [parent, ("message", 1, 1, [(2, "reply")], {"id": 1, "parent": 0})]), by) == [(1, 2, "reply", 1.0)]
    assert found(dataset(spark, [parent, ("message", 1, 1, [(2, "reply")], {"id": 1, "parent": 0})], bots={2}), by) == []
    assert found(dataset(spark, [parent, ("message", 1, 1, [], {"id": 1, "parent": 0})]), by) == [(1, 3, "reply", 1.0)]
    assert found(dataset(spark, [parent, ("message", 1, 3, [], {"id": 1, "parent": 0})]), by) == []


def test_broadcast_and_dedup(spark):
    by = BASE.with_rules(reply=True, to=True, mention=True)
    crowd = [(n, "to") for n in range(10, 36)] + [(2, "reply")]
    ds = dataset(spark, [("message", 0, 1, crowd)])
    assert found(ds, by) == [(1, 2, "reply", 1.0)] and fates(ds, by) == {"used": 1, "broadcast": 1}
    assert len(found(dataset(spark, [("message", 0, 1, crowd[:25])]), by)) == 25
    assert found(dataset(spark, [("message", 0, 1, [(2, "to"), (2, "to")])]), by) == [(1, 2, "to", 1.0)]
    assert found(dataset(spark, [("message", 0, 1, [(2, "to"), (2, "mention")])]), by) == [(1, 2, "mention", 1.0), (1, 2, "to", 1.0)]


def test_turns(spark):
    by = BASE.with_rules(adjacency=True)
    said = lambda *rows: [("message", m, a, [(9, "to")] if addressed else []) for a, m, addressed in rows]
    assert found(dataset(spark, said((1, 0, 0), (2, 5, 0), (2, 6, 0), (1, 7, 0))), by) == [(1, 2, "adjacency", 1.0), (2, 1, "adjacency", 1.0)]
    assert found(dataset(spark, said((1, 0, 0), (2, 10, 0), (1, 20 + 1 / 60000, 0))), by) == [(2, 1, "adjacency", 1.0)]
    assert found(dataset(spark, said((1, 0, 0), (2, 1, 1), (3, 2, 0))), by) == [(3, 2, "adjacency", 1.0)]
    assert found(dataset(spark, said((1, 0, 0), (2, 1, 0), (3, 2, 0)), bots={2}), by) == [(3, 1, "adjacency", 1.0)]
    for kind in ("email_thread", "meeting"):
        assert found(dataset(spark, said((1, 0, 0), (2, 1, 0)), kind=kind), by) == []
    windowed = dataset(spark, said((1, 0, 0), (2, 1, 0)))
    windowed = windowed.with_events(windowed.events.withColumn("win", F.col("event_id")))
    assert construct.evidence(windowed, by, ("win",)).count() == 0


def test_meetings(spark):
    by = BASE.with_rules(copresence=True)
    ds = dataset(spark, [("copresence", 0, 1, [(2, "attendee"), (3, "attendee"), (2, "member")])])
    assert found(ds, by) == [(1, 2, "copresence", 0.5), (1, 3, "copresence", 0.5), (2, 3, "copresence", 0.5)]
    large = dataset(spark, [("copresence", 0, 1, [(n, "attendee") for n in range(2, 27)])])
    assert found(large, by) == [] and fates(large, by) == {"used": 1, "large_meetings": 1}
    assert len(found(dataset(spark, [("copresence", 0, 1, [(n, "attendee") for n in range(2, 27)])], bots={5}), by)) == 300
    net = construct.build(ds, by)
    assert net.ties.count() == 6  # both ways in a directed network


def test_declared_subjects_and_direction(spark):
    by = BASE.with_rules(declared=True, like=True, follow=True, repost=True, reaction=True)
    rows = [("declared", None, 1, [(2, "declared"), (3, "member")]), ("like", 0, 1, [(4, "subject")], {"id": 7}), ("follow", 0, 1, [(5, "subject")]), ("repost", 0, 6, [], {"parent": 7, "id": 9}), ("message", 0, 1, [(8, "member")], {"id": 20})]
    ds = dataset(spark, rows)
    assert found(ds, by) == [(1, 2, "declared", 1.0), (1, 3, "declared", 1.0), (1, 4, "like", 1.0), (1, 5, "follow", 1.0), (6, 1, "repost", 1.0)]
    symmetric = {(r.a, r.b) for r in construct.evidence(ds, by).collect() if r.symmetric}
    assert symmetric == {(1, 3)}
    undirected = dataset(spark, rows[:1], sources=[(0, False, None)])
    assert {(r.src, r.dst) for r in construct.build(undirected, by).ties.collect()} == {(1, 2), (2, 1), (1, 3), (3, 1)}
    assert settings.default_settings(undirected).directed is False and settings.default_settings(ds).directed is True


def test_bounds_and_drop_reasons(spark):
    import dataclasses

    by = dataclasses.replace(BASE.with_rules(to=True), start=START, end=START + dt.timedelta(minutes=10), visibility=("public", "unknown"), media=("chat",), exclude_nodes=(8,))
    rows = [("message", 0, 1, [(2, "to")]), ("message", 10, 1, [(2, "to")]), ("message", None, 1, [(2, "to")]), ("message", 1, 7, [(2, "to")]), ("message", 1, 8, [(2, "to")]), ("message", 1, 1, [(2, "to")], {"context": 2})]
    ds = dataset(spark, rows, bots={7})
    assert fates(ds, by) == {"used": 1, "time": 1, "undated": 1, "bots": 1, "excluded": 1, "visibility": 1}
    assert found(ds, by) == [(1, 2, "to", 1.0)]
    assert fates(ds, dataclasses.replace(by, visibility=None)) == {"used": 1, "time": 1, "undated": 1, "bots": 1, "excluded": 1, "media": 1}


def test_weights_and_layers(spark):
    import dataclasses

    by = dataclasses.replace(BASE.with_rules(to=2.0, cc=0.5), min_weight=2, weighting="log")
    rows = [("message", 0, 1, [(2, "to"), (3, "cc")]), ("message", 1, 1, [(2, "cc")], {"context": 2}), ("message", 2, 1, [(3, "cc")]), ("message", 2, 4, [(5, "to")], {"context": None})]
    ties = {(r.src, r.dst): r for r in construct.build(dataset(spark, rows), by).ties.collect()}
    assert set(ties) == {(1, 2), (4, 5)}
    assert ties[1, 2].raw == 2.5 and ties[1, 2].w == pytest.approx(math.log(3.5)) and ties[1, 2].evidence_to == 1 and ties[1, 2].evidence_cc == 1
    assert ties[1, 2].layer_mask == 0b11 and ties[4, 5].layer_mask == 0b10000
    plain = dataclasses.replace(by, min_weight=0, weighting="binary")
    assert {r.w for r in construct.build(dataset(spark, rows), plain).ties.collect()} == {1.0}


def test_tie_fields(spark):
    import dataclasses

    rows = [("declared", None, 1, [(2, "declared")], {"attrs": {"kind": ["friend"], "strength": ["mid"]}}), ("declared", None, 1, [(3, "declared")], {"attrs": {"kind": ["foe", "friend"], "strength": ["low", "high"]}}),
            ("declared", None, 1, [(4, "declared")]), ("declared", None, 1, [(5, "declared")], {"source": 1}), ("declared", None, 1, [(6, "declared")], {"attrs": {"kind": ["foe"], "years": ["7"]}})]
    ds = dataset(spark, rows, sources=[(0, None, ["kind"]), (1, None, None)])
    by = dataclasses.replace(BASE.with_rules(declared=True), tie_filters=(TieFilter("kind", ("friend",)),))
    assert [b for _, b, *_ in found(ds, by)] == [2, 3, 5] and fates(ds, by)["tie_field"] == 2
    assert [b for _, b, *_ in found(ds, dataclasses.replace(by, tie_filters=(TieFilter("kind", ("friend",), keep_missing=True),)))] == [2, 3, 4, 5]
    assert [b for _, b, *_ in found(ds, dataclasses.replace(by, tie_filters=(TieFilter("years", least=5, most=9),)))] == [5, 6]
    weighed = dataclasses.replace(by, tie_filters=(), tie_weight="strength", tie_order=("low", "mid", "high"))
    assert [(b, x) for _, b, _, x in found(ds, weighed)] == [(2, 2.0), (3, 3.0), (4, 1.0), (5, 1.0), (6, 1.0)]
    assert fates(ds, weighed)["weight_missing"] == 2
    net = construct.build(ds, dataclasses.replace(by, tie_filters=()))
    types = model.tie_field_types(ds.events)
    assert {r.key: r.type for r in types.collect()} == {"kind": "categorical", "strength": "categorical", "years": "numeric"}
    values = {(r.dst, r.field): r.value for r in construct.edge_tie_fields(net, types).collect()}
    assert values == {(2, "kind"): "friend", (2, "strength"): "mid", (3, "kind"): "foe; friend", (3, "strength"): "low; high", (6, "kind"): "foe", (6, "years"): "7.0"}


def test_lineage(spark):
    rows = [("message", 5, 1, [(2, "to")], {"id": 50}), ("message", None, 2, [(1, "to")], {"id": 51}), ("message", 1, 1, [(2, "cc")], {"id": 52})]
    net = construct.build(dataset(spark, rows), BASE.with_rules(to=True, cc=True))
    assert [r.event_id for r in construct.edge_evidence(net, 1, 2).collect()] == [52, 50]
    assert [r.event_id for r in construct.edge_evidence(net, 1, 2, both_directions=True).collect()] == [51, 52, 50]
    assert [r.event_id for r in construct.edge_evidence(net, 1, 2, limit=1).collect()] == [52]


def clubs(spark):
    from graphs import CLUBS

    ids = {n: i for i, n in enumerate(["ana", "ben", "cara", "dev", "eli", "fay", "chess", "choir", "drama", "robotics"], 1)}
    rows = [("declared", None, ids[a], [(ids[b], "member")]) for a, b in CLUBS] + [("declared", None, 1, [(2, "declared"), (60, "declared")])]
    return dataset(spark, rows, modes={i: int(i > 6) for i in range(1, 11)}), ids


def test_two_modes(spark):
    import dataclasses

    ds, ids = clubs(spark)
    by = settings.normalized(ds)
    assert by.two_mode and not by.directed
    net = construct.build(ds, by)
    assert net.ties.count() == 10 and net.nodes.count() == 10
    ends = construct.across_modes(construct.evidence(ds, by), ds.nodes)
    assert ends.where("mode_a = mode_b").count() == 1 and ends.where("mode_a IS NULL OR mode_b IS NULL").count() == 1
    for how, weight in (("count", 2.0), ("binary", 1.0), ("newman", 1 + 1 / 2)):
        view = dataclasses.replace(by, two_mode=TwoMode("mode0", how))
        pairs = {(r.src, r.dst): r for r in construct.build(ds, view).ties.collect()}
        assert pairs[1, 2].shared == 2 and pairs[1, 2].w == weight and len(pairs) == 7
    strong = construct.build(ds, dataclasses.replace(by, two_mode=TwoMode("mode0", "count", 2)))
    assert [(r.src, r.dst) for r in strong.ties.collect()] == [(1, 2)] and strong.nodes.count() == 6
    via = {(r.via, r.a, r.b) for r in construct.edge_evidence(strong, 1, 2).collect()}
    assert via == {(ids["chess"], 1, ids["chess"]), (ids["choir"], 1, ids["choir"]), (ids["chess"], 2, ids["chess"]), (ids["choir"], 2, ids["choir"])}
    flat = settings.normalized(ds, {"two_mode": None})
    assert flat.two_mode is None and construct.build(ds, flat).ties.count() == 12


def test_defaults_and_counts(spark):
    rows = [("message", 0, 1, [(2, "reply")], {"id": 1, "parent": 0}), ("message", 0, 3, [], {"id": 0}), ("message", 1, 1, [], {"id": 2, "parent": 0}), ("message", 1, 3, [], {"id": 3, "parent": 0}), ("message", 2, 4, [(5, "to"), (4, "to")])]
    row = settings.evidence_counts(dataset(spark, rows, kind="group_dm")).collect()[0].asDict()
    assert {k: v for k, v in row.items() if v} == {"reply": 2, "to": 1, "adjacency": 3}
    s = settings.default_settings(dataset(spark, rows, kind="group_dm"))
    assert s.active() == ["reply", "to", "adjacency"] and s.rules["adjacency"].weight == 0.5
    nothing = dataset(spark, rows).with_events(dataset(spark, rows).events.where("false"))
    assert settings.default_settings(nothing).active() == [] and construct.build(nothing, settings.default_settings(nothing)).ties.count() == 0


def test_summary_and_schema(spark):
    ds = dataset(spark, [("message", 0, 1, [(2, "to"), (3, "cc")]), ("message", 1, 2, [(1, "to")])])
    rows = {(r.part, r.name): r.value for r in construct.summary(construct.build(ds, BASE.with_rules(to=True, cc=True))).collect()}
    assert rows["network", "nodes"] == 60 and rows["network", "isolates"] == 57 and rows["network", "edges"] == 3
    assert rows["ties by rule", "to"] == 2 and rows["evidence by rule", "cc"] == 1 and rows["ties by layer", "public"] == 3 and rows["events", "used"] == 2
    attrs = [(1, {"age": "3", "team": "x", "joined": "2024-01-05", "ok": "yes"}), (2, {"age": "4.5", "team": "y", "joined": "2024-02-05T10:00", "ok": "no"}), (3, {"team": "x", "ok": "true"})]
    types = {r.key: (r.type, r.values) for r in model.attribute_schema(spark.createDataFrame(attrs, "node_id bigint, attrs map<string, string>")).collect()}
    assert types == {"age": ("numeric", None), "team": ("categorical", ["x", "y"]), "joined": ("date", None), "ok": ("boolean", ["no", "true", "yes"])}


def test_edge_lists(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (2, 1, 1.0), (3, 3, 9.0), (1, 3, None)], "src bigint, dst bigint, w double")
    assert sorted(map(tuple, construct.from_edges(edges).collect())) == [(1, 2, 3.0), (1, 3, 1.0)]
    assert sorted(map(tuple, construct.from_edges(edges, True).collect())) == [(1, 2, 2.0), (1, 3, 1.0), (2, 1, 1.0)]
