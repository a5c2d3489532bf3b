"""Identity, merging, profiles, reported networks."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.model import Dataset
from kinweave.operators import identity, surveys

NODES = "node_id bigint, key string, label string, is_bot boolean, attrs map<string, string>, platform_ids map<string, string>"


def test_suggestions(spark):
    rows = [
        (1, "slack:U1", "Ben Okafor", False, {"email": "ben@x.y"}, {}), (2, "email:ben@x.y", "ben@x.y", False, {}, {}), (3, "x:77", "Okafor, Ben", False, {}, {"handle": "@BenO", "phone": "+44 20 7946 0018"}),
        (4, "discord:9", "beno", False, {"phone": "020 7946 0018"}, {"username": "beno"}), (5, "email:aruiz@x.y", "a", False, {}, {}), (6, "slack:U6", "Ana Ruiz", False, {}, {}), (7, "bots:B7", "Ben Okafor", True, {}, {}), (8, "email:ana.ruiz@z.y", "z", False, {}, {}),
    ]
    got = {(r.a, r.b): (r.confidence, len(r.evidence)) for r in identity.suggestions(spark.createDataFrame(rows, NODES)).collect()}
    assert got[1, 2] == ("high", 1) and got[1, 3] == ("medium", 1) and got[3, 4][0] == "medium" and got[5, 6][0] == "low" and got[6, 8][0] == "medium"
    assert not any(7 in p for p in got)
    crowd = spark.createDataFrame([(i, f"a:{i}", "x", False, {"email": "same@x.y"}, {}) for i in range(60)], NODES)
    assert identity.suggestions(crowd).where("array_contains(evidence, 'same email address same@x.y')").count() == 0


def dataset(spark, people, events):
    nodes = spark.createDataFrame([(i, k, l, False, a) for i, k, l, a in people], "node_id bigint, key string, label string, is_bot boolean, attrs map<string, string>")
    rows = [(i, a, [{"node": n, "role": r} for n, r in t], p) for i, a, t, p in events]
    return Dataset.of(nodes, spark.createDataFrame(rows, "event_id bigint, actor bigint, targets array<struct<node: bigint, role: string>>, parent bigint"), None, spark.createDataFrame([(0,)], "source_id bigint"))


def test_merges(spark):
    people = [(1, "a:1", "Ann", {"team": "x"}), (2, "b:2", "Annie", {"team": "y", "age": "3"}), (3, "c:3", "Cai", {}), (4, "d:4", "A", {"age": "4"})]
    events = [(1, 2, [(1, "to"), (3, "to")], None), (2, 2, [(3, "to")], None), (3, 3, [(1, "to"), (2, "to"), (4, "cc")], 1)]
    ds, log = identity.apply_merges(dataset(spark, people, events), spark.createDataFrame([(1, 2), (4, 1)], "a bigint, b bigint"))
    nodes = {r.node_id: r for r in ds.nodes.collect()}
    assert set(nodes) == {2, 3} and nodes[2].attrs == {"team": "y", "age": "3", "merged_keys": "b:2 | a:1 | d:4"}
    assert {r.event_id: (r.actor, [(x.node, x.role) for x in r.targets]) for r in ds.events.collect()} == {1: (2, [(3, "to")]), 2: (2, [(3, "to")]), 3: (3, [(2, "to"), (2, "cc")])}
    assert {(r.into, r.merged, r.attr, r.kept, r.dropped) for r in log.collect()} == {(2, 1, "team", "y", "x"), (2, 4, "age", "3", "4")}


def test_datasets_united(spark):
    one = dataset(spark, [(1, "a:1", "1", {"team": "x"}), (2, "a:2", "Ben", {})], [(1, 1, [(2, "to")], None), (2, 2, [(1, "to")], 1)])
    two = dataset(spark, [(7, "a:1", "Ann", {"team": "z", "age": "5"}), (8, "b:8", "Dee", {})], [(1, 7, [(8, "cc")], None)])
    ds = identity.merge([one, two])
    nodes = {r.key: r for r in ds.nodes.collect()}
    assert set(nodes) == {"a:1", "a:2", "b:8"} and nodes["a:1"].label == "Ann" and nodes["a:1"].attrs == {"team": "x", "age": "5"}
    names = {r.node_id: k for k, r in nodes.items()}
    got = sorted((names[r.actor], [(names[x.node], x.role) for x in r.targets], r.source) for r in ds.events.collect())
    assert got == [("a:1", [("a:2", "to")], 0), ("a:1", [("b:8", "cc")], 1), ("a:2", [("a:1", "to")], 0)]
    assert ds.events.join(ds.events.select(F.col("event_id").alias("parent")), "parent").count() == 1 and ds.sources.count() == 2


def test_profiles(spark):
    ds = dataset(spark, [(1, "email:ann@x.y", "Ann", {"team": "old"}), (2, "email:ben@x.y", "José", {}), (3, "email:cai@x.y", "Cai", {}), (4, "s:4", "Cai", {})], [(1, 1, [], None)])
    table = spark.createDataFrame([("ann@x.y", "new", "1", ""), ("ben@x.y", "b", "2", ""), ("ben@x.y", "c", "3", ""), ("", "d", "4", ""), ("who@x.y", "e", "5", "")], "mail string, team string, level string, manager string")
    out, report = identity.join_profiles(ds, table, "mail")
    assert {r.node_id: r.attrs for r in out.nodes.collect()}[1] == {"team": "new", "level": "1"}
    assert sorted((r.key, r.outcome) for r in report.collect()) == [("", "empty key"), ("ann@x.y", "exact"), ("ben@x.y", "several rows"), ("ben@x.y", "several rows"), ("who@x.y", "no match")]
    kept, _ = identity.join_profiles(ds, table, "mail", overwrite=False)
    assert {r.node_id: r.attrs for r in kept.nodes.collect()}[1] == {"team": "old", "level": "1"}
    named, report = identity.join_profiles(ds, spark.createDataFrame([("JOSE", "x"), ("cai", "y")], "who string, team string"), "who", "label")
    assert sorted((r.key, r.outcome) for r in report.collect()) == [("JOSE", "normalized"), ("cai", "several people")]
    assert [identity.column_type(table, c) for c in ("level", "team", "manager")] == ["numeric", "categorical", "text"]
    people = spark.createDataFrame([(1, "Ben Okafor"), (2, "B Okafor"), (3, "Ben Okafer"), (4, "Zed Quill"), (5, "okafor, ben")], "node_id bigint, label string")
    got = {(r.a, r.b): r.reason for r in identity.duplicate_names(people).collect()}
    assert got[1, 2] == "initial" and got[1, 3] == "spelling" and got[1, 5] == "same name" and not any(4 in p for p in got)


PEOPLE = [("a", 0), ("b", 1), ("c", 2)]
SAID = {"i1": ("a", [("a", "b"), ("b", "a"), ("b", "c")]), "i2": ("b", [("a", "b"), ("c", "a")]), "i3": (None, [("a", "b")])}


def perceived(spark):
    people = spark.createDataFrame(PEOPLE, "person string, place int")
    informants = spark.createDataFrame([(i, p) for i, (p, _) in SAID.items()], "informant string, person string")
    reports = spark.createDataFrame([(i, f, t) for i, (_, ties) in SAID.items() for f, t in ties], "informant string, frm string, to string")
    return people, informants, reports


def test_perceived_networks(spark):
    people, informants, reports = perceived(spark)
    shares = {(r.frm, r.to): r.share for r in surveys.agreement(reports, informants, people).collect()}
    assert shares == {("a", "b"): 1, ("b", "a"): pytest.approx(1 / 3), ("b", "c"): pytest.approx(1 / 3), ("c", "a"): pytest.approx(1 / 3)}
    assert {(r.frm, r.to) for r in surveys.consensus(reports, informants, people, 1 / 3, True).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {(r.frm, r.to) for r in surveys.own_reports(reports, informants, people).collect()} == {("a", "b"), ("b", "a"), ("b", "c")} - {("b", "c")}
    assert {(r.frm, r.to) for r in surveys.own_reports(reports, informants, people, "intersection").collect()} == {("a", "b")}
    rows = {r.informant: r for r in surveys.accuracy(reports, spark.createDataFrame([("a", "b"), ("b", "c")], "frm string, to string"), people).collect()}
    assert (rows["i1"].hits, rows["i1"].misses, rows["i1"].false_alarms, rows["i1"].correct_rejections) == (2, 0, 1, 3) and rows["i1"].jaccard == pytest.approx(2 / 3) and rows["i3"].hit_rate == 0.5
    assert [r.informant for r in surveys.best_perceivers(surveys.accuracy(reports, spark.createDataFrame([("a", "b")], "frm string, to string"), people)).collect()] == ["i3"]
    others = {r.informant: r for r in surveys.accuracy_against_others(reports, informants, people).collect()}
    assert (others["i3"].hits, others["i3"].misses, others["i3"].false_alarms) == (1, 3, 0)
    both = {r.informant: r.share for r in surveys.symmetry(reports).collect()}
    assert both["i1"] == pytest.approx(2 / 3) and both["i2"] == 0
    top = surveys.disagreement(surveys.agreement(reports, informants, people), 2).collect()
    assert [(r.frm, r.to) for r in top] == [("b", "a"), ("b", "c")] and top[0].score == pytest.approx(8 / 9)
    assert surveys.pairs_of(people).count() == 6 and surveys.pairs_of(people, True).count() == 3


def test_rosters_and_answers(spark):
    people = spark.createDataFrame(PEOPLE, "person string, place int")
    reports = spark.createDataFrame([("b", "b", "a", 3.0), ("a", "a", "b", 1.0), ("c", "c", "a", 2.0), ("c", "c", "b", 0.0)], "respondent string, frm string, to string, value double")
    got = lambda rule: sorted((r.frm, r.to, r.value) for r in surveys.merged_reports(reports, people, rule).collect())
    assert got("union") == [("a", "b", 3.0), ("a", "c", 2.0)] and got("intersection") == [("a", "b", 1.0)] and len(got("respondent")) == 3
    assert {r.person: r.responded for r in surveys.roster_coverage(people, reports.where("respondent <> 'a'")).collect()} == {"a": False, "b": True, "c": True}
    fields = spark.createDataFrame([("a", "b", "a", "strength", "2"), ("a", "b", "b", "strength", "4"), ("a", "b", "a", "kind", "work"), ("a", "b", "b", "kind", "play"), ("a", "b", "a", "note", "x"), ("a", "b", "b", "note", "x")], "a string, b string, reporter string, field string, value string")
    values = {r.field: r.value for r in surveys.combined_fields(fields, {"strength": "scale", "kind": "choice", "note": "text"}).collect()}
    assert values == {"strength": "4", "kind": "work; play", "note": "x"}
    assert [surveys.coerced(v, k, ["Low", "High"]) for v, k in (("3.2", "scale"), ("9", "scale"), ("x", "number"), ("high", "choice"), ("mid", "choice"), (" ", "text"))] == ["3", None, None, "High", None, None]
    cells = spark.createDataFrame([("Never",), ("3",), ("2,5",), ("Daily",), (None,)], "c string").select(surveys.tie_weight(F.col("c")).alias("w")).collect()
    assert [r.w for r in cells] == [0, 3, 2.5, 1, 0]


def test_shared_responses(spark):
    value = {"b": [1, 2], "a": "é"}
    assert surveys.unpacked(surveys.packed(value)) == value and surveys.unpacked("00000000" + surveys.packed(value)[8:]) is None and surveys.canonical_json(value) == '{"a":"é","b":[1,2]}'
    crc = lambda s: f"{zlib.crc32(s.encode()):08x}"
    rows = [(1, "s", "ann", dt.datetime(2024, 1, 1), "x", crc("x")), (2, "s", "ann", dt.datetime(2024, 1, 2), "y", crc("y")), (3, "t", "ben", dt.datetime(2024, 1, 1), "z", crc("z")), (4, "s", "cai", dt.datetime(2024, 1, 1), "w", "deadbeef")]
    got = surveys.accepted(spark.createDataFrame(rows, "response bigint, survey string, respondent string, at timestamp_ntz, body string, crc string"), "s")
    assert {r.response: r.outcome for r in got.collect()} == {1: "replaced", 2: "accepted", 3: "other survey", 4: "invalid"}


def test_interviews(spark):
    settings = spark.createDataFrame([("work", "x"), ("work", "y"), ("work", "z"), ("home", "x")], "setting string, alter string")
    alters = spark.createDataFrame([("x",), ("y",), ("z",), ("q",)], "alter string")
    exceptions = spark.createDataFrame([("y", "x", False), ("q", "z", True)], "a string, b string, tied boolean")
    got = {(r.a, r.b): (r.tied, r.why) for r in surveys.alter_ties(settings, exceptions, alters).collect()}
    assert got == {("x", "y"): (False, "removed"), ("x", "z"): (True, "setting"), ("y", "z"): (True, "setting"), ("q", "z"): (True, "added")}
    roster = spark.createDataFrame([(1, "Ann Bee"), (2, "Cai Dee"), (3, "Cai Dee")], "person bigint, name string")
    names = spark.createDataFrame([(9, "p", "bee, ann"), (9, "q", "Cai Dee"), (9, "r", "Zed")], "ego bigint, alter string, name string")
    assert {r.alter: (r.person, r.matched) for r in surveys.stitched(names, roster).collect()} == {"p": ("1", True), "q": ("9/q", False), "r": ("9/r", False)}
