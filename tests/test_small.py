"""Shown values, ids in JSON, groupings, references, bins, mappings."""

import datetime as dt
import math

from pyspark.sql import functions as F

from kinweave.functions import shown
from kinweave.operators import groups, recovery, surveys


def test_shown_values():
    assert [shown.number(v) for v in (None, math.nan, math.inf, 0, 1234567, 1234.5, 12.345, 0.04567, 1e-7)] == ["–", "–", "∞", "0", "1,234,567", "1,234", "12.3", "0.0457", "~0"]
    assert shown.aligned([0.174, 0.0878, 0.0001, None]) == ["0.174", "0.088", "~0", "–"] and shown.aligned([1.0, 20.0]) == ["1", "20"] and shown.aligned([150.4, 2.5]) == ["150", "2"]
    assert shown.percent(0.125, 1) == "12.5%" and shown.p_value(0.0004) == "p < 0.001" and shown.p_value(0.0456) == "p = 0.046" and shown.date(dt.datetime(2024, 1, 5)) == "5 Jan 2024"
    assert shown.parsed('window.YTD.x.part0 = [{"id": 1234567890123456789, "s": "12345678901234567890", "f": 1.2345678901234567e5}];') == [{"id": "1234567890123456789", "s": "12345678901234567890", "f": 1.2345678901234567e5}]


def test_small_columns(spark):
    rows = spark.createDataFrame([("https://twitter.com/Ann_B/status/12",), ("https://x.com/i/status/12",), ("-1",)], "u string")
    got = rows.select(shown.status(F.col("u")).alias("s"), shown.clean_id(F.col("u")).alias("i")).collect()
    assert (got[0].s.handle, got[0].s.id) == ("Ann_B", "12") and got[1].s is None and got[2].i is None


def test_groupings_and_references(spark):
    schema = spark.createDataFrame([("is_manager", "categorical", 4, 1.0), ("Team", "categorical", 5, 0.9), ("department", "categorical", 30, 1.0), ("sub_unit", "categorical", 4, 1.0), ("kind", "categorical", 3, 1.0)], "key string, type string, distinct bigint, coverage double")
    assert groups.default_grouping(schema) == "Team" and groups.default_grouping(schema.where("key = 'kind'")) is None and not groups.groupable("hasBadge", "categorical") and groups.groupable("history", "categorical")
    nodes = spark.createDataFrame([(1, "a:1", "Ann"), (2, "a:2", "ann"), (3, "a:3", "Joanna")], "node_id bigint, key string, label string")
    ids = lambda ref: [r.node_id for r in groups.resolved(nodes, ref).collect()]
    assert ids("a:2") == [2] and ids("ANN") == [1, 2] and ids("joan") == [3] and ids("zz") == [] and ids(" ") == []
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h),) for h in (0, 1, 9, 10)] + [(None,)], "t timestamp_ntz")
    assert [r.events for r in groups.activity_bins(events, 5).orderBy("bin").collect()] == [2, 0, 0, 0, 2] and groups.activity_bins(events.limit(1), 5).count() == 0


def test_mappings(spark):
    nodes = spark.createDataFrame([(1, "k:1", "Ann Bee"), (2, "k:2", "Cai"), (3, "k:3", "Dee"), (4, "k:4", "Dee")], "node_id bigint, key string, label string")
    truth = spark.createDataFrame([(10, "k:2", "x"), (11, "q", "ann bee"), (12, "q", "Dee")], "person bigint, key string, label string")
    assert {r.person: (r.node, r.how) for r in recovery.node_mapping(truth, nodes).collect()} == {10: (2, "key"), 11: (1, "label")}
    events = spark.createDataFrame([(1, [(2, "to"), (3, "to")]), (2, [(1, "to")])], "actor bigint, targets array<struct<node: bigint, role: string>>")
    people = spark.createDataFrame([("a", "Bee, Ann"), ("c", "Cai")], "person string, label string")
    assert {(r.frm, r.to) for r in surveys.reference_ties(events, nodes, people).collect()} == {("a", "c"), ("c", "a")}
