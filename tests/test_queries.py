"""Every query that SQL can express against DuckDB, and the turn-taking rule on small cases."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from kinweave.operators import ties
from kinweave.plans import queries as core

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ["region", "nation", "customer", "supplier", "orders", "lineitem", "events", "part", "documents", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(frame):
    """Columns and rows in one order, whole values; dates and times as text."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == bool or str(frame[c].dtype).startswith(("int", "Int", "uint", "float", "Float")):
            frame[c] = frame[c].astype(float)
        elif "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        else:
            frame[c] = frame[c].map(lambda v: None if v is None or v != v else str(v)[:10] if type(v).__name__ in ("date", "Timestamp") and str(v).endswith("00:00:00") else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = core.queries()[name](spark, SF)
    assert rows.columns and rows.count() >= 0


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = core.queries()[name](spark, SF).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert len(ours) > 0
    pd.testing.assert_frame_equal(tidy(ours), tidy(theirs), check_dtype=False, atol=2e-6)


def turns(spark, rows):
    start = dt.datetime(2024, 1, 1, 0, 9)
    data = [(i, None if m is None else start + dt.timedelta(minutes=m), actor, "c", addressed) for i, (actor, m, addressed) in enumerate(rows)]
    table = spark.createDataFrame(data, "event_id bigint, t timestamp_ntz, actor string, context string, addressed boolean")
    return sorted((r.src, r.dst) for r in ties.adjacency_evidence(table).collect())


def test_adjacency_cases(spark):
    assert turns(spark, [("a", 0, False), ("b", 5, False), ("b", 6, False), ("a", 7, False)]) == [("a", "b"), ("b", "a")]
    assert turns(spark, [("a", 0, False), ("b", 10, False), ("a", 20 + 1 / 60000, False)]) == [("b", "a")]
    assert turns(spark, [("a", 0, False), ("b", 1, True), ("c", 2, False)]) == [("c", "b")]
    assert turns(spark, [("a", None, False), ("b", 1, False), (None, 2, False)]) == []


def test_addressed_cases(spark):
    sent = [(1, None, "a", 9), (2, None, "d", 9), (3, None, "c", 9), (4, None, "e", None), (5, None, "a", None), (9, None, "c", None)]
    messages = spark.createDataFrame(sent, "event_id bigint, t timestamp_ntz, actor string, parent bigint")
    listed = [(1, "b", "reply"), (4, "b", "reply"), *[(4, f"p{i}", "to") for i in range(26)], (5, "b", "to"), (5, "b", "to"), (5, "b", "mention"), (5, "a", "to"), (5, None, "cc")]
    targets = spark.createDataFrame(listed, "event_id bigint, person string, role string")
    got = sorted((r.src, r.dst, r.rule) for r in ties.addressed_evidence(messages, targets).collect())
    assert got == [("a", "b", "mention"), ("a", "b", "reply"), ("a", "b", "to"), ("d", "c", "reply"), ("e", "b", "reply")]


def test_shift_of_a_step(spark):
    from kinweave.operators import series

    start = dt.date(2024, 1, 1)
    rows = [("s", start + dt.timedelta(days=i), 100 + i % 2 if i < 12 else 200) for i in range(16)]
    got = series.shifts(spark.createDataFrame(rows, "series string, win date, events bigint")).orderBy("win").collect()
    assert [(r.win - start).days for r in got if r.flagged] == [12, 13]
    assert [(r.win - start).days for r in got if r.z is None] == [1, 2, 3]


def test_structure_of_empty_tables(spark):
    from kinweave.operators import content, structure

    none = spark.createDataFrame([], "src bigint, dst bigint, w double, n bigint")
    groups = spark.createDataFrame([], "node bigint, grp bigint")
    assert structure.centralization(none).collect()[0][0] is None
    assert structure.degree_assortativity(none).collect()[0][0] is None
    assert structure.modularity(none, groups).collect()[0][0] is None
    assert structure.group_assortativity(none, groups).collect()[0][0] is None
    assert structure.brokerage(none).count() == structure.group_ties(none, groups).count() == 0
    assert content.keywords(spark.createDataFrame([], "unit string, text string")).count() == 0
