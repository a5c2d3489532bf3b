"""Tables with mapped columns: events, edges, nodes, affiliations, incidence; edge lists, matrices, pasted ties."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import times
from kinweave.model import EVENT_TYPES, ROLES, Dataset
from kinweave.sources import base


@dataclass(frozen=True)
class Mapping:
    """Names of the columns of a table; None where it has none."""

    actor: str
    targets: str | None = None
    timestamp: str | None = None
    time_format: str = "iso"
    zone: str = "UTC"
    weight: str | None = None
    type: str | None = None
    context: str | None = None
    text: str | None = None
    directed: str | None = None
    label: str | None = None
    attrs: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    separator: str = ";"
    namespace: str = "csv"
    event_type: str | None = None
    role: str | None = None
    name: str = "table"


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited table with all columns as text, headers made unique."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = head[0]["value"].lstrip("﻿") if head else ""
    delimiter = delimiter or sniff(line)
    table = spark.read.option("header", "false").option("multiLine", "true").option("escape", '"').option("sep", delimiter).csv(path)
    names = unique([c.strip().strip('"') for c in _split(line, delimiter)])
    table = table.toDF(*names[: len(table.columns)], *[f"_{i}" for i in range(len(names), len(table.columns))])
    first = F.regexp_replace(F.trim(F.col(f"`{names[0]}`")), "^﻿", "") if names else F.lit("")
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & (F.trim(first if i == 0 else F.coalesce(F.col(f"`{n}`"), F.lit(""))) == re.sub(r"_\d+$", "", n) if n not in _split(line, delimiter) else F.trim(first if i == 0 else F.coalesce(F.col(f"`{n}`"), F.lit(""))) == n)
    return table.where(~F.coalesce(same, F.lit(False))) if names else table


def _split(line: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=delimiter), [])


def sniff(line: str) -> str:
    """The commonest of comma, semicolon, tab and bar outside quotes."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",;\t|", key=lambda d: (bare.count(d), -",;\t|".index(d)))


def unique(names: list[str]) -> list[str]:
    """Repeated headers get _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for n in (n.strip() for n in names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def cell_weight(cell: Column) -> Column:
    """A number; 1 for x, yes, true or a tick; 0 for blank, no and false; null for other text."""
    text = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    return F.when(text.isin("", "no", "n", "false", "-", "."), 0.0).when(text.isin("x", "yes", "y", "true", "✓", "✔"), 1.0).otherwise(F.regexp_replace(text, ",", ".").try_cast("double"))


def _text(name: str | None) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name else F.lit("")


def _node(value: Column, m: Mapping, event: bool = False) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{m.namespace}:{'event:' if event else ''}"), value))


def _time(m: Mapping) -> Column:
    if not m.timestamp:
        return F.lit(None).cast("timestamp_ntz")
    t = times.to_time(F.when(_text(m.timestamp) != "", _text(m.timestamp)), m.time_format)
    return t if m.zone == "UTC" else times.in_zone(t, m.zone)


def _people(keys: DataFrame, mode: Column | None = None) -> DataFrame:
    """(key, label, mode, attrs) of (key, label): an address is an attribute too."""
    mail = F.when(F.col("label").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.create_map(F.lit("email"), F.lower("label")))
    return keys.where("key IS NOT NULL").select("key", "label", (mode if mode is not None else F.lit(None).cast("int")).alias("mode"), mail.alias("attrs"))


def events(table: DataFrame, m: Mapping, kind: str = "events") -> Dataset:
    """Rows as events, or as ties (kind 'edges'): rows without ends or with a weight that is no number are skipped, and ties of weight 0. A type column names an
    event type, a role or a relation; rows marked undirected in a whole table make the source undirected."""
    edges = kind == "edges"
    said = F.lower(_text(m.type))
    weight = F.when(_text(m.weight) == "", 1.0).otherwise(F.regexp_replace(_text(m.weight), ",", ".").try_cast("double")) if m.weight else F.lit(1.0)
    type_ = F.when(said.isin(*EVENT_TYPES), said).otherwise(m.event_type or ("declared" if edges else "message"))
    role = F.when(said.isin(*ROLES) & ~said.isin(*EVENT_TYPES), said).otherwise(m.role or ("declared" if edges else "to"))
    relation = F.when((said != "") & ~said.isin(*EVENT_TYPES, *ROLES), F.concat(F.lit(f"{m.namespace}:rel:{m.name}#"), _text(m.type)))
    context = F.coalesce(F.when(_text(m.context) != "", F.concat(F.lit(f"{m.namespace}:ctx:"), _text(m.context))), relation, F.lit(f"{m.namespace}:file:{m.name}"))
    rows = table.select(
        _node(_text(m.actor), m).alias("actor"), F.split(_text(m.targets), re.escape(m.separator) if m.separator else "\x00").alias("to"), _time(m).alias("t"), weight.alias("weight"), type_.alias("type"), role.alias("role"),
        context.alias("context"), F.when(_text(m.text) != "", _text(m.text)).alias("text"), F.lower(_text(m.directed)).alias("marked"), F.monotonically_increasing_id().alias("n"),
    )
    rows = rows.withColumn("to", F.filter(F.transform("to", lambda x: F.trim(x)), lambda x: x != "")).where("actor IS NOT NULL AND size(to) > 0 AND weight IS NOT NULL")
    if edges:
        rows = rows.where("weight <> 0")
    prefix = f"{m.namespace}:"
    targets = F.transform("to", lambda x: F.struct(F.concat(F.lit(prefix), x).alias("node"), F.col("role").alias("role")))
    key = F.concat_ws(":", F.lit(f"{m.namespace}:row:{m.name}"), F.col("n").cast("string"))
    directed = None
    if m.directed:
        marks = rows.agg(F.count_if(F.col("marked").isin("undirected", "false", "no", "0", "u")).alias("u"), F.count("*").alias("n")).collect()[0]
        directed = False if marks["n"] and marks["u"] == marks["n"] else None
    kind_of = "network" if edges else "channel"
    keys = rows.select(F.col("actor").alias("key")).unionByName(rows.select(F.explode("to").alias("x")).select(F.concat(F.lit(prefix), "x").alias("key"))).distinct().withColumn("label", F.substring("key", len(prefix) + 1, 10_000))
    places = rows.select(F.col("context").alias("key")).distinct().select("key", F.lit(kind_of).alias("kind"))
    return base.assemble(rows.select(key.alias("key"), "type", "t", "actor", "context", "weight", "text", targets.alias("targets")), _people(keys), places, {"format": "csv", "directed": directed})


def edges(table: DataFrame, m: Mapping) -> Dataset:
    return events(table, m, "edges")


def nodes(table: DataFrame, m: Mapping) -> DataFrame:
    """(key, label, attrs) of a table of people, to be given to a dataset as its people."""
    given = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in m.attrs]), F.array(*[_text(a) for a in m.attrs])) if m.attrs else F.lit(None).cast("map<string,string>"), lambda _, v: v != "")
    return table.select(_node(_text(m.actor), m).alias("key"), F.coalesce(F.when(_text(m.label) != "", _text(m.label)), _text(m.actor)).alias("label"), given.alias("attrs")).where("key IS NOT NULL")


def affiliations(table: DataFrame, m: Mapping) -> Dataset:
    """Rows (person, event): two-mode, undirected."""
    weight = cell_weight(_text(m.weight)) if m.weight else F.lit(1.0)
    weight = F.when(_text(m.weight) == "", 1.0).otherwise(weight) if m.weight else weight
    rows = table.select(_text(m.actor).alias("who"), F.explode(F.split(_text(m.targets), re.escape(m.separator))).alias("what"), _time(m).alias("t"), weight.alias("weight")).withColumn("what", F.trim("what")).where("who <> '' AND what <> '' AND weight <> 0")
    return _two_mode(rows, m)


def incidence(table: DataFrame, m: Mapping) -> Dataset:
    """A person on each row, a column for each event; cells that are no number and no mark are skipped, people without any event stay."""
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("what"), cell_weight(F.col(f"`{e}`")).alias("weight")) for e in m.events]))
    rows = table.select(_text(m.actor).alias("who"), cells.alias("c")).select("who", "c.*").where("who <> ''")
    people = table.select(_text(m.actor).alias("who")).where("who <> ''").distinct()
    return _two_mode(rows.where("weight <> 0").withColumn("t", F.lit(None).cast("timestamp_ntz")), m, people, list(m.events))


def _two_mode(rows: DataFrame, m: Mapping, people: DataFrame | None = None, events_: list[str] | None = None) -> Dataset:
    spark = rows.sparkSession
    who, what = _node(F.col("who"), m), _node(F.col("what"), m, True)
    own = (people if people is not None else rows.select("who").distinct()).select(who.alias("key"), F.col("who").alias("label"), F.lit(0).alias("mode"))
    other = rows.select("what").distinct()
    if events_:
        other = other.unionByName(spark.createDataFrame([(e,) for e in events_], "what string")).distinct()
    other = other.select(what.alias("key"), F.col("what").alias("label"), F.lit(1).alias("mode"))
    records = rows.select(F.concat_ws(":", F.lit(f"{m.namespace}:row:{m.name}"), F.monotonically_increasing_id().cast("string")).alias("key"), F.lit("declared").alias("type"), "t", who.alias("actor"), F.lit(f"{m.namespace}:file:{m.name}").alias("context"), "weight", F.array(F.struct(what.alias("node"), F.lit("member").alias("role"))).alias("targets"))
    places = spark.createDataFrame([(f"{m.namespace}:file:{m.name}", "network")], "key string, kind string")
    return base.assemble(records, own.unionByName(other), places, {"format": "csv", "directed": False})


def matrix(table: DataFrame, m: Mapping) -> Dataset:
    """A square matrix, its first column and its headers names; symmetric ones are undirected, each pair once."""
    columns = [c for c in table.columns if c != m.actor]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("to"), cell_weight(F.col(f"`{c}`")).alias("w")) for c in columns]))
    rows = table.select(_text(m.actor).alias("frm"), cells.alias("c")).select("frm", "c.*").where("frm <> '' AND w <> 0 AND frm <> to")
    pairs = rows.select(F.least("frm", "to").alias("a"), F.greatest("frm", "to").alias("b"), "frm", "w")
    symmetric = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("w").alias("k")).where("n <> 2 OR k <> 1").isEmpty()
    flat = rows.where("frm < to") if symmetric else rows
    return edges(flat.withColumn("directed", F.lit("undirected" if symmetric else "directed")), Mapping("frm", "to", weight="w", directed="directed", separator="\x00", namespace=m.namespace, name=m.name))


#: A -> B, 3 | A - B | A, B, 2 | A tab B
_PASTED = r"^\s*(.+?)\s*(->|<->|--|—|–|\t|,|;|(?<=\s)-(?=\s))\s*(.+?)\s*(?:[,;:\t]\s*(-?\d+(?:[.,]\d+)?))?\s*$"


def pasted(spark: SparkSession, text: str, namespace: str = "paste") -> Dataset:
    """Ties typed as lines: two names with an arrow, a dash or a comma between, and a weight or none; a line with one name is a person. Arrows make ties directed."""
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "n int, line string").where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    part = lambda i: F.regexp_extract("line", _PASTED, i)
    found = lines.select("n", "line", part(1).alias("frm"), part(2).alias("mark"), part(3).alias("to"), part(4).alias("w"))
    ties = found.where("mark <> ''")
    arrows = ties.where("mark = '->'").limit(1).count() > 0
    rows = ties.withColumn("directed", F.lit("directed" if arrows else "undirected"))
    ds = edges(rows, Mapping("frm", "to", weight="w", directed="directed", separator="\x00", namespace=namespace, name="paste"))
    alone = found.where("mark = ''").select(F.concat(F.lit(f"{namespace}:"), F.trim("line")).alias("key"), F.trim("line").alias("label"))
    lone = alone.select(base.number("key").alias("node_id"), "key", "label", F.lit(False).alias("is_bot"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("map<string,string>").alias("attrs"))
    return Dataset(ds.nodes.unionByName(lone.join(ds.nodes.select("key"), "key", "left_anti").select(ds.nodes.columns)), ds.contexts, ds.events, ds.sources)
