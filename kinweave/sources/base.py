"""From records with text keys to a Dataset with numbers.

A reader gives events (key, type, t, actor, context, parent, weight, text, targets, attrs) whose actor, context, parent and targets are keys such as
``slack:U1``. Numbers are 63-bit hashes of keys, the same wherever a key is read, so no reader needs to number anything and datasets merge by union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import Dataset

RECORDS = (
    "key string, type string, t timestamp_ntz, actor string, context string, parent string, weight double, text string, "
    "targets array<struct<node: string, role: string>>, attrs map<string, array<string>>"
)
PEOPLE = "key string, label string, is_bot boolean, mode int, attrs map<string, string>"
PLACES = "key string, name string, kind string, visibility string, medium string"


def number(key: str | Column) -> Column:
    """The number of a key; null for null."""
    col = F.col(key) if isinstance(key, str) else key
    return F.when(col.isNotNull(), F.shiftrightunsigned(F.xxhash64(col), 1))


def shaped(table: DataFrame, schema: str) -> DataFrame:
    """The table with the schema's columns, missing ones null."""
    fields = [f.strip().split(" ", 1) for f in _fields(schema)]
    return table.select(*[(F.col(n).cast(t) if n in table.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def _fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def assemble(records: DataFrame, people: DataFrame | None = None, places: DataFrame | None = None, source: dict | None = None) -> Dataset:
    """A Dataset of one source. People who only act or are named get the tail of their key as label; targets that are the actor are dropped."""
    spark = records.sparkSession
    source = {"format": None, "medium": None, "view": "full", "directed": None, "tie_fields": None, "id": 0} | (source or {})
    records = shaped(records, RECORDS)
    acted = records.select(F.col("actor").alias("key")).where("key IS NOT NULL")
    named = records.select(F.explode("targets.node").alias("key")).where("key IS NOT NULL")
    found = acted.unionByName(named).distinct()
    listed = shaped(people, PEOPLE) if people is not None else spark.createDataFrame([], PEOPLE)
    listed = listed.where("key IS NOT NULL").groupBy("key").agg(F.first("label", True).alias("label"), F.bool_or(F.coalesce("is_bot", F.lit(False))).alias("is_bot"), F.max("mode").alias("mode"), F.first("attrs", True).alias("attrs"))
    tail = F.regexp_replace("key", r"^[^:]*:(event:)?", "")
    nodes = found.join(listed, "key", "full").select(number("key").alias("node_id"), "key", F.coalesce(F.when(F.col("label") != "", F.col("label")), tail).alias("label"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"), "mode", "attrs")
    used = records.select(F.col("context").alias("key")).where("key IS NOT NULL").distinct()
    held = shaped(places, PLACES) if places is not None else spark.createDataFrame([], PLACES)
    held = held.where("key IS NOT NULL").groupBy("key").agg(*[F.first(c, True).alias(c) for c in ("name", "kind", "visibility", "medium")])
    contexts = used.join(held, "key", "full").select(number("key").alias("context_id"), "key", F.coalesce("name", tail).alias("name"), F.coalesce("kind", F.lit("channel")).alias("kind"), F.coalesce("visibility", F.lit("unknown")).alias("visibility"), F.coalesce("medium", F.lit(source["medium"]).cast("string")).alias("medium"))
    others = F.expr("filter(coalesce(targets, array()), x -> x.node IS NOT NULL AND NOT x.node <=> actor)")
    held = records.where("actor IS NOT NULL").withColumn("others", F.transform(others, lambda x: F.struct(number(x["node"]).alias("node"), x["role"].alias("role"))))
    events = held.select(
        number("key").alias("event_id"), "type", "t", number("actor").alias("actor"), number("context").alias("context"), number("parent").alias("parent"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.lit(source["id"]).cast("bigint").alias("source"), "text", "key", "attrs", F.col("others").alias("targets"),
    )
    row = [(source["id"], source["format"], source["medium"], source["view"], source["directed"], source["tie_fields"])]
    sources = spark.createDataFrame(row, "source_id bigint, format string, medium string, view string, directed boolean, tie_fields array<string>")
    return Dataset.of(nodes, events, contexts, sources)


def parsed(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]], schema: str = RECORDS, pattern: str | None = None) -> DataFrame:
    """Rows that a Python function makes of each whole file; for formats that Spark has no reader for. Files are spread over the cluster, one is one task's work."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = [f.strip().split(" ", 1)[0] for f in _fields(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                rows = []
                for row in parse(name, bytes(data)):
                    rows.append([row.get(n) for n in names])
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return reader.load(path).select("path", "content").mapInPandas(run, schema)


def joined(one: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if one is None else one.unionByName(other)
