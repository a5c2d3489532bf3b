"""The data model: a dataset of four tables, and a network made of it.

nodes (node_id, key, label, is_bot, mode, attrs), contexts (context_id, key, name, kind, visibility, medium),
sources (source_id, format, medium, view, directed, tie_fields) and events (event_id, type, t, actor, context, parent,
weight, source, text, key, attrs, targets). An event's targets are an array of (node, role) on its row, in order, so what concerns
one event needs no join. Times are TIMESTAMP_NTZ in UTC, null where unknown. Missing columns get their default.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of event types, roles, layers (in bit order) and source views.
EVENT_TYPES = ["message", "copresence", "declared", "reaction", "repost", "like", "follow", "join", "leave"]
ROLES = ["to", "cc", "bcc", "mention", "reply", "dm", "attendee", "member", "declared", "subject"]
LAYERS = ["public", "private", "direct", "group", "unknown"]
VIEWS = ["full", "ego", "chat", "sample", "authored"]

_TARGETS = "array<struct<node: bigint, role: string>>"
SCHEMAS = {
    "nodes": {"node_id": ("bigint", None), "key": ("string", None), "label": ("string", None), "is_bot": ("boolean", "false"), "mode": ("int", None), "attrs": ("map<string, string>", None)},
    "contexts": {"context_id": ("bigint", None), "key": ("string", None), "name": ("string", None), "kind": ("string", None), "visibility": ("string", "'unknown'"), "medium": ("string", None)},
    "sources": {"source_id": ("bigint", None), "format": ("string", None), "medium": ("string", None), "view": ("string", "'full'"), "directed": ("boolean", None), "tie_fields": ("array<string>", None)},
    "events": {
        "event_id": ("bigint", None), "type": ("string", "'message'"), "t": ("timestamp_ntz", None), "actor": ("bigint", None), "context": ("bigint", None), "parent": ("bigint", None),
        "weight": ("double", "1.0D"), "source": ("bigint", "0L"), "text": ("string", None), "key": ("string", None), "attrs": ("map<string, array<string>>", None), "targets": (_TARGETS, f"cast(array() AS {_TARGETS})"),
    },
}


def shaped(table: DataFrame, kind: str) -> DataFrame:
    """The table with the kind's columns first; missing columns and nulls get their defaults, other columns stay."""
    spec = SCHEMAS[kind]
    columns = []
    for name, (sql, default) in spec.items():
        col = F.col(name).cast(sql) if name in table.columns else F.lit(None).cast(sql)
        columns.append((F.coalesce(col, F.expr(default).cast(sql)) if default else col).alias(name))
    return table.select(*columns, *[c for c in table.columns if c not in spec])


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, (t, _) in SCHEMAS[kind].items()))


@dataclass(frozen=True)
class Dataset:
    nodes: DataFrame
    contexts: DataFrame
    events: DataFrame
    sources: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, events: DataFrame, contexts: DataFrame | None = None, sources: DataFrame | None = None) -> Dataset:
        """A dataset of tables that may lack columns."""
        spark = events.sparkSession
        return cls(shaped(nodes, "nodes"), shaped(contexts, "contexts") if contexts is not None else empty(spark, "contexts"), shaped(events, "events"), shaped(sources, "sources") if sources is not None else empty(spark, "sources"))

    def with_events(self, events: DataFrame) -> Dataset:
        return replace(self, events=events)


def with_targets(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events with their targets (event_id, node, role[, pos]) gathered on their rows; targets that are the actor are dropped."""
    order = F.col("pos") if "pos" in targets.columns else F.monotonically_increasing_id()
    listed = targets.where("node IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("pos"), F.col("node").cast("bigint").alias("node"), "role"))).alias("listed"))
    own = F.expr("transform(filter(listed, x -> x.node <> coalesce(actor, -1)), x -> named_struct('node', x.node, 'role', x.role))")
    return events.join(listed, "event_id", "left").withColumn("targets", F.coalesce(own, F.expr(f"cast(array() AS {_TARGETS})"))).drop("listed")


def two_mode(nodes: DataFrame) -> bool:
    """Whether the nodes are of two modes: some of each."""
    row = nodes.agg(F.max((F.col("mode") == 0).cast("int")).alias("a"), F.max((F.col("mode") == 1).cast("int")).alias("b")).collect()[0]
    return bool(row["a"] and row["b"])


def mode_value(value: str | Column) -> Column:
    """0 or 1 for 0/1, '0'/'1' and booleans, else null."""
    text = F.lower(F.trim(F.col(value).cast("string") if isinstance(value, str) else value.cast("string")))
    return F.when(text.isin("0", "false"), 0).when(text.isin("1", "true"), 1)


#: Fixed values of the rules that guess an attribute's type.
ORDINAL_VALUES, ORDINAL_ROWS, ID_SHARE, ID_LEAST = 12, 30, 0.9, 50


def attribute_schema(nodes: DataFrame) -> DataFrame:
    """(key, type, n, distinct, coverage, values) of the nodes' attributes, the type guessed from the values.

    Values are listed, sorted, for types with few of them."""
    held = nodes.select(F.explode("attrs").alias("key", "value")).where("value IS NOT NULL AND trim(value) <> ''")
    number = F.expr("try_cast(value AS double)").isNotNull()
    dated = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    per = held.groupBy("key").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("distinct"), F.bool_and(number).alias("numeric"), F.bool_and(dated).alias("dated"),
        F.bool_and(F.lower("value").isin("true", "false", "yes", "no")).alias("yesno"),
    )
    named_id = F.col("key").rlike(r"(?i)(^|_)(id|uuid|email|url)$")
    many = F.col("distinct") > F.greatest(F.lit(ID_LEAST), ID_SHARE * F.col("n"))
    kind = (
        F.when(F.col("key") == "bipartite", "categorical").when(F.col("yesno"), "boolean")
        .when(F.col("numeric"), F.when((F.col("distinct") <= ORDINAL_VALUES) & (F.col("n") > ORDINAL_ROWS), "ordinal").otherwise("numeric"))
        .when(F.col("dated"), "date").when(named_id | many, F.when(F.col("distinct") == F.col("n"), "id").otherwise("text")).otherwise("categorical")
    )
    per = per.withColumn("type", kind)
    listed = held.join(per.where("type IN ('categorical', 'ordinal', 'boolean')").select("key"), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    total = nodes.agg(F.count("*").alias("all"))
    return per.join(listed, "key", "left").join(F.broadcast(total)).select("key", "type", "n", "distinct", (F.col("n") / F.col("all")).alias("coverage"), "values")


def tie_field_types(events: DataFrame) -> DataFrame:
    """(key, type, n, distinct) of the events' tie fields: numeric, or categorical for few or several values at once, else text."""
    held = events.where("attrs IS NOT NULL").select(F.explode("attrs").alias("key", "list"))
    many = held.groupBy("key").agg(F.max((F.size("list") > 1).cast("int")).alias("several"))
    flat = held.select("key", F.explode("list").alias("value"))
    per = flat.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct"), F.bool_and(F.expr("try_cast(value AS double)").isNotNull()).alias("numeric")).join(many, "key")
    few = (F.col("distinct") <= F.greatest(F.lit(ORDINAL_VALUES), 0.5 * F.col("n"))) | (F.col("several") == 1)
    return per.select("key", F.when(F.col("numeric"), "numeric").when(few, "categorical").otherwise("text").alias("type"), "n", "distinct")
