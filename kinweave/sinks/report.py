"""Reports on a dataset and on what was done with it, and datasets saved as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import EVENT_TYPES, LAYERS, ROLES, Dataset
from kinweave.settings import Settings


def import_report(ds: Dataset) -> DataFrame:
    """(source, format, view, events, first, last, undated, with_text, untargeted, people, bots, bot_events, contexts, unresolved, type_<t>..., role_<r>..., layer_<l>...) of every source."""
    bots = ds.nodes.where("is_bot").select(F.col("node_id").alias("actor"), F.lit(1).alias("bot"))
    layers = ds.contexts.select(F.col("context_id").alias("context"), F.col("visibility").alias("layer"))
    known = ds.events.select(F.col("event_id").alias("parent"), F.lit(1).alias("found"))
    events = ds.events.join(bots, "actor", "left").join(layers, "context", "left").join(known.dropDuplicates(["parent"]), "parent", "left")
    role = lambda r: F.coalesce(F.sum(F.size(F.filter("targets", lambda x: x["role"] == r))), F.lit(0)).alias(f"role_{r}")
    sums = events.groupBy("source").agg(
        F.count("*").alias("events"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("t").isNull()).alias("undated"), F.count_if((F.col("type") == "message") & (F.length("text") > 0)).alias("with_text"),
        F.count_if(F.size("targets") == 0).alias("untargeted"), F.count("bot").alias("bot_events"), F.count_distinct("context").alias("contexts"), F.count_if(F.col("parent").isNotNull() & F.col("found").isNull()).alias("unresolved"),
        *[F.count_if(F.col("type") == t).alias(f"type_{t}") for t in EVENT_TYPES], *[role(r) for r in ROLES],
        *[F.count_distinct(F.when(F.coalesce("layer", F.lit("unknown")) == v, F.col("context"))).alias(f"layer_{v}") for v in LAYERS],
    )
    ends = ds.events.select("source", F.col("actor").alias("node")).unionByName(ds.events.select("source", F.explode("targets.node").alias("node"))).distinct()
    people = ends.join(bots.withColumnRenamed("actor", "node"), "node", "left").groupBy("source").agg(F.count("*").alias("people"), F.count("bot").alias("bots"))
    listed = ds.sources.select(F.col("source_id").alias("source"), "format", "view", "directed")
    numbers = [c for c in sums.columns if c not in ("source", "first", "last")]
    return listed.join(sums, "source", "left").join(people, "source", "left").fillna(0, [*numbers, "people", "bots"])


#: What a view lets one see, and what not.
VIEWS = {
    "full": ("who interacts with whom across the whole space", "what happens outside it"),
    "ego": ("the owner's contacts and how they reach the owner", "ties among others that the owner never saw"),
    "chat": ("who speaks, when and after whom", "who a message is meant for, unless it names them"),
    "sample": ("patterns among the records sampled", "degrees and paths of the whole"),
    "authored": ("what one account did", "what others did toward it"),
}


def readable(report: DataFrame) -> str:
    """The report as text, a paragraph for each source."""
    out = []
    for r in report.orderBy("source").collect():  # at most 65,535
        can, cannot = VIEWS.get(r["view"], ("", ""))
        span = f", {r['first']:%Y-%m-%d} to {r['last']:%Y-%m-%d}" if r["first"] else ""
        lines = [f"Source {r['source']} ({r['format'] or 'unknown'}): {r['events']} events of {r['people']} people in {r['contexts']} contexts{span}."]
        types = ", ".join(f"{r[f'type_{t}']} {t}" for t in EVENT_TYPES if r[f"type_{t}"])
        lines.append(f"Events: {types or 'none'}. Shows {can}; doesn't show {cannot}." if can else f"Events: {types or 'none'}.")
        notes = [f"{r[c]} {what}" for c, what in (("undated", "without a time"), ("untargeted", "that name nobody"), ("unresolved", "that answer something not in the data"), ("bot_events", "by bots")) if r[c]]
        out.append("\n".join([*lines, *(["Events " + ", ".join(notes) + "."] if notes else [])]))
    return "\n\n".join(out)


def methods(s: Settings, steps: list[tuple[str, dict]] | None = None) -> str:
    """What was run, as Markdown that is the same for the same settings: rules, filters, weighting, and each later step with its parameters."""
    rules = "\n".join(f"- {r}: weight {s.rules[r].weight:g}" for r in s.active()) or "- none"
    shown = lambda v: "all" if v is None else ", ".join(map(str, v)) if isinstance(v, (tuple, list)) else str(v)
    bounds = f"{s.start or 'the start'} to {s.end or 'the end'} (end not included)"
    lines = [
        "## Network", "", f"{'Directed' if s.directed else 'Undirected'} ties, weighted by {s.weighting}; raw amounts of at least {s.min_weight:g}.", "", "Rules:", rules, "",
        f"Time: {bounds}. Layers: {shown(s.visibility)}. Media: {shown(s.media)}. Bots {'left out' if s.exclude_bots else 'kept'}; {len(s.exclude_nodes)} nodes left out by hand.",
        f"Messages to more than {s.max_recipients} people count for replies only; turns follow within {s.window_minutes:g} minutes; meeting weights are {'shared out' if s.normalize else 'kept whole'}.",
    ]
    for f in s.tie_filters:
        lines.append(f"Tie field {f.key}: values {shown(f.values)}, from {f.least if f.least is not None else '-'} to {f.most if f.most is not None else '-'}{', blank ones kept' if f.keep_missing else ''}.")
    if s.tie_weight:
        lines.append(f"Amounts are those of the tie field {s.tie_weight}.")
    if s.two_mode:
        lines.append(f"Two modes: view {s.two_mode.view}, projection by {s.two_mode.projection}, at least {s.two_mode.min_shared} shared.")
    for name, parameters in steps or []:
        lines += ["", f"## {name}", "", ", ".join(f"{k} = {v}" for k, v in sorted(parameters.items())) or "no parameters"]
    return "\n".join(lines) + "\n"


def save(ds: Dataset, path: str) -> None:
    """The four tables of a dataset as Parquet folders."""
    for name in ("nodes", "contexts", "events", "sources"):
        getattr(ds, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Dataset:
    return Dataset.of(*[spark.read.parquet(f"{path}/{n}") for n in ("nodes", "events", "contexts", "sources")])


def saved_json(ds: Dataset, path: str) -> None:
    """A dataset as lines of JSON for each table, for other tools; times are ISO, missing values left out."""
    for name in ("nodes", "contexts", "events", "sources"):
        getattr(ds, name).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
