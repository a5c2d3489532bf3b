"""Events to weighted ties, driven by settings: filters, evidence rules, networks, and the evidence behind a tie.

One evidence table serves everything: networks, windows, resamples and lineage. ``extra`` names event columns (a window, a period, a
replicate) that evidence and ties are kept apart by; turn-taking doesn't cross them. An event's own targets are on its row, so most rules
need no join; joins are with the excluded nodes, contexts and, for events that name nobody, their parents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.model import LAYERS, Dataset
from kinweave.operators import ties as turns
from kinweave.settings import ADDRESSING, NO_TURNS, Settings, TieFilter

#: Rules of a role, of the type of an event whose subject is a target, and events without either.
_BY_ROLE = {r: r for r in ("reply", "mention", "dm", "to", "cc", "bcc", "declared")}
_BY_TYPE = {t: t for t in ("repost", "like", "follow", "reaction", "declared")}


def _case(column: str, cases: dict[str, str], default: str = "cast(NULL AS string)") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + f" ELSE {default} END" if cases else default


def excluded(ds: Dataset, s: Settings) -> DataFrame:
    """(node, why) of nodes that take no part."""
    listed = F.col("node_id").isin(*s.exclude_nodes) if s.exclude_nodes else F.lit(False)
    bot = F.col("is_bot") & F.lit(s.exclude_bots)
    return ds.nodes.where(bot | listed).select(F.col("node_id").alias("node"), F.when(bot, "bots").otherwise("excluded").alias("why"))


def carriers(ds: Dataset, key: str) -> DataFrame:
    """(source) of the sources that carry a tie field: declared, or seen on an event. At most 65,535 rows."""
    declared = ds.sources.where(F.array_contains("tie_fields", key)).select(F.col("source_id").alias("source"))
    seen = ds.events.where(F.col("attrs").isNotNull() & F.map_contains_key("attrs", key)).select("source")
    return declared.unionByName(seen).distinct()


def _passes(f: TieFilter) -> Column:
    """Whether one of the field's values is listed and in range; null where the field is blank."""
    test = "true"
    if f.values is not None:
        listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in f.values)
        test += f" AND x IN ({listed})" if listed else " AND false"
    if f.least is not None or f.most is not None:
        test += f" AND try_cast(x AS double) >= {float('-inf') if f.least is None else f.least!r}D" if f.least is not None else " AND try_cast(x AS double) IS NOT NULL"
        test += f" AND try_cast(x AS double) <= {f.most!r}D" if f.most is not None else ""
    return F.expr(f"coalesce(exists(attrs['{f.key}'], x -> {test}), false)")


def _tie_weight(s: Settings) -> Column:
    """The field's largest value: a number, 1 or 0 for a truth value, an ordered choice's position."""
    order = "".join(f" WHEN '{v}' THEN {i + 1}.0D" for i, v in enumerate(s.tie_order))
    choice = f"CASE x{order} ELSE NULL END" if order else "cast(NULL AS double)"
    return F.expr(f"array_max(transform(attrs['{s.tie_weight}'], x -> coalesce(CASE lower(x) WHEN 'true' THEN 1.0D WHEN 'false' THEN 0.0D END, try_cast(x AS double), {choice})))")


def sifted(ds: Dataset, s: Settings) -> DataFrame:
    """All events with their fate: used, or the first reason they are dropped for. Adds layer, kind, undirected, amount, weightless."""
    out = excluded(ds, s)
    events = ds.events if "mult" in ds.events.columns else ds.events.withColumn("mult", F.lit(1.0))
    contexts = ds.contexts.select(F.col("context_id").alias("context"), "kind", F.col("visibility").alias("layer"), F.col("medium").alias("context_medium"))
    sources = ds.sources.select(F.col("source_id").alias("source"), (~F.coalesce("directed", F.lit(True))).alias("undirected"), F.col("medium").alias("source_medium"))
    events = events.join(contexts, "context", "left").join(F.broadcast(sources), "source", "left").join(out.withColumnRenamed("node", "actor"), "actor", "left")
    layer = F.when(F.col("context").isNotNull(), F.coalesce("layer", F.lit("unknown"))).otherwise("unknown")
    events = events.withColumn("layer", layer).withColumn("undirected", F.coalesce("undirected", F.lit(False)))
    no = F.lit(False)
    fate = F.when(F.col("mult") == 0, "resampled")
    if s.start is not None or s.end is not None:
        bound = lambda t: F.lit(t).cast("timestamp_ntz")
        early = F.col("t") < bound(s.start) if s.start is not None else no
        late = F.col("t") >= bound(s.end) if s.end is not None else no
        fate = fate.when(F.col("t").isNull(), "undated").when(early | late, "time")
    fate = fate.when(F.col("why").isNotNull(), F.col("why"))
    if s.visibility is not None:
        fate = fate.when(~F.col("layer").isin(*s.visibility), "visibility")
    if s.media:
        medium = F.when(F.col("context").isNotNull(), F.col("context_medium")).otherwise(F.col("source_medium"))
        fate = fate.when(~F.coalesce(medium.isin(*s.media), no), "media")
    for i, f in enumerate(s.tie_filters):
        if f.values is None and f.least is None and f.most is None:
            continue
        events = events.join(F.broadcast(carriers(ds, f.key).withColumn(f"carries_{i}", F.lit(True))), "source", "left")
        blank = F.expr(f"attrs['{f.key}']").isNull()
        fate = fate.when(F.col(f"carries_{i}") & F.when(blank, F.lit(not f.keep_missing)).otherwise(~_passes(f)), "tie_field")
    amount, weightless = F.col("weight"), no
    if s.tie_weight:
        events = events.join(F.broadcast(carriers(ds, s.tie_weight).withColumn("weighs", F.lit(True))), "source", "left").withColumn("field", _tie_weight(s))
        usable = F.coalesce(F.col("weighs"), no) & F.coalesce(F.col("field") >= 0, no)
        amount, weightless = F.when(usable, F.col("field")).otherwise(F.col("weight")), F.coalesce(F.col("weighs"), no) & ~usable
    return events.withColumn("fate", fate.otherwise("used")).withColumn("amount", amount * F.col("mult")).withColumn("weightless", weightless)


def evidence(ds: Dataset, s: Settings, extra: tuple[str, ...] = ()) -> DataFrame:
    """(*extra, event_id, t, a, b, rule, amount, layer, symmetric): each piece of tie evidence that passes the filters."""
    return _evidence(ds, s, sifted(ds, s), extra)


def _evidence(ds: Dataset, s: Settings, events: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    out = excluded(ds, s).select("node")
    used = events.where("fate = 'used'")
    active = set(s.active())
    carried = [*extra, "event_id", "t", "actor", "amount", "layer"]
    most = s.max_recipients if s.max_recipients > 0 else None
    parts = []
    if "copresence" in active:
        parts.append(_copresence(used, out, s, carried))
    plain = used.where("type <> 'copresence'")
    addressing = ", ".join(f"'{r}'" for r in ADDRESSING)
    crowd = f"size(targets) > {most} AND size(array_distinct(transform(filter(targets, x -> x.role IN ({addressing})), x -> x.node))) > {most}" if most else "false"
    subject = _case("type", {k: v for k, v in _BY_TYPE.items() if v in active})
    by_role = _case("x.role", {k: v for k, v in _BY_ROLE.items() if v in active} | ({"subject": "#"} if active & set(_BY_TYPE.values()) else {}) | ({"member": "@"} if "declared" in active else {}))
    rule = f"CASE {by_role} WHEN '#' THEN {subject} WHEN '@' THEN if(type = 'declared', 'declared', NULL) ELSE {by_role} END"
    listed = f"transform(targets, x -> named_struct('rule', if(broadcast AND x.role IN ({addressing}), NULL, {rule}), 'b', x.node, 'symmetric', x.role = 'member' OR undirected))"
    marked = plain.withColumn("broadcast", F.expr(crowd)).withColumn("listed", F.expr(f"array_distinct(filter({listed}, y -> y.rule IS NOT NULL AND y.b <> actor))"))
    # a target counts once for a rule, as it was named first
    pairs = "transform(listed, y -> struct(y.rule, y.b))"
    once = f"if(size(array_distinct({pairs})) = size(listed), listed, filter(listed, (y, i) -> array_position({pairs}, struct(y.rule, y.b)) = i + 1))"
    named = marked.select(*carried, F.explode(F.expr(once)).alias("x")).select(*carried, "x.*")
    parts.append(_without(named, out, "b"))
    fallback = {"message": "reply"} | {t: t for t in _BY_TYPE}
    fallback = _case("type", {k: v for k, v in fallback.items() if v in active})
    silent = "if(type = 'message', NOT exists(targets, x -> x.role = 'reply'), NOT exists(targets, x -> x.role = 'subject' OR (type = 'declared' AND x.role IN ('declared', 'member'))))"
    parents = ds.events.select(F.col("event_id").alias("parent"), F.col("actor").alias("b"))
    answered = plain.where("parent IS NOT NULL").where(F.expr(silent)).select(*carried, "parent", F.expr(fallback).alias("rule"), F.col("undirected").alias("symmetric")).where("rule IS NOT NULL").join(parents, "parent").where("b <> actor")
    parts.append(_without(answered, out, "b").select(parts[-1].columns))
    if "adjacency" in active:
        spoken = used.where(F.expr("type = 'message' AND context IS NOT NULL AND t IS NOT NULL") & ~F.coalesce(F.col("kind").isin(*NO_TURNS), F.lit(False)))
        spoken = spoken.select(*extra, "event_id", "t", "actor", "context", (F.size("targets") > 0).alias("addressed"), (F.col("weight") * F.col("mult")).alias("amount"), "layer")
        met = turns.adjacency_evidence(spoken, s.window_minutes, extra, ("event_id", "amount", "layer"))
        parts.append(met.select(*extra, "event_id", "t", F.col("src").alias("actor"), "amount", "layer", F.lit("adjacency").alias("rule"), F.col("dst").alias("b"), F.lit(False).alias("symmetric")))
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return all_parts.select(*extra, "event_id", "t", F.col("actor").alias("a"), "b", "rule", "amount", "layer", "symmetric")


def _without(rows: DataFrame, out: DataFrame, column: str) -> DataFrame:
    return rows.join(out.withColumnRenamed("node", column), column, "left_anti")


def _people(used: DataFrame, out: DataFrame, carried: list[str]) -> DataFrame:
    """Meetings with the people that take part; an event's people are bounded by its own row."""
    there = "array_distinct(concat(array(actor), transform(filter(targets, x -> x.role IN ('attendee', 'member')), x -> x.node)))"
    one = used.where("type = 'copresence'").select(*carried, F.explode(F.expr(there)).alias("person"))
    return _without(one, out, "person").groupBy(*carried).agg(F.array_sort(F.collect_list("person")).alias("people")).where(F.size("people") > 1)


def _meeting_cap(s: Settings) -> int | None:
    return s.max_meeting or (s.max_recipients if s.max_recipients > 0 else None)


def _copresence(used: DataFrame, out: DataFrame, s: Settings, carried: list[str]) -> DataFrame:
    people = _people(used, out, carried)
    if _meeting_cap(s):
        people = people.where(F.size("people") <= _meeting_cap(s))
    share = F.col("amount") / (F.size("people") - 1) if s.normalize else F.col("amount")
    rest = [c for c in carried if c not in ("actor", "amount")]
    first = people.select(*rest, share.alias("amount"), "people", F.posexplode("people").alias("i", "actor"))
    met = first.select(*rest, "actor", "amount", F.explode(F.expr("slice(people, i + 2, size(people))")).alias("b"))
    return met.select("b", *carried, F.lit("copresence").alias("rule"), F.lit(True).alias("symmetric"))


@dataclass(frozen=True)
class Network:
    """ties (*extra, src, dst, w, raw, evidence_<rule>..., layer_mask[, shared]); nodes (node_id, mode)."""

    ties: DataFrame
    nodes: DataFrame
    directed: bool
    settings: Settings
    evidence: DataFrame
    dataset: Dataset
    basis: int | None = None
    affiliations: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """(src, dst, w) as the measures take it."""
        return self.ties.select("src", "dst", "w")


def transformed(raw: Column, weighting: str) -> Column:
    """The weight of a tie: its amount, ln(1 + amount) or 1."""
    return {"count": raw, "log": F.log1p(raw), "binary": F.lit(1.0)}[weighting]


def tied(found: DataFrame, s: Settings, directed: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """Evidence summed to ties: amounts by rule, weighted raw amount, layers as bits. Ties below the least raw amount are left out."""
    if directed:
        ends = F.expr("if(symmetric, array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)), array(struct(a AS src, b AS dst)))")
        found = found.withColumn("ends", F.explode(ends)).select("*", "ends.*")
    else:
        found = found.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b"))
    active = s.active()
    weight = F.create_map(*[x for r in active for x in (F.lit(r), F.lit(float(s.rules[r].weight)))]) if active else F.lit(None).cast("map<string, double>")
    bit = F.expr(_case("layer", {v: str(1 << i) for i, v in enumerate(LAYERS)}, f"'{1 << LAYERS.index('unknown')}'")).cast("int")
    sums = found.groupBy(*extra, "src", "dst").agg(
        F.sum(F.col("amount") * weight[F.col("rule")]).alias("raw"), F.bit_or(bit).alias("layer_mask"),
        *[F.coalesce(F.sum(F.when(F.col("rule") == r, F.col("amount"))), F.lit(0.0)).alias(f"evidence_{r}") for r in active],
    )
    kept = sums.where((F.col("raw") > 0) & (F.col("raw") >= s.min_weight))
    return kept.withColumn("w", transformed(F.col("raw"), s.weighting)).select(*extra, "src", "dst", "w", "raw", *[f"evidence_{r}" for r in active], "layer_mask")


def across_modes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence with the modes of its ends: (.., mode_a, mode_b); null where unknown."""
    modes = nodes.where("mode IN (0, 1)")
    return found.join(modes.select(F.col("node_id").alias("a"), F.col("mode").alias("mode_a")), "a", "left").join(modes.select(F.col("node_id").alias("b"), F.col("mode").alias("mode_b")), "b", "left")


def build(ds: Dataset, s: Settings, extra: tuple[str, ...] = ()) -> Network:
    """The network that settings make of a dataset. All tables are lazy."""
    events = sifted(ds, s)
    found = _evidence(ds, s, events, extra)
    directed = s.directed and not s.two_mode
    if s.two_mode:
        found = across_modes(found, ds.nodes).where("mode_a <> mode_b").drop("mode_a", "mode_b")
    ties = tied(found, s, directed, extra)
    modes = ds.nodes.select("node_id", "mode")
    affiliations, basis = None, s.two_mode.basis if s.two_mode else None
    if basis is not None:
        affiliations = ties
        ties = projected(ties, ds.nodes, basis, s, extra)
    ends = ties.select(F.col("src").alias("node_id")).unionByName(ties.select(F.col("dst").alias("node_id"))).distinct()
    if s.include_isolates:
        own = ds.nodes.select("node_id").join(excluded(ds, s).withColumnRenamed("node", "node_id"), "node_id", "left_anti")
        if s.two_mode:
            own = own.join(modes.where("mode IN (0, 1)" if basis is None else f"mode = {basis}"), "node_id", "left_semi")
        ends = ends.unionByName(own).distinct()
    return Network(ties, ends.join(modes, "node_id", "left"), directed, s, found, ds, basis, affiliations)


def projected(ties: DataFrame, nodes: DataFrame, basis: int, s: Settings, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one mode by the nodes of the other that they share: (*extra, src, dst, w, raw, layer_mask, shared)."""
    own = nodes.where(F.col("mode") == basis).select("node_id")
    turned = ties.join(own.withColumnRenamed("node_id", "src"), "src", "left_semi").select(*extra, F.col("src").alias("person"), F.col("dst").alias("event"), "layer_mask")
    turned = turned.unionByName(ties.join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*extra, F.col("dst").alias("person"), F.col("src").alias("event"), "layer_mask"))
    pairs = turns.project(turned, s.two_mode.min_shared, extra)
    raw = {"count": F.col("shared").cast("double"), "newman": F.col("newman"), "binary": F.lit(1.0)}[s.two_mode.projection]
    return pairs.select(*extra, "src", "dst", transformed(raw, s.weighting).alias("w"), raw.alias("raw"), "layer_mask", F.col("shared").cast("double").alias("shared"))


def fates(ds: Dataset, s: Settings) -> DataFrame:
    """(fate, events): how many events were used and what the others were dropped for; also events beyond the recipient and meeting caps, and used
    events whose weight field is blank. Broadcasts and large meetings are counted among the used."""
    events = sifted(ds, s)
    used = events.where("fate = 'used'")
    most = s.max_recipients if s.max_recipients > 0 else None
    counted = events.groupBy("fate").agg(F.count("*").alias("events"))
    addressing = ", ".join(f"'{r}'" for r in ADDRESSING)
    if most:
        crowd = used.where(f"type <> 'copresence' AND size(targets) > {most} AND size(array_distinct(transform(filter(targets, x -> x.role IN ({addressing})), x -> x.node))) > {most}")
        counted = counted.unionByName(crowd.agg(F.lit("broadcast").alias("fate"), F.count("*").alias("events")))
    if _meeting_cap(s) and "copresence" in s.active():
        large = _people(used, excluded(ds, s).select("node"), ["event_id"] if "actor" not in ds.events.columns else ["event_id", "actor"]).where(F.size("people") > _meeting_cap(s))
        counted = counted.unionByName(large.agg(F.lit("large_meetings").alias("fate"), F.count("*").alias("events")))
    if s.tie_weight:
        counted = counted.unionByName(used.where("weightless").agg(F.lit("weight_missing").alias("fate"), F.count("*").alias("events")))
    return counted.where("events > 0")


def summary(net: Network) -> DataFrame:
    """(part, name, value): nodes, edges, isolates and weights; fates of events; ties and evidence by rule; ties by layer."""
    ties, s = net.ties, net.settings
    ends = ties.select(F.col("src").alias("node_id")).unionByName(ties.select(F.col("dst").alias("node_id"))).distinct()
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    whole = [row("network", "edges", F.count("*")), row("weight", "min", F.coalesce(F.min("w"), F.lit(0.0))), row("weight", "max", F.coalesce(F.max("w"), F.lit(0.0))), row("weight", "mean", F.coalesce(F.avg("w"), F.lit(0.0)))]
    for r in s.active() if net.basis is None else []:
        whole += [row("ties by rule", r, F.count_if(F.col(f"evidence_{r}") > 0)), row("evidence by rule", r, F.coalesce(F.sum(f"evidence_{r}"), F.lit(0.0)))]
    whole += [row("ties by layer", layer, F.count_if(F.col("layer_mask").bitwiseAND(1 << i) > 0)) for i, layer in enumerate(LAYERS)]
    rows = ties.agg(F.array(*whole).alias("x")).select(F.inline("x"))
    people = net.nodes.join(ends.withColumn("tied", F.lit(1)), "node_id", "left").agg(F.array(row("network", "nodes", F.count("*")), row("network", "isolates", F.count_if(F.col("tied").isNull()))).alias("x")).select(F.inline("x"))
    dropped = fates(net.dataset, s).select(F.lit("events").alias("part"), F.col("fate").alias("name"), F.col("events").cast("double").alias("value"))
    return rows.unionByName(people).unionByName(dropped).where("value <> 0 OR part IN ('network', 'weight')")


def edge_evidence(net: Network, a: int, b: int, limit: int = 50, both_directions: bool = False) -> DataFrame:
    """(event_id, t, rule, amount, a, b, type, layer, text[, via]) behind the tie of a and b, oldest first.

    Of a projected tie: the affiliations that both have to a shared node, ``via``."""
    text = F.when(F.length("text") > 280, F.concat(F.substring("text", 1, 277), F.lit("..."))).otherwise(F.col("text"))
    events = net.dataset.events.select("event_id", "type", text.alias("text"))
    found, extra = net.evidence, []
    if net.basis is not None:
        sides = found.select("*", F.explode(F.expr("array(struct(a AS p, b AS via), struct(b AS p, a AS via))")).alias("x")).select("*", "x.*").where(F.col("p").isin(a, b))
        shared = sides.where(F.col("p") == a).select("via").intersect(sides.where(F.col("p") == b).select("via"))
        found, extra = sides.join(shared, "via", "left_semi"), ["via"]
    else:
        ahead, back = (F.col("a") == a) & (F.col("b") == b), (F.col("a") == b) & (F.col("b") == a)
        found = found.where(ahead | (back & (F.lit(not net.directed or both_directions) | F.col("symmetric"))))
    oldest = F.coalesce("t", F.lit("1970-01-01").cast("timestamp_ntz"))
    return found.join(events, "event_id").select("event_id", "t", "rule", "amount", "a", "b", "type", "layer", "text", *extra).orderBy(oldest, "event_id", "rule", "b").limit(limit)


def edge_tie_fields(net: Network, types: DataFrame) -> DataFrame:
    """(src, dst, field, value): numbers averaged, other values listed once in first-seen order; an event counts once an edge.

    types: (key, type) as model.tie_field_types gives it."""
    attrs = net.dataset.events.where("attrs IS NOT NULL").select("event_id", "attrs")
    ends = "if(symmetric, array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)), array(struct(a AS src, b AS dst)))" if net.directed else "array(struct(least(a, b) AS src, greatest(a, b) AS dst))"
    once = net.evidence.select("event_id", F.explode(F.expr(ends)).alias("e")).select("event_id", "e.*").distinct().join(net.ties.select("src", "dst"), ["src", "dst"], "left_semi")
    values = once.join(attrs, "event_id").select("src", "dst", "event_id", F.explode("attrs").alias("field", "list")).select("src", "dst", "event_id", "field", F.posexplode("list").alias("pos", "value"))
    typed = values.join(F.broadcast(types.select(F.col("key").alias("field"), "type")), "field")
    number = F.expr("try_cast(value AS double)")
    mean = F.avg(F.when(F.col("type") == "numeric", number))
    first = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") != "numeric", F.struct("event_id", "pos", "value")))), lambda x: x["value"]))
    sums = typed.groupBy("src", "dst", "field").agg(mean.alias("mean"), first.alias("listed"))
    return sums.select("src", "dst", "field", F.coalesce(F.col("mean").cast("string"), F.when(F.size("listed") > 0, F.array_join("listed", "; "))).alias("value")).where("value IS NOT NULL")


def from_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, w) of a plain edge list (src, dst[, w]): duplicates summed, self-loops dropped, undirected pairs in order."""
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
    src, dst = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.where("src <> dst").select(src.alias("src"), dst.alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def views(ds: Dataset) -> DataFrame:
    """(view) of the dataset's sources."""
    return ds.sources.select("view").distinct()
