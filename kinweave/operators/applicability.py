"""Which measures the data allow: ok, caution or na, with reasons from what sources show, direction, weighting, rules, modes, size, pieces, attributes, time and text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from kinweave.operators import components
from kinweave.operators.construct import Network

PATHS = ["betweenness", "betweenness_weighted", "closeness", "closeness_weighted"]
WHOLE = [*PATHS, "eigenvector", "pagerank", "core", "mean_path", "centralization", "communities"]
DIRECTION = ["in_degree", "out_degree", "in_strength", "out_strength"]
LOCAL = ["clustering", "transitivity", "mean_clustering", "constraint", "effective_size", "ego_density"]
TIME = ["time_series", "detect_shifts", "before_after"]
TEXT = ["affect", "keywords", "topics"]
TWO_MODE = ["two_mode_degree", "two_mode_betweenness", "two_mode_closeness", "two_mode_clustering", "two_mode_density", "robins_alexander"]
MEASURES = [*WHOLE, *DIRECTION, "degree", "strength", "reciprocity", "density", "strength_gini", *LOCAL, "degree_assortativity", "groups", "hierarchy", "null_model", "resample_ranks", *TIME, *TEXT, "diffusion", *TWO_MODE]
RANK = {"ok": 0, "caution": 1, "na": 2}


@dataclass
class Facts:
    """What the rules look at, from a few aggregates."""

    views: list[str] = field(default_factory=lambda: ["full"])
    formats: list[str | None] = field(default_factory=lambda: [None])
    undirected_sources: int = 0
    directed: bool = True
    weighting: str = "count"
    rules: list[str] = field(default_factory=list)
    two_mode: bool = False
    basis: int | None = None
    modes: tuple[int, int] = (0, 0)
    nodes: int = 0
    ties: int = 0
    isolates: int = 0
    pieces: int = 0
    attributes: dict[str, tuple[str, float]] = field(default_factory=dict)
    events: int = 0
    dated: int = 0
    days: float = 0.0
    messages: int = 0
    with_text: int = 0


def facts(net: Network, attributes: dict[str, tuple[str, float]] | None = None) -> Facts:
    """Facts of a network; attributes: key to (type, coverage), as model.attribute_schema has them."""
    ds, s = net.dataset, net.settings
    sources = ds.sources.collect()  # at most 65,535
    pairs, nodes = net.ties.select("src", "dst"), net.nodes.select(F.col("node_id").alias("node"))
    size = components.weak(pairs, nodes).groupBy("component").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") == 1).alias("isolates"), F.count_if(F.col("n") > 1).alias("pieces")).collect()[0]
    modes = net.nodes.agg(F.count_if(F.col("mode") == 0).alias("a"), F.count_if(F.col("mode") == 1).alias("b")).collect()[0]
    ev = ds.events.agg(F.count("*").alias("n"), F.count("t").alias("dated"), F.min("t").alias("a"), F.max("t").alias("b"), F.count_if(F.col("type") == "message").alias("messages"), F.count_if((F.col("type") == "message") & (F.length("text") > 0)).alias("text")).collect()[0]
    days = (ev["b"] - ev["a"]).total_seconds() / 86400 if ev["dated"] else 0.0
    return Facts(
        [r["view"] or "full" for r in sources], [r["format"] for r in sources], sum(r["directed"] is False for r in sources), net.directed, s.weighting, s.active(), s.two_mode is not None and net.basis is None, net.basis,
        (modes["a"], modes["b"]), size["nodes"] or 0, pairs.count(), size["isolates"], size["pieces"], attributes or {}, ev["n"], ev["dated"], days, ev["messages"], ev["text"],
    )


def applicability(f: Facts) -> dict[str, tuple[str, list[str]]]:
    """Measure to (level, reasons)."""
    out: dict[str, tuple[str, list[str]]] = {m: ("ok", []) for m in MEASURES}

    def flag(level: str, measures: list[str], reason: str) -> None:
        for m in measures:
            old, why = out[m]
            out[m] = (level if RANK[level] > RANK[old] else old, why if reason in why else [*why, reason])

    only = lambda v: bool(f.views) and set(f.views) == {v}
    if f.formats and all(x == "ego-interview" for x in f.formats):
        flag("na", PATHS, "every path runs through the respondent")
        flag("na", [*DIRECTION, "reciprocity"], "the respondent reports every tie; direction isn't observed")
        flag("caution", ["eigenvector", "pagerank", "centralization", "mean_path", "core", *LOCAL, "density", "communities", "groups", "null_model"], "ties among the people named are as one respondent sees them")
    elif only("ego"):
        flag("na", PATHS, "one person's export: every path runs through its owner")
        flag("caution", ["eigenvector", "pagerank", "centralization", "mean_path", "core", *LOCAL, "density", "communities", "in_degree", "reciprocity", "groups", "null_model"], "others are seen only through their contact with the owner")
    elif "ego" in f.views:
        flag("caution", [*WHOLE, "groups", "null_model"], "some sources are one person's export")
    if only("chat"):
        flag("caution", [*PATHS, "communities"], "a conversation: everyone hears everyone")
    if only("authored"):
        flag("na", ["in_degree", "in_strength", "reciprocity", *PATHS, "eigenvector", "pagerank", "communities", *LOCAL, "density"], "only one account's outgoing actions are present")
    if "sample" in f.views:
        flag("caution", [*WHOLE, "density", "transitivity", "mean_clustering", "constraint", "effective_size"], "the data are a sample of a larger population")
    if not f.directed:
        flag("na", [*DIRECTION, "reciprocity"], "the network is undirected")
    elif f.undirected_sources:
        flag("caution", ["reciprocity", "in_degree", "out_degree"], "some sources record undirected ties")
    if f.weighting == "binary":
        flag("caution", ["strength", "in_strength", "out_strength"], "weighting is binary, so strength equals degree")
        flag("na", ["betweenness_weighted", "closeness_weighted"], "weighting is binary")
    if f.rules == ["copresence"]:
        flag("caution", [*PATHS, *LOCAL], "ties come only from shared meetings, which make cliques")
    if "adjacency" in f.rules:
        flag("caution", ["reciprocity"], "taking turns ties two people both ways")
    if f.rules == ["follow"]:
        flag("caution", ["strength", "in_strength", "out_strength"], "follows have no strength")
    if not f.two_mode:
        flag("na", TWO_MODE, "needs a two-mode network" if f.basis is None else "this is a projection; two-mode measures apply to the two-mode view")
    else:
        flag("na", [*LOCAL, "density", "centralization", "degree_assortativity", "null_model"], "ties run only between the two modes")
        flag("caution", [*PATHS, "eigenvector", "pagerank", "core", "communities"], "values of the two modes can't be compared")
        if f.modes[0] < 2 or f.modes[1] < 1:
            flag("na", TWO_MODE, "each mode needs nodes")
    if f.basis is not None:
        flag("caution", [*LOCAL, "null_model"], "each shared node becomes a clique of the projection")
    content = [*TEXT, "hierarchy"]
    if f.nodes < 3:
        flag("na", [m for m in MEASURES if m not in (*content, "time_series")], "fewer than three people")
    elif f.nodes < 10:
        flag("caution", [*WHOLE, "null_model", "resample_ranks", "groups"], "a very small network: single ties move these numbers a lot")
    if f.pieces > 1:
        flag("caution", ["eigenvector", "closeness", "closeness_weighted", "mean_path", "betweenness", "betweenness_weighted"], f"the network has {f.pieces} separate components")
    if f.nodes and f.isolates / f.nodes > 0.2:
        flag("caution", ["density", "mean_clustering", "centralization", "strength_gini"], "over a fifth of the people have no ties")
    if not f.ties:
        flag("na", [m for m in MEASURES if m not in content], "no ties under these rules")
    if f.nodes > 3000:
        flag("caution", PATHS, "path measures are estimated from a sample of sources")
    lead = [k for k in f.attributes if any(w in k.lower() for w in ("manager", "reports_to", "supervisor"))]
    coded = [c for k, (kind, c) in f.attributes.items() if kind in ("categorical", "boolean", "ordinal") and k not in lead]
    if not coded:
        flag("na", ["groups"], "no categorical attribute")
    elif max(coded) < 0.8:
        flag("caution", ["groups"], "attribute values are missing for over a fifth of the people")
    if lead:
        flag("caution", ["betweenness", "betweenness_weighted", "constraint", "effective_size"], "managers sit on paths between their reports by design")
    else:
        flag("na", ["hierarchy"], "no manager attribute")
    if f.dated < 2 or f.days <= 0:
        flag("na", [*TIME, "diffusion"], "events have no usable times")
    else:
        if f.dated / f.events < 0.8:
            flag("caution", [*TIME, "diffusion"], "over a fifth of the events have no time")
        if f.days < 14:
            flag("caution", TIME, "less than two weeks of data")
        if f.days < 56:
            flag("caution", ["detect_shifts"], "fewer than eight weeks")
    if not f.with_text:
        flag("na", [*TEXT, "diffusion"], "no message text")
    else:
        if f.with_text / max(1, f.messages) < 0.5:
            flag("caution", TEXT, "under half of the messages have text")
        flag("caution", ["affect"], "word lists miss sarcasm, jargon and other languages")
        if f.with_text < 200:
            flag("caution", ["topics", "diffusion"], "fewer than 200 messages with text")
    return out


GLOSSARY = {
    "degree": "ties of a node; in a directed network incoming and outgoing ones together",
    "strength": "summed weight of a node's ties",
    "reciprocity": "share of ties that go both ways",
    "density": "ties over possible ties",
    "betweenness": "share of shortest paths between others that pass through a node",
    "closeness": "mean inverse distance from the others; unreachable ones count 0",
    "eigenvector": "a node is central if its neighbours are: leading eigenvector of the symmetric weights",
    "pagerank": "share of a random walk along ties, with even jumps",
    "core": "the largest k such that the node is in a part where all have k contacts",
    "clustering": "share of a node's pairs of contacts that are tied",
    "transitivity": "share of connected triples that are closed",
    "constraint": "how far a node's contacts are tied to each other (Burt)",
    "effective_size": "contacts less their redundancy (Burt)",
    "ego_density": "ties among a node's contacts over possible ones",
    "modularity": "weight inside communities beyond what strengths alone would give",
    "assortativity": "whether ties join like with like, from -1 to 1",
    "ei": "external less internal ties over both (Krackhardt and Stern)",
    "strength_gini": "inequality of strengths, 0 for equal ones",
    "centralization": "how far degrees are those of a star (Freeman)",
    "robins_alexander": "share of three-paths of a two-mode network that are closed to four-cycles",
    "two_mode_clustering": "mean overlap of a node with those two steps away (Latapy)",
}
