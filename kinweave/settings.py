"""What turns events into a network: rules, filters, weighting; defaults from the data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import functions as F

from kinweave.model import Dataset, two_mode

#: The rules, kinds without turn-taking, kinds of group chats, roles that address people.
RULES = ["reply", "mention", "dm", "to", "cc", "bcc", "adjacency", "copresence", "declared", "repost", "like", "follow", "reaction"]
NO_TURNS = ["email_thread", "meeting", "survey", "canvas"]
GROUP_CHATS = ["group_dm", "chat"]
ADDRESSING = ["to", "cc", "bcc", "dm", "mention"]
TURN_WEIGHT, TURN_MINUTES, MOST_RECIPIENTS, UNTARGETED_SHARE = 0.5, 10, 25, 0.3


@dataclass(frozen=True)
class Rule:
    on: bool = False
    weight: float = 1.0
    evidence: int = 0


@dataclass(frozen=True)
class TieFilter:
    """Keeps events of sources that carry the field if one of its values is listed and in range; blank ones only if told so."""

    key: str
    values: tuple[str, ...] | None = None
    least: float | None = None
    most: float | None = None
    keep_missing: bool = False


@dataclass(frozen=True)
class TwoMode:
    view: str = "two-mode"
    projection: str = "count"
    min_shared: int = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "view", self.view if self.view in ("two-mode", "mode0", "mode1") else "two-mode")
        object.__setattr__(self, "projection", self.projection if self.projection in ("count", "newman", "binary") else "count")
        object.__setattr__(self, "min_shared", max(1, int(self.min_shared or 1)))

    @property
    def basis(self) -> int | None:
        return {"mode0": 0, "mode1": 1}.get(self.view)


@dataclass(frozen=True)
class Settings:
    rules: dict[str, Rule] = field(default_factory=dict)
    directed: bool = True
    weighting: str = "count"
    min_weight: float = 0.0
    max_recipients: int = MOST_RECIPIENTS
    window_minutes: float = TURN_MINUTES
    normalize: bool = True
    max_meeting: int | None = None
    start: datetime | None = None
    end: datetime | None = None
    visibility: tuple[str, ...] | None = None
    media: tuple[str, ...] | None = None
    exclude_bots: bool = True
    exclude_nodes: tuple[int, ...] = ()
    include_isolates: bool = True
    tie_weight: str | None = None
    #: An ordered choice's options, the first one weighs 1.
    tie_order: tuple[str, ...] = ()
    tie_filters: tuple[TieFilter, ...] = ()
    two_mode: TwoMode | None = None

    def with_rules(self, **weights: float | bool) -> Settings:
        """These rules on, others off; a number is the rule's weight."""
        rules = {r: Rule(r in weights and weights[r] is not False, float(weights[r]) if r in weights and weights[r] is not True else (TURN_WEIGHT if r == "adjacency" else 1.0)) for r in RULES}
        return replace(self, rules=rules)

    def active(self) -> list[str]:
        return [r for r in RULES if self.rules.get(r, Rule()).on]


def evidence_counts(ds: Dataset):
    """One row: pieces of evidence for each rule before any filter, and what decides direction; self-targets don't count.

    A threaded message with a reply target is one reply; its parent counts only if it names none and the parent is another's."""
    parents = ds.events.select(F.col("event_id").alias("parent"), F.col("actor").alias("parent_actor"))
    contexts = ds.contexts.select(F.col("context_id").alias("context"), F.col("kind").alias("kind"))
    undirected = ds.sources.select(F.col("source_id").alias("source"), (~F.col("directed")).alias("undirected"))
    events = ds.events.join(F.broadcast(undirected), "source", "left").join(contexts, "context", "left")  # sources are at most 65,535
    threaded = events.where("type = 'message' AND parent IS NOT NULL AND NOT exists(targets, x -> x.role = 'reply')").join(parents, "parent").where("parent_actor <> actor").agg(F.count("*").alias("parent_replies"))
    role = lambda r: F.expr(f"coalesce(sum(size(filter(targets, x -> x.role = '{r}' AND x.node <> actor))), 0)").alias(r)
    kind = lambda t: F.count_if(F.col("type") == t).alias(t)
    shared = (F.col("type") == "message") & (F.size("targets") == 0) & F.col("context").isNotNull() & ~F.coalesce(F.col("kind").isin(*NO_TURNS), F.lit(False))
    sums = events.agg(
        *[role(r) for r in ("reply", "mention", "dm", "to", "cc", "bcc")], *[kind(t) for t in ("message", "copresence", "declared", "repost", "like", "follow", "reaction")],
        F.count_if(F.col("t").isNotNull()).alias("timed"), F.count_if(shared).alias("untargeted"), F.count_if(shared & F.col("kind").isin(*GROUP_CHATS)).alias("untargeted_chat"),
        F.coalesce(F.sum(F.when(F.col("undirected") & (F.col("type") != "copresence"), F.size("targets"))), F.lit(0)).alias("undirected"),
    )
    row = sums.join(F.broadcast(threaded))
    turns = (F.col("timed") > 0) & (F.col("message") > 0) & ((F.col("untargeted_chat") > 0) | (F.col("untargeted") >= UNTARGETED_SHARE * F.col("message")))
    return row.select(
        (F.col("reply") + F.col("parent_replies")).alias("reply"), "mention", "dm", "to", "cc", "bcc", F.when(turns, F.col("untargeted")).otherwise(0).alias("adjacency"),
        "copresence", "declared", "repost", "like", "follow", "reaction", "undirected",
    )


def default_settings(ds: Dataset) -> Settings:
    """Rules on where their evidence exists; directed unless half of it has no direction; two-mode data undirected."""
    counts = evidence_counts(ds).collect()[0].asDict()
    rules = {r: Rule(counts[r] > 0, TURN_WEIGHT if r == "adjacency" else 1.0, counts[r]) for r in RULES}
    total = sum(counts[r] for r in RULES)
    both = two_mode(ds.nodes)
    if both:
        directed = False
    elif total:
        directed = (counts["copresence"] + counts["undirected"]) / total < 0.5
    else:
        ends = ds.sources.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(~F.col("directed"), F.lit(False))).alias("none")).collect()[0]
        directed = not (ends["n"] and ends["none"])
    visibility = {r[0] for r in ds.contexts.select("visibility").distinct().collect()}  # five at most
    return Settings(rules=rules, directed=directed, visibility=tuple(sorted(visibility | {"unknown"})), two_mode=TwoMode() if both else None)


def normalized(ds: Dataset, given: dict | Settings | None = None) -> Settings:
    """Settings with what isn't given filled from the data's defaults; two-mode networks are undirected."""
    if isinstance(given, Settings):
        out = given
    else:
        given = dict(given or {})
        base = default_settings(ds)
        rules = {r: replace(base.rules[r], **given.get("rules", {}).get(r, {})) for r in RULES}
        asked = given.get("two_mode", base.two_mode) if base.two_mode else None
        given |= {"rules": rules, "two_mode": TwoMode(**asked) if isinstance(asked, dict) else asked}
        out = replace(base, **given)
    return replace(out, directed=False) if out.two_mode else out
