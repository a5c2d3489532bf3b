"""Made-up worlds with a known truth: people in groups, true ties, interactions along them, what a source would see of it, planted brokers, cascades and moods.

Everything is drawn from hashes of a seed and of what is drawn for, so a world is the same on any cluster, and people, ties and events are made in parallel.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import storage
from kinweave.model import Dataset

#: Relative activity by day of the week (Monday first) and by hour, of kinds of life.
DAYS = {"work": [1, 1.05, 1.05, 1, 0.85, 0.08, 0.06], "online": [1, 1, 1, 1, 1.05, 1.15, 1.15], "flat": [1] * 7}
HOURS = {"work": [0.02] * 7 + [0.2, 0.7, 1, 1, 0.9, 0.6, 0.9, 1, 0.9, 0.8, 0.5, 0.2, 0.1, 0.08, 0.06, 0.04, 0.02], "online": [0.5, 0.3, 0.2, 0.1, 0.1, 0.1, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1, 0.9, 0.8, 0.8, 0.9, 1, 1.1, 1.3, 1.4, 1.4, 1.2, 0.8], "flat": [1] * 24}


@dataclass(frozen=True)
class Spec:
    """A world: presets name its shape. inside and across: chances of a tie within a group and between groups."""

    people: int = 120
    groups: int = 6
    inside: float = 0.3
    across: float = 0.01
    brokers: int = 0
    days: int = 120
    start: datetime = datetime(2024, 1, 1)
    per_tie: float = 12.0
    rhythm: str = "work"
    bots: float = 0.0
    change_at: float | None = None
    change: str | None = None
    seed: int = 1


#: Shapes of worlds by context; siloed worlds lose their ties across groups, reorganised ones deal their groups anew, at a share of the time.
PRESETS = {
    "workplace": Spec(), "workplace, bridge-dependent": Spec(across=0.0, brokers=2), "workplace, siloed": Spec(change_at=0.4, change="silo", across=0.03), "workplace, reorganised": Spec(change_at=0.5, change="reorg"),
    "online": Spec(people=400, groups=10, inside=0.08, across=0.004, rhythm="online", bots=0.03), "professional": Spec(people=300, groups=12, inside=0.12, across=0.006, days=720, per_tie=4), "personal": Spec(people=60, groups=5, inside=0.5, across=0.02, rhythm="online", days=365),
    "community": Spec(people=200, groups=8, inside=0.2, across=0.01, rhythm="online", days=365, per_tie=8), "survey": Spec(people=40, groups=4, inside=0.4, across=0.04, days=1, per_tie=1),
}


def chance(seed: int, what: str, *of: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed, the purpose and the columns alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1 << 50)) + F.lit(0.5)) / float(1 << 50)


@dataclass(frozen=True)
class World:
    """people (node, grp, is_bot, broker), ties (src, dst, w, from_day, until_day): the truth."""

    spec: Spec
    people: DataFrame
    ties: DataFrame


def world(spark: SparkSession, spec: Spec) -> World:
    """People in groups of near equal size and ties by a block model; a pair is drawn by the hash of its two ends. Brokers are tied to one person of every group in ten."""
    s = spec
    broker = (F.col("id") < s.brokers) & F.lit(s.brokers > 0)
    people = spark.range(s.people).select(F.col("id").alias("node"), F.when(broker, -1).otherwise(F.pmod("id", F.lit(s.groups))).cast("int").alias("grp"), ((chance(s.seed, "bot", "id") < s.bots) & ~broker).alias("is_bot"), broker.alias("broker"))
    people = storage.materialize(people, "people")
    a = people.select(F.col("node").alias("src"), F.col("grp").alias("ga"), F.col("broker").alias("ba"), F.col("is_bot").alias("xa"))
    b = people.select(F.col("node").alias("dst"), F.col("grp").alias("gb"), F.col("broker").alias("bb"), F.col("is_bot").alias("xb"))
    pairs = a.join(F.broadcast(b), F.col("src") < F.col("dst")).where("NOT xa AND NOT xb")  # worlds are some thousand people at most
    p = F.when(F.col("ba") | F.col("bb"), 0.1).when(F.col("ga") == F.col("gb"), s.inside).otherwise(s.across)
    moved = chance(s.seed, "group", "src") < 0.5
    silo = F.lit(s.change == "silo") & (F.col("ga") != F.col("gb")) & ~F.col("ba") & ~F.col("bb")
    reorg = F.lit(s.change == "reorg") & (F.col("ga") == F.col("gb")) & moved
    turn = int(s.days * (s.change_at or 1))
    drawn = pairs.where(chance(s.seed, "tie", "src", "dst") < p)
    weight = F.round(0.3 - F.log(chance(s.seed, "weight", "src", "dst")), 3)
    ties = drawn.select("src", "dst", weight.alias("w"), F.lit(0).alias("from_day"), F.when(silo | reorg, turn).otherwise(s.days).alias("until_day"))
    if s.change == "reorg":
        later = pairs.where((F.pmod(F.col("ga") + 1, F.lit(s.groups)) == F.col("gb")) & moved & (chance(s.seed, "new tie", "src", "dst") < s.inside / 2))
        ties = ties.unionByName(later.select("src", "dst", weight.alias("w"), F.lit(turn).alias("from_day"), F.lit(s.days).alias("until_day")))
    return World(s, people, storage.materialize(ties, "ties"))


def _pick(u: Column, weights: list[float]) -> Column:
    """The place in a list of weights that a number in [0, 1) falls on."""
    ends = np.cumsum(weights) / sum(weights)
    return sum((F.when(u >= float(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))


def interactions(w: World) -> DataFrame:
    """(event_id, t, actor, target, context, answers): messages along ties, a Poisson number for each in proportion to weight and time, at days and hours of the rhythm; some answer the one before."""
    s = w.spec
    days = (F.col("until_day") - F.col("from_day")) / F.lit(float(max(1, s.days)))
    mean = F.col("w") * s.per_tie * days
    n = F.floor(mean + F.sqrt(mean) * (chance(s.seed, "n", "src", "dst") * 3.46 - 1.73) + 0.5).cast("int")
    spread = w.ties.withColumn("n", F.greatest(n, F.lit(0))).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = lambda what: chance(s.seed, what, "src", "dst", "k")
    week = DAYS[s.rhythm]
    first = s.start.weekday()
    weeks = max(1, math.ceil(s.days / 7))
    day = F.floor(u("week") * weeks) * 7 + F.pmod(_pick(u("day"), week) - first, F.lit(7))
    day = F.when((day >= F.col("from_day")) & (day < F.col("until_day")), day).otherwise(F.col("from_day") + F.floor(u("any day") * (F.col("until_day") - F.col("from_day"))))
    seconds = day * 86400 + _pick(u("hour"), HOURS[s.rhythm]) * 3600 + F.floor(u("second") * 3600)
    t = F.lit(s.start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    forth = u("way") < 0.5
    rows = spread.select(F.when(forth, F.col("src")).otherwise(F.col("dst")).alias("actor"), F.when(forth, F.col("dst")).otherwise(F.col("src")).alias("target"), t.alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), "k")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), "a", "b", "k"), 1)
    group = w.people.select(F.col("node").alias("a"), F.col("grp").alias("ga"))
    other = w.people.select(F.col("node").alias("b"), F.col("grp").alias("gb"))
    rows = rows.withColumn("event_id", key).join(group, "a").join(other, "b")
    context = F.when(F.col("ga") == F.col("gb"), F.col("ga")).otherwise(-1)
    before = F.shiftrightunsigned(F.xxhash64(F.lit(s.seed), "a", "b", F.col("k") - 1), 1)
    answers = F.when((F.col("k") > 1) & (chance(s.seed, "answer", "a", "b", "k") < 0.3), before)
    return rows.select("event_id", "t", "actor", "target", context.cast("bigint").alias("context"), answers.alias("answers"))


def observed(rows: DataFrame, w: World, view: str = "full", ego: int | None = None, rate: float = 0.3, chat: int | None = None) -> DataFrame:
    """What a source shows: everything, what concerns one person, what one person wrote, one context, or what a sample of people wrote."""
    if view in ("ego", "authored") and ego is None:
        ends = w.ties.select(F.col("src").alias("node")).unionByName(w.ties.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "node").limit(1).collect()
        ego = ends[0]["node"] if ends else 0
    if view == "ego":
        return rows.where((F.col("actor") == ego) | (F.col("target") == ego))
    if view == "authored":
        return rows.where(F.col("actor") == ego)
    if view == "chat":
        return rows.where(F.col("context") == (0 if chat is None else chat))
    if view == "sample":
        return rows.where(chance(w.spec.seed, "sampled", "actor") < rate)
    return rows


def cascade(w: World, seeds: list[int], terms: list[str], p0: float = 0.25, mean_days: float = 4.0, at: float = 0.1) -> list[tuple[str, int, datetime, int | None]]:
    """(term, person, time, from whom): words that spread along true ties, each tie passing on with 1 - (1 - p0)^min(4, weight) after half a day and an exponential delay. Worlds are small, so
    this walks them on the driver, as each step depends on the one before."""
    s = w.spec
    near: dict[int, list[tuple[int, float, int, int]]] = {}
    for r in w.ties.collect():
        near.setdefault(r["src"], []).append((r["dst"], r["w"], r["from_day"], r["until_day"]))
        near.setdefault(r["dst"], []).append((r["src"], r["w"], r["from_day"], r["until_day"]))
    out = []
    for k, (seed, term) in enumerate(zip(seeds, terms)):
        rng = np.random.default_rng([s.seed, k])
        best, source, done = {seed: at * s.days}, {seed: None}, set()
        heap = [(at * s.days, seed)]
        while heap:
            t, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            out.append((term, v, s.start + timedelta(days=t), source[v]))
            for u, weight, first, last in sorted(near.get(v, [])):
                if u in done or rng.random() >= 1 - (1 - p0) ** min(4.0, weight):
                    continue
                then = t + 0.5 + rng.exponential(mean_days)
                if then < s.days and first <= then < last and then < best.get(u, math.inf):
                    best[u], source[u] = then, v
                    heapq.heappush(heap, (then, u))
    return out


@dataclass(frozen=True)
class Mood:
    """A shift of tone for a group, a person or a layer in a span of days."""

    delta: float
    grp: int | None = None
    person: int | None = None
    from_day: float = -math.inf
    until_day: float = math.inf


def valence(grp: Column, person: Column, day: Column, base: dict[int, float], moods: list[Mood], default: float = 0.1) -> Column:
    """Tone from -0.95 to 0.95: the group's own and what of the moods holds."""
    v = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), grp) if base else F.lit(None).cast("double"), F.lit(default))
    for m in moods:
        holds = F.lit(True)
        if m.grp is not None:
            holds = holds & (grp == m.grp)
        if m.person is not None:
            holds = holds & (person == m.person)
        if math.isfinite(m.from_day):
            holds = holds & (day >= m.from_day)
        if math.isfinite(m.until_day):
            holds = holds & (day < m.until_day)
        v = v + F.when(holds, m.delta).otherwise(0.0)
    return F.greatest(F.lit(-0.95), F.least(F.lit(0.95), v))


GOOD, BAD = ["great", "good", "happy", "love", "thanks"], ["bad", "awful", "angry", "hate", "problem"]
PLAIN = ["plan", "review", "draft", "meeting", "budget", "release", "design", "notes", "ticket", "report"]


def with_text(rows: DataFrame, w: World, base: dict[int, float] | None = None, moods: list[Mood] | None = None, uses: DataFrame | None = None) -> DataFrame:
    """Messages with words: plain ones, good or bad ones as often as the tone asks, and words (term, node, t) that the actor has taken up."""
    s = w.spec
    rows = rows.join(w.people.select(F.col("node").alias("actor"), "grp"), "actor", "left")
    day = F.timestamp_diff("SECOND", F.lit(s.start).cast("timestamp_ntz"), F.col("t")) / 86400
    v = valence(F.col("grp"), F.col("actor"), day, base or {}, moods or [])
    word = lambda listed, what: F.element_at(F.array(*[F.lit(x) for x in listed]), (F.floor(chance(s.seed, what, "event_id") * len(listed)) + 1).cast("int"))
    plain = [word(PLAIN, f"word {i}") for i in range(4)]
    mood = F.when(chance(s.seed, "tone", "event_id") < F.abs(v), F.when(v > 0, word(GOOD, "good")).otherwise(word(BAD, "bad"))).otherwise("")
    if uses is not None:
        mine = uses.select(F.col("node").alias("actor"), F.col("t").alias("since"), "term").groupBy("actor").agg(F.collect_list(F.struct("since", "term")).alias("known"))
        rows = rows.join(mine, "actor", "left")
        held = F.filter(F.coalesce("known", F.array().cast("array<struct<since: timestamp_ntz, term: string>>")), lambda x: (x["since"] <= F.col("t")) & (chance(s.seed, "use", "event_id", x["term"]) < 0.4))
        taken = F.array_join(F.transform(held, lambda x: x["term"]), " ")
    else:
        taken = F.lit("")
    return rows.withColumn("text", F.trim(F.concat_ws(" ", *plain, mood, taken))).drop("grp", *(["known"] if uses is not None else []))


def dataset(w: World, rows: DataFrame, view: str = "full") -> Dataset:
    """The interactions as a dataset: direct messages with a target, answers as replies."""
    reply = F.col("answers").isNotNull()
    targets = F.array(F.struct(F.col("target").alias("node"), F.when(reply, "reply").otherwise("dm").alias("role")))
    events = rows.select("event_id", F.lit("message").alias("type"), "t", "actor", "context", F.col("answers").alias("parent"), targets.alias("targets"), *(["text"] if "text" in rows.columns else []))
    nodes = w.people.select(F.col("node").alias("node_id"), F.concat(F.lit("synth:"), F.col("node").cast("string")).alias("key"), "is_bot", F.create_map(F.lit("group"), F.concat(F.lit("g"), F.col("grp").cast("string"))).alias("attrs"))
    contexts = rows.select(F.col("context").alias("context_id")).distinct().select("context_id", F.lit("channel").alias("kind"), F.when(F.col("context_id") < 0, "public").otherwise("private").alias("visibility"))
    sources = w.people.sparkSession.createDataFrame([(0, "synthetic", view)], "source_id bigint, format string, view string")
    return Dataset.of(nodes, events, contexts, sources)


def generate(spark: SparkSession, preset: str | Spec = "workplace", view: str = "full", **kwargs) -> tuple[Dataset, World]:
    spec = PRESETS[preset] if isinstance(preset, str) else preset
    w = world(spark, spec)
    return dataset(w, observed(interactions(w), w, view, **kwargs), view), w
