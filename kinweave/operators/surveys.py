"""Networks that people report: rosters, perceived networks, personal interviews; agreement, accuracy, merging of reports."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the symmetry check.
LEAST_TIES, MIXED_GAP, TWO_WAY = 3, 0.3, 0.9
NO_TIE = ["", "no", "none", "never", "0", "n", "-", "n/a", "na", "no tie", "not at all", "don't know", "do not know"]


# ---- perceived networks: people (person, place), reports (informant, frm, to), informants (informant, person) ----


def pairs_of(people: DataFrame, undirected: bool = False) -> DataFrame:
    """(frm, to) of all ordered pairs of a roster, or each unordered one once in roster order. A roster is some tens to thousands of people; pairs are the unit of these measures."""
    a, b = people.select(F.col("person").alias("frm"), F.col("place").alias("p")), people.select(F.col("person").alias("to"), F.col("place").alias("q"))
    return a.join(F.broadcast(b), F.col("p") < F.col("q") if undirected else F.col("p") != F.col("q")).select("frm", "to")


def canonical(reports: DataFrame, people: DataFrame, undirected: bool) -> DataFrame:
    """Reports as pairs of the universe: an unordered pair in roster order, once an informant."""
    if not undirected:
        return reports.select("informant", "frm", "to").distinct()
    place = lambda c, n: people.select(F.col("person").alias(c), F.col("place").alias(n))
    ranked = reports.join(place("frm", "p"), "frm").join(place("to", "q"), "to").where("p <> q")
    turn = F.col("p") > F.col("q")
    return ranked.select("informant", F.when(turn, F.col("to")).otherwise(F.col("frm")).alias("frm"), F.when(turn, F.col("frm")).otherwise(F.col("to")).alias("to")).distinct()


def agreement(reports: DataFrame, informants: DataFrame, people: DataFrame, undirected: bool = False) -> DataFrame:
    """(frm, to, share) of reported pairs: the share of informants who report them."""
    n = informants.agg(F.count("*").alias("n"))
    counts = canonical(reports, people, undirected).groupBy("frm", "to").agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(n)).select("frm", "to", (F.col("c") / F.col("n")).alias("share"))


def consensus(reports: DataFrame, informants: DataFrame, people: DataFrame, threshold: float = 0.5, undirected: bool = False) -> DataFrame:
    """(frm, to) that at least the threshold's share of informants reports."""
    return agreement(reports, informants, people, undirected).where(F.col("share") >= threshold - 1e-12).select("frm", "to")


def own_reports(reports: DataFrame, informants: DataFrame, people: DataFrame, rule: str = "union", undirected: bool = False) -> DataFrame:
    """(frm, to) by what the two people themselves report: either of them (union) or both (intersection)."""
    mine = canonical(reports, people, undirected).join(informants.where("person IS NOT NULL"), "informant").where("person = frm OR person = to")
    said = mine.groupBy("frm", "to").agg(F.count_distinct("person").alias("n"))
    return said.where("n = 2" if rule == "intersection" else "n >= 1").select("frm", "to")


def accuracy(perceived: DataFrame, criterion: DataFrame, people: DataFrame, undirected: bool = False) -> DataFrame:
    """(informant, hits, misses, false_alarms, correct_rejections, hit_rate, false_alarm_rate, jaccard) of each informant's pairs (informant, frm, to) against a criterion (frm, to).

    Only reported and true pairs are met; what nobody reports and isn't true is counted as the rest of the universe."""
    n = people.agg(F.count("*").alias("n")).select((F.col("n") * (F.col("n") - 1) / (2 if undirected else 1)).cast("bigint").alias("universe"))
    said = canonical(perceived, people, undirected)
    truth = canonical(criterion.withColumn("informant", F.lit(0)), people, undirected).drop("informant")
    who = perceived.select("informant").distinct()
    met = said.withColumn("s", F.lit(1)).join(truth.withColumn("c", F.lit(1)), ["frm", "to"], "left").groupBy("informant").agg(F.count("c").alias("hits"), F.count_if(F.col("c").isNull()).alias("false_alarms"))
    rows = who.join(met, "informant", "left").fillna(0, ["hits", "false_alarms"]).join(F.broadcast(truth.agg(F.count("*").alias("true")))).join(F.broadcast(n))
    rows = rows.withColumn("misses", F.col("true") - F.col("hits")).withColumn("correct_rejections", F.col("universe") - F.col("true") - F.col("false_alarms"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    h, m, f, r = (F.col(c) for c in ("hits", "misses", "false_alarms", "correct_rejections"))
    return rows.select("informant", "hits", "misses", "false_alarms", "correct_rejections", ratio(h, h + m).alias("hit_rate"), ratio(f, f + r).alias("false_alarm_rate"), ratio(h, h + m + f).alias("jaccard"))


def accuracy_against_others(reports: DataFrame, informants: DataFrame, people: DataFrame, threshold: float = 0.5, undirected: bool = False) -> DataFrame:
    """Accuracy of each informant against the consensus of all others: their shares follow from the whole count less the informant's own report."""
    said = canonical(reports, people, undirected)
    counts = said.groupBy("frm", "to").agg(F.count("*").alias("c"))
    n = informants.agg(F.count("*").alias("n"))
    spread = informants.select("informant").join(F.broadcast(n)).join(F.broadcast(counts))  # informants times reported pairs
    mine = said.withColumn("own", F.lit(1))
    rest = spread.join(mine, ["informant", "frm", "to"], "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("others", F.col("c") - F.col("own"))
    rest = rest.withColumn("true", (F.col("others") > 0) & (F.col("others") / (F.col("n") - 1) >= threshold - 1e-12))
    sums = rest.where("n > 1").groupBy("informant").agg(F.count_if((F.col("own") == 1) & F.col("true")).alias("hits"), F.count_if((F.col("own") == 0) & F.col("true")).alias("misses"), F.count_if((F.col("own") == 1) & ~F.col("true")).alias("false_alarms"))
    all_ = F.col("hits") + F.col("misses") + F.col("false_alarms")
    return sums.withColumn("jaccard", F.when(all_ > 0, F.col("hits") / all_))


def best_perceivers(rows: DataFrame) -> DataFrame:
    """(informant, jaccard): those with the highest Jaccard, equal ones at two decimals together."""
    top = rows.agg(F.max(F.round("jaccard", 2)).alias("top"))
    return rows.where("jaccard IS NOT NULL").join(F.broadcast(top)).where(F.round("jaccard", 2) == F.col("top")).select("informant", "jaccard")


def symmetry(reports: DataFrame) -> DataFrame:
    """(informant, ties, share, way): the share of an informant's ties that go both ways; 'two' or 'one' where informants differ by 0.3 or more, split at the middle, else null."""
    flat = reports.select("informant", "frm", "to").distinct()
    back = flat.select("informant", F.col("to").alias("frm"), F.col("frm").alias("to"), F.lit(1).alias("back"))
    rows = flat.join(back, ["informant", "frm", "to"], "left").groupBy("informant").agg(F.count("*").alias("ties"), (F.count("back") / F.count("*")).alias("share"))
    ends = rows.where(f"ties >= {LEAST_TIES}").agg(F.min("share").alias("lo"), F.max("share").alias("hi"), F.count("*").alias("k"))
    mixed = (F.col("k") > 1) & (F.col("hi") - F.col("lo") >= MIXED_GAP) & (F.col("ties") >= LEAST_TIES)
    way = F.when(mixed, F.when(F.col("share") > (F.col("lo") + F.col("hi")) / 2, "two").otherwise("one"))
    return rows.join(F.broadcast(ends)).select("informant", "ties", "share", way.alias("way"))


def disagreement(shares: DataFrame, top: int = 20) -> DataFrame:
    """(frm, to, share, score): the pairs informants disagree most about, 4p(1 - p)."""
    p = F.col("share")
    return shares.where((p > 0) & (p < 1)).withColumn("score", 4 * p * (1 - p)).orderBy(F.desc("score"), "frm", "to").limit(top)


# ---- rosters: reports (respondent, frm, to, value, fields map) ----


def merged_reports(reports: DataFrame, people: DataFrame, rule: str = "union") -> DataFrame:
    """(frm, to, value, one_sided): reports as given (respondent), or one tie a pair in roster order with the larger value (union), or with the smaller one where both reported (intersection)."""
    flat = reports.where("value <> 0").groupBy("frm", "to").agg(F.max("value").alias("value"))
    if rule == "respondent":
        return flat.select("frm", "to", "value", F.lit(False).alias("one_sided"))
    place = lambda c, n: people.select(F.col("person").alias(c), F.col("place").alias(n))
    ranked = flat.join(place("frm", "p"), "frm").join(place("to", "q"), "to")
    turn = F.col("p") > F.col("q")
    pairs = ranked.select(F.when(turn, F.col("to")).otherwise(F.col("frm")).alias("frm"), F.when(turn, F.col("frm")).otherwise(F.col("to")).alias("to"), "value")
    sums = pairs.groupBy("frm", "to").agg(F.max("value").alias("most"), F.min("value").alias("least"), F.count("*").alias("n"))
    if rule == "intersection":
        return sums.where("n = 2").select("frm", "to", F.col("least").alias("value"), F.lit(False).alias("one_sided"))
    return sums.select("frm", "to", F.col("most").alias("value"), (F.col("n") == 1).alias("one_sided"))


def combined_fields(fields: DataFrame, types: dict[str, str], rule: str = "union") -> DataFrame:
    """(a, b, field, value) of two people's answers (a, b, reporter, field, value) about one tie: numbers by the rule, choices all kept, texts joined by ' / '."""
    kinds = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    typed = fields.withColumn("type", kinds[F.col("field")])
    number = F.expr("try_cast(value AS double)")
    best = F.min(number) if rule == "intersection" else F.max(number)
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("reporter", "value"))), lambda x: x["value"]))
    sums = typed.groupBy("a", "b", "field").agg(F.max("type").alias("type"), best.alias("number"), listed.alias("listed"))
    shown = F.when(F.col("type").isin("scale", "number"), F.regexp_replace(F.col("number").cast("string"), r"\.0$", "")).when(F.col("type") == "choice", F.array_join("listed", "; ")).otherwise(F.array_join("listed", " / "))
    return sums.select("a", "b", "field", shown.alias("value"))


def coerced(value: str | None, kind: str, options: list[str] | None = None, most: int = 5) -> str | None:
    """An answer as its field has it: a scale point from 1 to its end, a number, one of the options, text; None where it isn't one."""
    text = (value or "").strip()
    if not text:
        return None
    if kind in ("scale", "number"):
        try:
            n = float(text)
        except ValueError:
            return None
        if kind == "scale":
            return str(round(n)) if 1 <= round(n) <= most else None
        return text
    if kind == "choice" and options:
        return next((o for o in options if o.lower() == text.lower()), None)
    return text[:2000]


def roster_coverage(people: DataFrame, reports: DataFrame) -> DataFrame:
    """(person, responded) of everyone on a roster."""
    said = reports.select(F.col("respondent").alias("person")).distinct().withColumn("r", F.lit(True))
    return people.select("person").join(said, "person", "left").select("person", F.coalesce("r", F.lit(False)).alias("responded"))


def tie_weight(cell):
    """A survey cell as a weight: words that mean no tie are 0, numbers as they are, other answers 1."""
    text = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    return F.when(text.isin(*NO_TIE), 0.0).otherwise(F.coalesce(F.regexp_replace(text, ",", ".").try_cast("double"), F.lit(1.0)))


# ---- shared responses ----


def canonical_json(value) -> str:
    """JSON with keys in order and no spaces, as checksums are made of it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checksum(value) -> str:
    return f"{zlib.crc32(canonical_json(value).encode()):08x}"


def packed(value) -> str:
    """A response with its checksum in front."""
    return f"{checksum(value)}.{canonical_json(value)}"


def unpacked(text: str):
    """The value of a packed response; None if its checksum is wrong."""
    crc, _, body = text.partition(".")
    try:
        value = json.loads(body)
    except ValueError:
        return None
    return value if checksum(value) == crc else None


def accepted(responses: DataFrame, survey: str) -> DataFrame:
    """(response, respondent, at, outcome): the latest valid response of each respondent to this survey is accepted; older ones are 'replaced', others 'other survey' or 'invalid'.

    responses (response, survey, respondent, at, body, crc)."""
    valid = F.lower(F.lpad(F.hex(F.crc32(F.col("body").cast("binary"))), 8, "0")) == F.lower("crc")
    judged = responses.withColumn("why", F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("survey") != survey, "other survey"))
    place = F.row_number().over(Window.partitionBy("respondent").orderBy(F.desc("at"), F.desc("response")))
    good = judged.where("why IS NULL").withColumn("why", F.when(place == 1, "accepted").otherwise("replaced"))
    return good.unionByName(judged.where("why IS NOT NULL")).select("response", "respondent", "at", F.col("why").alias("outcome"))


# ---- personal interviews ----


def alter_ties(settings_: DataFrame, exceptions: DataFrame, alters: DataFrame) -> DataFrame:
    """(a, b, tied, why) of pairs of alters that share a setting (setting, alter) or are an exception (a, b, tied): an exception overrides what a setting implies."""
    here = settings_.join(alters.select("alter"), "alter", "left_semi")
    implied = here.select("setting", F.col("alter").alias("a")).join(here.select("setting", F.col("alter").alias("b")), "setting").where("a < b").select("a", "b").distinct()
    told = exceptions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tied").where("a <> b")
    both = implied.withColumn("implied", F.lit(True)).join(told, ["a", "b"], "full")
    on = F.coalesce("tied", F.coalesce("implied", F.lit(False)))
    why = F.when(F.col("tied").isNull(), "setting").when(F.col("tied"), "added").otherwise("removed")
    return both.select("a", "b", on.alias("tied"), why.alias("why"))


def stitched(interviews: DataFrame, roster: DataFrame) -> DataFrame:
    """(ego, person, matched): alters (ego, alter, name) matched to a roster (person, name) by normalised name where one person has it; others stay the ego's own."""
    from kinweave.functions import text as words

    names = roster.select("person", F.array_join(words.name_tokens(F.col("name")), " ").alias("plain")).where("plain <> ''")
    single = names.groupBy("plain").agg(F.count("*").alias("n"), F.min("person").alias("person")).where("n = 1")
    alters = interviews.withColumn("plain", F.array_join(words.name_tokens(F.col("name")), " "))
    own = F.concat_ws("/", F.col("ego").cast("string"), F.col("alter").cast("string"))
    return alters.join(single.select("plain", "person"), "plain", "left").select("ego", "alter", F.coalesce(F.col("person").cast("string"), own).alias("person"), F.col("person").isNotNull().alias("matched"))


def reference_ties(events: DataFrame, nodes: DataFrame, people: DataFrame) -> DataFrame:
    """(frm, to) among people of a roster (person, label) that a dataset's events hold, its nodes met by normalised name where one person has it."""
    from kinweave.functions import text as words

    plain = lambda c: F.array_join(words.name_tokens(F.col(c)), " ")
    roster = people.select("person", plain("label").alias("name")).where("name <> ''")
    roster = roster.join(roster.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name"), "name")
    met = nodes.select(F.col("node_id").alias("node"), plain("label").alias("name")).join(roster, "name").select("node", "person")
    pairs = events.select(F.col("actor").alias("a"), F.explode("targets.node").alias("b")).distinct()
    ends = pairs.join(met.select(F.col("node").alias("a"), F.col("person").alias("frm")), "a").join(met.select(F.col("node").alias("b"), F.col("person").alias("to")), "b")
    return ends.where("frm <> to").select("frm", "to").distinct()
