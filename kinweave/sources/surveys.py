"""Surveys and interviews as datasets: personal-network tables, roster forms, drawings, interview sessions, perceived networks, shared responses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import Dataset
from kinweave.operators import surveys
from kinweave.sources import base

_EGO, _ALTER, _SOURCE, _TARGET, _WEIGHT = ["egoid", "ego.id", "ego_id", "networkcanvasegouuid"], ["alterid", "alter.id", "alter_id", "networkcanvasuuid"], ["srcid", ".srcid", "source", "from", "networkcanvassourceuuid"], ["tgtid", ".tgtid", "target", "to", "networkcanvastargetuuid"], ["weight", "value", "strength"]


def column(table: DataFrame, names: list[str]) -> str | None:
    """The table's column that one of the names stands for, without regard to case and marks."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    wanted = [plain(n) for n in names]
    return next((c for w in wanted for c in table.columns if plain(c) == w), None)


def _attrs(table: DataFrame, leave: list[str | None]) -> Column:
    kept = [c for c in table.columns if c not in leave]
    if not kept:
        return F.lit(None).cast("map<string, string>")
    cells = F.map_from_arrays(F.array(*[F.lit(c) for c in kept]), F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in kept]))
    return F.map_filter(cells, lambda _, v: v.isNotNull() & (v != ""))


def interviews(alters: DataFrame, ties: DataFrame | None = None, egos: DataFrame | None = None, weight: str | None = None, namespace: str = "survey") -> Dataset:
    """Long tables of personal networks: alters (ego, alter, attributes), ties between alters of one ego, egos with attributes. Alters are kept apart by ego; ties of value 0 are none.

    The columns are found by their usual names, those of interview software included."""
    ego, alter = column(alters, _EGO), column(alters, _ALTER)
    named = column(alters, ["name", "alter.name", "label"])
    key = lambda e, a=None: F.concat_ws(":", F.lit(namespace), *([e] if a is None else [e, a]))
    held = alters.where(F.col(f"`{ego}`").isNotNull() & F.col(f"`{alter}`").isNotNull())
    e, a = F.col(f"`{ego}`").cast("string"), F.col(f"`{alter}`").cast("string")
    amount = F.coalesce(F.col(f"`{weight}`").cast("string").try_cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    label = F.coalesce(F.col(f"`{named}`") if named else F.lit(None).cast("string"), F.concat(F.lit("Alter "), a, F.lit(" of "), e))
    people = held.select(key(e, a).alias("key"), label.alias("label"), F.map_concat(F.coalesce(_attrs(held, [ego, alter]), F.create_map().cast("map<string,string>")), F.create_map(F.lit("kind"), F.lit("alter"))).alias("attrs"))
    people = people.unionByName(held.select(key(e).alias("key"), F.concat(F.lit("Respondent "), e).alias("label"), F.create_map(F.lit("kind"), F.lit("ego")).alias("attrs")).dropDuplicates(["key"]))
    if egos is not None:
        own = column(egos, _EGO)
        x = F.col(f"`{own}`").cast("string")
        people = egos.where(x.isNotNull()).select(key(x).alias("key"), F.concat(F.lit("Respondent "), x).alias("label"), F.map_concat(F.coalesce(_attrs(egos, [own]), F.create_map().cast("map<string,string>")), F.create_map(F.lit("kind"), F.lit("ego"))).alias("attrs")).unionByName(people)
    declared = lambda to: F.array(F.struct(to.alias("node"), F.lit("declared").alias("role")))
    records = held.select(F.concat(key(e, a), F.lit("#named")).alias("key"), F.lit("declared").alias("type"), key(e).alias("actor"), key(e).alias("context"), amount.alias("weight"), declared(key(e, a)).alias("targets"))
    if ties is not None:
        te, s, t, w = column(ties, _EGO), column(ties, _SOURCE), column(ties, _TARGET), column(ties, _WEIGHT)
        x, y, z = (F.col(f"`{c}`").cast("string") for c in (te, s, t))
        amount = F.coalesce(F.col(f"`{w}`").cast("string").try_cast("double"), F.lit(1.0)) if w else F.lit(1.0)
        listed = held.select(key(e, a).alias("known"))
        rows = ties.where(x.isNotNull() & y.isNotNull() & z.isNotNull()).select(key(x, y).alias("actor"), key(x, z).alias("to"), key(x).alias("context"), amount.alias("weight")).where("weight <> 0")
        rows = rows.join(listed.withColumnRenamed("known", "actor"), "actor", "left_semi").join(listed.withColumnRenamed("known", "to"), "to", "left_semi")
        records = base.shaped(records, base.RECORDS).unionByName(base.shaped(rows.select(F.concat_ws("~", "actor", "to").alias("key"), F.lit("declared").alias("type"), "actor", "context", "weight", declared(F.col("to")).alias("targets")), base.RECORDS))
    places = held.select(key(e).alias("key")).distinct().select("key", F.lit("survey").alias("kind"), F.lit("private").alias("visibility"))
    return base.assemble(records, people, places, {"format": "ego-interview", "medium": "survey", "view": "ego", "directed": False})


def wide_interviews(table: DataFrame, ego: str, names: list[str], pairs: dict[str, tuple[int, int]]) -> Dataset:
    """One row for each ego: columns that name its alters, and columns for pairs of alters (numbers from 1), any positive number of which is a tie."""
    alters = table.select(F.col(f"`{ego}`").alias("egoID"), F.posexplode(F.array(*[F.trim(F.col(f"`{n}`").cast("string")) for n in names])).alias("i", "name")).where("name IS NOT NULL AND name <> ''").select("egoID", (F.col("i") + 1).cast("string").alias("alterID"), "name")
    cells = F.explode(F.array(*[F.struct(F.lit(str(a)).alias("srcID"), F.lit(str(b)).alias("tgtID"), F.col(f"`{c}`").cast("string").try_cast("double").alias("weight")) for c, (a, b) in pairs.items()]))
    ties = table.select(F.col(f"`{ego}`").alias("egoID"), cells.alias("c")).select("egoID", "c.*").where("weight > 0")
    return interviews(alters, ties, table.select(F.col(f"`{ego}`").alias("egoID"), *[c for c in table.columns if c not in (ego, *names, *pairs)]))


# ---- rosters ----


def roster_text(text: str) -> tuple[list[dict[str, str]], list[str]]:
    """(people, duplicates) of a pasted roster: one name a line, or a table with a name column; a name that comes again is reported."""
    import csv

    lines = [x for x in text.lstrip("﻿").strip().splitlines() if x.strip()]
    if not lines:
        return [], []
    delimiter = next((d for d in ("\t", ";", ",") if d in lines[0]), None)
    rows = [dict.fromkeys(["name"], x.strip()) for x in lines]
    if delimiter:
        table = list(csv.reader(lines, delimiter=delimiter))
        head = [h.strip() for h in table[0]]
        at = next((i for i, h in enumerate(head) if re.fullmatch(r"(?i)(full |person'?s? ?)?name|person|member|label", h)), None)
        if at is not None:
            rows = [{"name": r[at].strip(), **{h: c.strip() for h, c in zip(head, r) if h != head[at] and c.strip()}} for r in table[1:] if len(r) > at and r[at].strip()]
    seen, people, twice = set(), [], []
    for r in rows:
        plain = " ".join(r["name"].lower().split())
        (twice.append(r["name"]) if plain in seen else people.append(r))
        seen.add(plain)
    return people, twice


def form_header(people: list[str], questions: list[str]) -> list[str]:
    """Column heads of a form that asks each question about everyone on the roster."""
    return ["Timestamp", "Your name", *[f"{q} [{p}]" for q in questions for p in people]]


def form_responses(table: DataFrame, people: list[str], questions: list[str]) -> DataFrame:
    """(respondent, relation, frm, to, value) of form answers: columns 'question [name]' or 'question - name'; the last answer of a person counts; answers about oneself don't."""
    plain = lambda s: " ".join(s.lower().split())
    known, asked = {plain(p): p for p in people}, {plain(q): q for q in questions}
    who = next((c for c in table.columns if re.fullmatch(r"(?i)your name|name|what is your name\??|who are you\??|respondent( name)?", c.strip())), None)
    if who is None:
        raise ValueError("no column with the respondent's name")
    cells = []
    for c in table.columns:
        m = re.match(r"^(.*\S)\s*\[(.+)\]\s*$", c) or re.match(r"^(.*\S)\s+-\s+(.+)$", c)
        if m and plain(m[2]) in known:
            stem = asked.get(plain(m[1])) or (questions[0] if len(questions) == 1 else None)
            if stem:
                cells.append(F.struct(F.lit(stem).alias("relation"), F.lit(known[plain(m[2])]).alias("to"), surveys.tie_weight(F.col(f"`{c}`")).alias("value")))
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    numbered = table.withColumn("_n", F.monotonically_increasing_id()).withColumn("frm", names[F.lower(F.trim(F.regexp_replace(F.col(f"`{who}`"), r"\s+", " ")))]).where("frm IS NOT NULL")
    last = numbered.groupBy("frm").agg(F.max("_n").alias("_n"))
    rows = numbered.join(last, ["frm", "_n"]).select("frm", F.explode(F.array(*cells)).alias("c"))
    return rows.select(F.col("frm").alias("respondent"), "c.relation", "frm", "c.to", "c.value").where("frm <> to AND value <> 0")


def roster(people: DataFrame, reports: DataFrame, rule: str = "union") -> Dataset:
    """A roster's reports (respondent, relation, frm, to, value) as declared ties, each relation merged by a rule; people (person, place[, attrs])."""
    found = None
    for relation in [r[0] for r in reports.select("relation").distinct().orderBy("relation").collect()]:  # a row for each question
        merged = surveys.merged_reports(reports.where(F.col("relation") == relation), people, rule).withColumn("relation", F.lit(relation))
        found = base.joined(found, merged)
    key = lambda c: F.concat(F.lit("roster:"), F.col(c))
    records = found.select(F.concat_ws("~", key("frm"), "to", "relation").alias("key"), F.lit("declared").alias("type"), key("frm").alias("actor"), F.concat(F.lit("roster:relation:"), "relation").alias("context"), F.col("value").alias("weight"), F.array(F.struct(key("to").alias("node"), F.lit("declared").alias("role"))).alias("targets"), F.create_map(F.lit("relation"), F.array("relation")).alias("attrs"))
    listed = people.select(key("person").alias("key"), F.col("person").alias("label"), *(["attrs"] if "attrs" in people.columns else []))
    places = found.select(F.concat(F.lit("roster:relation:"), "relation").alias("key"), F.lit("survey").alias("kind")).distinct()
    return base.assemble(records, listed, places, {"format": "roster", "medium": "survey", "directed": None if rule == "respondent" else False, "tie_fields": ["relation"]})


def perceived(people: DataFrame, shares: DataFrame, undirected: bool = False) -> Dataset:
    """Agreement among informants (frm, to, share) as declared ties whose weight is the share."""
    key = lambda c: F.concat(F.lit("css:"), F.col(c))
    records = shares.where("share > 0").select(F.concat_ws("~", key("frm"), "to").alias("key"), F.lit("declared").alias("type"), key("frm").alias("actor"), F.lit("css:agreement").alias("context"), F.col("share").alias("weight"), F.array(F.struct(key("to").alias("node"), F.lit("declared").alias("role"))).alias("targets"))
    places = people.sparkSession.createDataFrame([("css:agreement", "survey")], "key string, kind string")
    return base.assemble(records, people.select(key("person").alias("key"), F.col("person").alias("label")), places, {"format": "css", "medium": "survey", "directed": False if undirected else None})


# ---- drawings and sessions: one JSON document each ----


def drawing(spark: SparkSession, document: dict) -> Dataset:
    """A drawn network: nodes (id, label, group, mode), groups, edges (source, target, weight, type, directed). If any tie is directed, undirected ones count both ways; two-mode drawings are affiliations."""
    two = bool(document.get("twoMode"))
    directed = not two and any(e.get("directed") for e in document.get("edges", []))
    names = {g["id"]: g["name"] for g in document.get("groups", [])}
    people = []
    for n in document.get("nodes", []):
        attrs = {k: str(v) for k, v in (n.get("attrs") or {}).items() if v not in (None, "")}
        if n.get("group") in names:
            attrs["group"] = names[n["group"]]
        people.append((f"draw:{n['id']}", n.get("label") or n["id"], False, int(n.get("mode") or 0) if two else None, attrs))
    mode = {p[0]: p[3] for p in people}
    rows = []
    for i, e in enumerate(document.get("edges", [])):
        a, b = f"draw:{e['source']}", f"draw:{e['target']}"
        if a not in mode or b not in mode or (two and mode[a] == mode[b]):
            continue
        if two and mode[a] == 1:
            a, b = b, a
        ends = [(a, b), (b, a)] if directed and not e.get("directed") else [(a, b)]
        rows += [(f"draw:{e.get('id', i)}:{k}", "declared", x, f"draw:type:{e.get('type') or 'tie'}", float(e.get("weight") or 1), [(y, "member" if two else "declared")]) for k, (x, y) in enumerate(ends)]
    records = spark.createDataFrame(rows, "key string, type string, actor string, context string, weight double, targets array<struct<node: string, role: string>>")
    places = spark.createDataFrame(sorted({(r[3], "canvas") for r in rows}), "key string, kind string")
    return base.assemble(records, spark.createDataFrame(people, base.PEOPLE), places, {"format": "draw", "medium": "canvas", "directed": None if directed else False})


def session(spark: SparkSession, document: dict) -> Dataset:
    """An interview session: ego, alters named under questions, settings that alters share, exceptions. A tie's weight is shared out among the questions that named the alter."""
    ego = f"ego:{document['egoId']}"
    alters = {a["id"]: a for a in document.get("alters", [])}
    key = lambda a: f"alter:{document['egoId']}:{a}"
    people = [(ego, document.get("egoLabel") or "Ego", False, None, {"kind": "ego"})] + [(key(i), a.get("label") or i, False, None, {"kind": "alter", **{k: str(v) for k, v in (a.get("attrs") or {}).items()}}) for i, a in alters.items()]
    rows = []
    for i, a in alters.items():
        asked = a.get("generators") or ["named"]
        rows += [(f"{key(i)}#{g}", "declared", ego, f"{ego}:gen:{g}", float(a.get("weight") or 1) / len(asked), [(key(i), "declared")]) for g in asked]
    pairs = {tuple(sorted((x, y))) for c in document.get("contexts", []) for x in c["members"] for y in c["members"] if x < y}
    told = {tuple(sorted(k.split("|"))): bool(v) for k, v in (document.get("ties") or {}).items()}
    for x, y in sorted((pairs | {p for p, on in told.items() if on}) - {p for p, on in told.items() if not on}):
        if x in alters and y in alters:
            rows.append((f"{key(x)}~{y}", "declared", key(x), f"{ego}:alter-ties", 1.0, [(key(y), "declared")]))
    records = spark.createDataFrame(rows, "key string, type string, actor string, context string, weight double, targets array<struct<node: string, role: string>>")
    places = spark.createDataFrame(sorted({(r[3], "survey", "direct") for r in rows}), "key string, kind string, visibility string")
    return base.assemble(records, spark.createDataFrame(people, base.PEOPLE), places, {"format": "ego-interview", "medium": "survey", "view": "ego", "directed": False})


def session_tables(document: dict) -> dict[str, list[dict]]:
    """A session as tables in the shape that interview software exports: egos, alters, ties."""
    ego = document["egoId"]
    alters = [{"networkCanvasEgoUUID": ego, "networkCanvasUUID": a["id"], "name": a.get("label"), **(a.get("attrs") or {})} for a in document.get("alters", [])]
    pairs = {tuple(sorted((x, y))) for c in document.get("contexts", []) for x in c["members"] for y in c["members"] if x < y}
    told = {tuple(sorted(k.split("|"))): bool(v) for k, v in (document.get("ties") or {}).items()}
    on = sorted((pairs | {p for p, v in told.items() if v}) - {p for p, v in told.items() if not v})
    return {"ego": [{"networkCanvasEgoUUID": ego}], "alters": alters, "ties": [{"networkCanvasEgoUUID": ego, "networkCanvasSourceUUID": x, "networkCanvasTargetUUID": y} for x, y in on]}


def shared(spark: SparkSession, path: str, survey: str, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, outcomes) of response files, a packed response a line: the latest valid one of each respondent counts."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("response"), F.substring_index("value", ".", 1).alias("crc"), F.expr("substring(value, instr(value, '.') + 1)").alias("body"))
    read = F.from_json("body", "survey string, respondent string, at string, ties map<string, map<string, double>>")
    rows = lines.withColumn("r", read).select("response", "crc", "body", F.col("r.survey").alias("survey"), F.col("r.respondent").alias("respondent"), F.col("r.at").try_cast("timestamp_ntz").alias("at"), F.col("r.ties").alias("ties"))
    outcome = surveys.accepted(rows, survey)
    good = rows.join(outcome.where("outcome = 'accepted'").select("response"), "response").select("respondent", F.explode("ties").alias("relation", "named")).select("respondent", "relation", F.explode("named").alias("to", "value"))
    listed = people.select(F.col("person").alias("to"))
    return good.join(listed, "to", "left_semi").select("respondent", "relation", F.col("respondent").alias("frm"), "to", "value"), outcome

