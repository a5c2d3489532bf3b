"""Network files: GraphML, GEXF, GML, Pajek, UCINET DL, and saved datasets; each file is parsed whole by one task."""

from __future__ import annotations

import json
import math
import re
import shlex
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.model import EVENT_TYPES, LAYERS, ROLES, Dataset
from kinweave.sources import base

#: What a parser gives: a node (src is its id, dst null), an edge, or the file's direction.
ROWS = "kind string, src string, dst string, w double, label string, directed boolean, mode int, attrs map<string, string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def graphml(_: str, data: bytes) -> Iterator[dict]:
    root = ElementTree.fromstring(data)
    names = {k.get("id"): (k.get("attr.name") or k.get("id")) for k in root.iter() if _local(k.tag) == "key"}
    for graph in (g for g in root.iter() if _local(g.tag) == "graph"):
        directed = graph.get("edgedefault") != "undirected"
        yield {"kind": "file", "directed": directed}
        for item in graph:
            data_ = {names.get(d.get("key"), d.get("key")): (d.text or "").strip() for d in item if _local(d.tag) == "data"}
            if _local(item.tag) == "node":
                yield {"kind": "node", "src": item.get("id"), "label": data_.pop("label", None) or data_.pop("Label", None), "attrs": {k: v for k, v in data_.items() if v}, "mode": _mode(data_.get("bipartite"))}
            elif _local(item.tag) == "edge":
                weight = data_.pop("weight", None) or data_.pop("Weight", None)
                yield {"kind": "edge", "src": item.get("source"), "dst": item.get("target"), "w": _number(weight, 1.0), "attrs": {k: v for k, v in data_.items() if v}}


def gexf(_: str, data: bytes) -> Iterator[dict]:
    root = ElementTree.fromstring(data)
    graph = next(g for g in root.iter() if _local(g.tag) == "graph")
    yield {"kind": "file", "directed": graph.get("defaultedgetype", "undirected") == "directed"}
    names = {}
    for group in (a for a in graph.iter() if _local(a.tag) == "attributes"):
        names |= {(group.get("class"), a.get("id")): a.get("title") for a in group}
    for item in graph.iter():
        kind = _local(item.tag)
        if kind in ("node", "edge"):
            attrs = {names.get((kind, v.get("for")), v.get("for")): v.get("value") for v in item.iter() if _local(v.tag) == "attvalue"}
            if kind == "node":
                yield {"kind": "node", "src": item.get("id"), "label": item.get("label"), "attrs": attrs, "mode": _mode(attrs.get("bipartite"))}
            else:
                yield {"kind": "edge", "src": item.get("source"), "dst": item.get("target"), "w": _number(item.get("weight"), 1.0), "attrs": attrs}


def gml(_: str, data: bytes) -> Iterator[dict]:
    words = re.findall(r'"[^"]*"|[\[\]]|[^\s\[\]"]+', re.sub(r"(?m)^\s*#.*$", "", data.decode("utf-8", "replace")))
    at = 0

    def block() -> list[tuple[str, object]]:
        nonlocal at
        out = []
        while at < len(words) and words[at] != "]":
            key, value = words[at], words[at + 1] if at + 1 < len(words) else ""
            at += 2
            if value == "[":
                out.append((key, block()))
                at += 1
            else:
                out.append((key, _plain(value.strip('"'))))
        return out

    for graph in (v for k, v in block() if k == "graph" and isinstance(v, list)):
        yield {"kind": "file", "directed": dict((k, v) for k, v in graph if not isinstance(v, list)).get("directed") == "1"}
        for key, item in graph:
            if isinstance(item, list):
                values = {k: v for k, v in item if not isinstance(v, list)}
                if key == "node":
                    yield {"kind": "node", "src": values.pop("id"), "label": values.pop("label", None), "mode": _mode(values.get("bipartite")), "attrs": values}
                elif key == "edge":
                    yield {"kind": "edge", "src": values.pop("source"), "dst": values.pop("target"), "w": _number(values.pop("weight", values.pop("value", None)), 1.0), "attrs": values}


def _plain(text: str) -> str:
    return re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text).replace("&quot;", '"').replace("&amp;", "&")


def pajek(_: str, data: bytes) -> Iterator[dict]:
    section, edges, arcs, first_mode = "", 0, 0, None
    for line in data.decode("utf-8-sig", "replace").splitlines():
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if line.startswith("*"):
            section = line.split()[0].lower()
            sizes = [int(x) for x in line.split()[1:] if x.isdigit()]
            first_mode = sizes[1] if section == "*vertices" and len(sizes) > 1 else first_mode
            continue
        parts = shlex.split(line, posix=True)
        if section == "*vertices":
            yield {"kind": "node", "src": parts[0], "label": parts[1] if len(parts) > 1 else parts[0], "attrs": {}, "mode": None if first_mode is None else int(int(parts[0]) > first_mode)}
        elif section in ("*edges", "*arcs"):
            edges, arcs = edges + (section == "*edges"), arcs + (section == "*arcs")
            yield {"kind": "edge", "src": parts[0], "dst": parts[1], "w": _number(parts[2] if len(parts) > 2 else None, 1.0), "attrs": {}}
        elif section in ("*edgeslist", "*arcslist"):
            edges, arcs = edges + (section == "*edgeslist"), arcs + (section == "*arcslist")
            for to in parts[1:]:
                yield {"kind": "edge", "src": parts[0], "dst": to, "w": 1.0, "attrs": {}}
    yield {"kind": "file", "directed": bool(arcs) or not edges}


def dl(_: str, data: bytes) -> Iterator[dict]:
    text = data.decode("utf-8-sig", "replace")
    head, _, body = re.split(r"(?i)(data\s*:)", text, maxsplit=1) if re.search(r"(?i)data\s*:", text) else (text, "", "")
    setting = lambda k: (re.search(rf"(?i)\b{k}\s*=\s*([\w]+)", head) or [None, None])[1]
    listed = lambda k: _labels(re.search(rf"(?is)\b{k}\s*:\s*(.*?)(?=\b(?:row labels|column labels|labels|matrix labels|data)\b|$)", head))
    form = (setting("format") or "fullmatrix").lower()
    rows, columns = setting("nr"), setting("nc")
    rows_, columns_ = (listed("row labels"), listed("column labels")) if rows else (listed("(?<!row )(?<!column )labels"),) * 2
    yield {"kind": "file", "directed": not rows}
    for i, label in enumerate(rows_):
        yield {"kind": "node", "src": label, "label": label, "mode": 0 if rows else None, "attrs": {}}
    if rows:
        for label in columns_:
            yield {"kind": "node", "src": label, "label": label, "mode": 1, "attrs": {}}
    lines = [shlex.split(x.replace("'", "\\'")) for x in body.splitlines() if x.strip()]
    if form.startswith("edgelist"):
        name = lambda x, known: known[int(x) - 1] if x.isdigit() and int(x) <= len(known) else x
        for p in lines:
            yield {"kind": "edge", "src": name(p[0], rows_), "dst": name(p[1], columns_), "w": _number(p[2] if len(p) > 2 else None, 1.0), "attrs": {}}
    elif form.startswith("nodelist"):
        for p in lines:
            for to in p[1:]:
                yield {"kind": "edge", "src": p[0], "dst": to, "w": 1.0, "attrs": {}}
    else:
        cells = [float(x) for p in lines for x in p]
        wide = int(columns) if columns else len(columns_) or math.isqrt(len(cells))
        rows_ = rows_ or [str(i + 1) for i in range(len(cells) // wide)]
        columns_ = columns_ or (rows_ if not rows else [str(i + 1) for i in range(wide)])
        for at, w in enumerate(cells):
            a, b = rows_[at // wide], columns_[at % wide]
            if w and a != b:
                yield {"kind": "edge", "src": a, "dst": b, "w": w, "attrs": {}}


def _labels(found: re.Match | None) -> list[str]:
    return [x.strip().strip('"') for x in re.findall(r'"[^"]*"|[^,\s]+', found[1])] if found else []


def _number(text: str | None, default: float) -> float:
    try:
        return float(text) if text not in (None, "") else default
    except ValueError:
        return default


def _mode(value: str | None) -> int | None:
    return {"0": 0, "1": 1, "false": 0, "true": 1}.get(str(value).strip().lower())


FORMATS = {"graphml": graphml, "gexf": gexf, "gml": gml, "net": pajek, "paj": pajek, "dl": dl}


def read(spark: SparkSession, path: str, kind: str | None = None) -> Dataset:
    """A network file as declared ties; the kind is that of the file's ending unless given. Two-mode files become affiliations."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    rows = base.parsed(spark, path, FORMATS[kind], ROWS)
    return _dataset(rows, kind)


def _dataset(rows: DataFrame, kind: str) -> Dataset:
    key = lambda c: F.concat(F.lit("net:"), F.col(c))
    found = rows.where("kind <> 'edge'").agg(F.bool_and(F.when(F.col("kind") == "file", F.col("directed"))).alias("directed"), F.max("mode").alias("most"), F.min("mode").alias("least")).collect()[0]
    modes = found["most"] == 1 and found["least"] == 0
    people = rows.where("kind = 'node'").select(key("src").alias("key"), F.coalesce("label", "src").alias("label"), "mode", "attrs")
    edges = rows.where("kind = 'edge' AND src <> dst AND w <> 0")
    if modes:  # affiliations point from mode 0 to mode 1
        second = people.where("mode = 1").select(F.substring("key", 5, 10_000).alias("src"), F.lit(True).alias("turned"))
        edges = edges.join(second, "src", "left").withColumn("x", F.when(F.col("turned"), F.col("dst")).otherwise(F.col("src"))).withColumn("y", F.when(F.col("turned"), F.col("src")).otherwise(F.col("dst"))).drop("src", "dst").withColumnRenamed("x", "src").withColumnRenamed("y", "dst")
    records = edges.select(
        F.concat_ws(":", F.lit("net:edge"), F.monotonically_increasing_id().cast("string")).alias("key"), F.lit("declared").alias("type"), key("src").alias("actor"), F.lit("net:file").alias("context"), F.col("w").alias("weight"),
        F.array(F.struct(key("dst").alias("node"), F.lit("member" if modes else "declared").alias("role"))).alias("targets"),
        F.when(F.size("attrs") > 0, F.transform_values("attrs", lambda _, v: F.array(v))).alias("attrs"),
    )
    places = rows.sparkSession.createDataFrame([("net:file", "network")], "key string, kind string")
    return base.assemble(records, people, places, {"format": kind, "directed": False if modes or not found["directed"] else None})


# ---- saved datasets ----


def _unpacked(x):
    """Typed arrays are saved as {"__ta": type, "d": values}."""
    return x["d"] if isinstance(x, dict) and "d" in x else x


def saved(spark: SparkSession, path: str) -> Dataset:
    """A dataset saved as one JSON file: numbered nodes, contexts and events with targets as offsets."""
    text = spark.read.text(path, wholetext=True).collect()[0]["value"]  # a project file, made to be opened in one piece
    data = json.loads(text)
    nodes, contexts, ev = data["nodes"], data["contexts"], data["events"]
    column = lambda t, k, n, default=None: (_unpacked(t.get(k)) or [default] * n)
    n, m, e = len(nodes["keys"]), len(contexts["keys"]), ev["count"]
    as_text = lambda v: "true" if v is True else "false" if v is False else str(v)
    attrs = [{k: as_text(v) for k, v in (a or {}).items() if v is not None} for a in column(nodes, "attrs", n)]
    people = [(i, nodes["keys"][i], column(nodes, "labels", n)[i], bool(column(nodes, "isBot", n, 0)[i]), _mode(attrs[i].get("bipartite")), attrs[i]) for i in range(n)]
    places = [(i, contexts["keys"][i], column(contexts, "names", m)[i], column(contexts, "kinds", m)[i], LAYERS[column(contexts, "visibility", m, 4)[i]], column(contexts, "medium", m)[i]) for i in range(m)]
    offsets, to, roles = _unpacked(ev["tOff"]), _unpacked(ev["tgt"]), _unpacked(ev["role"])
    when = lambda t: None if t is None else datetime(1970, 1, 1) + timedelta(milliseconds=t)
    minus = lambda x: None if x is None or x < 0 else x
    fields = lambda a: {k: [as_text(x) for x in (v if isinstance(v, list) else [v])] for k, v in a.items()} if a else None
    kinds, ts, actors, ctx, parents, weights, sources, texts, keys, evattrs = (column(ev, k, e, d) for k, d in (("type", 0), ("t", None), ("actor", 0), ("context", -1), ("parent", -1), ("weight", 1.0), ("source", 0), ("text", None), ("keys", None), ("attrs", None)))
    rows = [(i, EVENT_TYPES[kinds[i]], when(ts[i]), actors[i], minus(ctx[i]), minus(parents[i]), float(weights[i]), sources[i], texts[i], keys[i], fields(evattrs[i]), [(to[j], ROLES[roles[j]]) for j in range(offsets[i], offsets[i + 1])]) for i in range(e)]
    from_ = [(i, s.get("format"), s.get("medium"), s.get("view") or "full", s.get("directed"), [f["key"] for f in s.get("tieFields") or []] or None) for i, s in enumerate(data.get("meta", {}).get("sources") or [])]
    from kinweave.model import SCHEMAS

    schema = lambda k: ", ".join(f"{c} {t}" for c, (t, _) in SCHEMAS[k].items())
    return Dataset.of(spark.createDataFrame(people, schema("nodes")), spark.createDataFrame(rows, schema("events")), spark.createDataFrame(places, schema("contexts")), spark.createDataFrame(from_, schema("sources")))
