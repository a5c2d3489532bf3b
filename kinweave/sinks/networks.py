"""Networks as files: CSV, GraphML, GEXF, GML, Pajek, UCINET DL.

A document is a table of lines in order. ``write`` stores it as text parts whose concatenation, in the order of their names, is the
document, so nothing gathers in one task; ``collected`` joins the parts to one file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import ranked

#: Columns that identify people in contact lists.
CONTACT = re.compile(r"(?i)(^|[_\s-])(e-?mail|phone|mobile|tel|address|handle|username|url|platform_id)([_\s-]|$)")


def node_table(nodes: DataFrame, values: list[DataFrame] = (), omit_contacts: bool = False) -> DataFrame:
    """(id, label, attributes..., measures...): nodes (node, label, attrs map) with the columns of measure tables (node, ...). omit_contacts: names become p1, p2, ...
    and contact columns are left out."""
    kept = nodes
    if "attrs" in nodes.columns:
        keys = sorted(r[0] for r in nodes.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect())  # a row for each attribute
        for k in keys:
            if not (omit_contacts and CONTACT.search(k)):
                kept = kept.withColumn(k, F.col("attrs")[k])
        kept = kept.drop("attrs")
    for table in values:
        kept = kept.join(table, "node", "left")
    return anonymous(kept) if omit_contacts else kept


def anonymous(nodes: DataFrame) -> DataFrame:
    """Labels p1 to pn in the order of a hash, keys dropped."""
    named = ranked.numbered(nodes.drop("label", "key"), F.xxhash64("node").cast("double"), "_n", ("node",))
    return named.withColumn("label", F.concat(F.lit("p"), F.col("_n").cast("string"))).drop("_n")


def unique_labels(nodes: DataFrame) -> DataFrame:
    """Labels made unique: repeated ones get (2), (3) in the order of their nodes."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("node"))
    return nodes.withColumn("_i", place).withColumn("label", F.when(F.col("_i") > 1, F.concat("label", F.lit(" ("), F.col("_i").cast("string"), F.lit(")"))).otherwise(F.col("label"))).drop("_i")


def _document(*parts: tuple[DataFrame | list[str], Column | None]) -> DataFrame:
    """(part, place, line) of pieces: fixed lines, or tables with a column ``line`` in an order."""
    spark = next(p.sparkSession for p, _ in parts if isinstance(p, DataFrame))
    out = None
    for i, (piece, order) in enumerate(parts):
        if isinstance(piece, list):
            piece = spark.createDataFrame([(float(k), "", x) for k, x in enumerate(piece)], "place double, tie string, line string")
        else:
            piece = piece.select(order.cast("double").alias("place"), F.col("tie").cast("string").alias("tie") if "tie" in piece.columns else F.lit("").alias("tie"), "line")
        piece = piece.select(F.lit(i).alias("part"), "place", "tie", "line")
        out = piece if out is None else out.unionByName(piece)
    return out


def write(document: DataFrame, path: str, parts: int | None = None) -> None:
    spread = document.repartitionByRange(parts, "part", "place", "tie") if parts else document.repartitionByRange("part", "place", "tie")
    spread.sortWithinPartitions("part", "place", "tie").select("line").write.mode("overwrite").text(path)


def collected(document: DataFrame, path: str) -> None:
    """One local file, line by line; only one part is held at a time."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for row in document.orderBy("part", "place", "tie").toLocalIterator():
            f.write(row["line"] + "\n")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with numbers from 0 in ascending order of their ids, and labels."""
    nodes = nodes if "label" in nodes.columns else nodes.withColumn("label", F.col("node").cast("string"))
    by = F.col("node").cast("double") if nodes.schema["node"].dataType.simpleString() in ("int", "bigint") else F.lit(0.0)
    return ranked.numbered(nodes, by, "n", ("node",)).withColumn("n", F.col("n") - 1).withColumn("label", F.coalesce("label", F.col("node").cast("string")))


def _ends(ties: DataFrame, numbered: DataFrame) -> DataFrame:
    a, b = numbered.select(F.col("node").alias("src"), F.col("n").alias("a")), numbered.select(F.col("node").alias("dst"), F.col("n").alias("b"))
    return ties.join(a, "src").join(b, "dst")


def _shown(c: str, kind: str) -> Column:
    """Numbers without trailing zeros, other values as text."""
    text = F.col(f"`{c}`").cast("string")
    return F.regexp_replace(text, r"\.0$", "") if kind in ("double", "float") else text


def _csv(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_nodes(nodes: DataFrame) -> DataFrame:
    """Id, Label and every other column, RFC 4180 lines."""
    rest = [c for c in nodes.columns if c not in ("node", "label")]
    kinds = dict(nodes.dtypes)
    label = F.coalesce("label", F.col("node").cast("string")) if "label" in nodes.columns else F.col("node").cast("string")
    cells = [_csv(F.col("node").cast("string")), _csv(label), *[_csv(_shown(c, kinds[c])) for c in rest]]
    by = F.col("node").cast("double") if kinds["node"] in ("int", "bigint") else F.lit(0.0)
    rows = nodes.select(F.concat_ws(",", *cells).alias("line"), by.alias("by"), F.col("node").alias("tie"))
    return _document(([",".join(["Id", "Label", *rest])], None), (rows.select("line", "by", "tie"), F.col("by")))


def csv_edges(ties: DataFrame, directed: bool = True) -> DataFrame:
    """Source, Target, Type, Weight and every other column, such as evidence by rule."""
    rest = [c for c in ties.columns if c not in ("src", "dst", "w")]
    kinds = dict(ties.dtypes)
    cells = [_csv(F.col("src").cast("string")), _csv(F.col("dst").cast("string")), F.lit("Directed" if directed else "Undirected"), _shown("w", "double"), *[_csv(_shown(c, kinds[c])) for c in rest]]
    rows = ties.select(F.concat_ws(",", *cells).alias("line"), F.concat_ws("\x00", F.lpad(F.col("src").cast("string"), 20, " "), F.lpad(F.col("dst").cast("string"), 20, " ")).alias("tie"))
    return _document(([",".join(["Source", "Target", "Type", "Weight", *rest])], None), (rows, F.lit(0.0)))


def _xml(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


_TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "double", "boolean": "boolean"}


def _known(c: str, kind: str) -> Column:
    """Whether a value is there: no null, no NaN."""
    return F.col(f"`{c}`").isNotNull() & (~F.isnan(f"`{c}`") if kind in ("double", "float") else F.lit(True))


def graphml(nodes: DataFrame, ties: DataFrame, directed: bool = True) -> DataFrame:
    numbered = _numbered(nodes)
    nkinds, ekinds = dict(nodes.dtypes), dict(ties.dtypes)
    ncols = ["label", *[c for c in nodes.columns if c not in ("node", "label")]]
    ecols = ["w", *[c for c in ties.columns if c not in ("src", "dst", "w")]]
    title = lambda c: "weight" if c == "w" else c
    esc = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    keys = [f'  <key id="n{i}" for="node" attr.name="{esc(c)}" attr.type="{_TYPES.get(nkinds.get(c, "string"), "string")}"/>' for i, c in enumerate(ncols)]
    keys += [f'  <key id="e{i}" for="edge" attr.name="{esc(title(c))}" attr.type="{_TYPES.get(ekinds[c], "string")}"/>' for i, c in enumerate(ecols)]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, f'  <graph edgedefault="{"directed" if directed else "undirected"}">']
    cell = lambda k, i, c, kind: F.when(_known(c, kind), F.concat(F.lit(f'<data key="{k}{i}">'), _xml(_shown(c, kind)), F.lit("</data>"))).otherwise("")
    rows = numbered.select(F.concat(F.lit('    <node id="'), F.col("n").cast("string"), F.lit('">'), *[cell("n", i, c, nkinds.get(c, "string")) for i, c in enumerate(ncols)], F.lit("</node>")).alias("line"), "n")
    lines = _ends(ties, numbered)
    lines = lines.select(F.concat(F.lit('    <edge source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('">'), *[cell("e", i, c, ekinds[c]) for i, c in enumerate(ecols)], F.lit("</edge>")).alias("line"), "a", F.lpad(F.col("b").cast("string"), 20, "0").alias("tie"))
    return _document((head, None), (rows, F.col("n")), (lines, F.col("a")), (["  </graph>", "</graphml>"], None))


def edge_times(events: DataFrame, ties: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, times): the distinct times, in order, of dated events between the two of a tie; the rules aren't applied again."""
    pairs = events.where("t IS NOT NULL").select(F.col("actor").alias("src"), F.explode("targets.node").alias("dst"), "t")
    if not directed:
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "t")
    return pairs.join(ties.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.array_sort(F.collect_set("t")).alias("times"))


def gexf(nodes: DataFrame, ties: DataFrame, directed: bool = True, times: DataFrame | None = None) -> DataFrame:
    """GEXF 1.2; with times (src, dst, times) a dynamic graph with a spell of one moment for each."""
    numbered = _numbered(nodes)
    ncols = [c for c in nodes.columns if c not in ("node", "label")]
    nkinds = dict(nodes.dtypes)
    kind = lambda k: {"bigint": "long", "int": "integer", "double": "double", "boolean": "boolean"}.get(k, "string")
    esc = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    mode = ' mode="dynamic" timeformat="datetime"' if times is not None else ""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', f'  <graph defaultedgetype="{"directed" if directed else "undirected"}"{mode}>', '    <attributes class="node">', *[f'      <attribute id="{i}" title="{esc(c)}" type="{kind(nkinds[c])}"/>' for i, c in enumerate(ncols)], "    </attributes>", "    <nodes>"]
    values = [F.when(_known(c, nkinds[c]), F.concat(F.lit(f'<attvalue for="{i}" value="'), _xml(_shown(c, nkinds[c])), F.lit('"/>'))).otherwise("") for i, c in enumerate(ncols)]
    rows = numbered.select(F.concat(F.lit('      <node id="'), F.col("n").cast("string"), F.lit('" label="'), _xml(F.col("label")), F.lit('"><attvalues>'), *values, F.lit("</attvalues></node>")).alias("line"), "n")
    lines = _ends(ties, numbered)
    if times is not None:
        lines = lines.join(times, ["src", "dst"], "left")
        stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        spells = F.when(F.size("times") > 0, F.concat(F.lit("<spells>"), F.array_join(F.transform("times", lambda t: F.concat(F.lit('<spell start="'), stamp(t), F.lit('" end="'), stamp(t), F.lit('"/>'))), ""), F.lit("</spells>"))).otherwise("")
    else:
        spells = F.lit("")
    lines = lines.select(F.concat(F.lit('      <edge id="'), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")), F.lit('" source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('" weight="'), _shown("w", "double"), F.lit('">'), spells, F.lit("</edge>")).alias("line"), "a", F.lpad(F.col("b").cast("string"), 20, "0").alias("tie"))
    return _document((head, None), (rows, F.col("n")), (["    </nodes>", "    <edges>"], None), (lines, F.col("a")), (["    </edges>", "  </graph>", "</gexf>"], None))


def _gml_text(c: Column) -> Column:
    """ASCII: quotes, ampersands and other characters as references."""
    text = F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.array_join(F.transform(F.split(text, ""), lambda x: F.when(x.rlike(r"^[\x20-\x7e]?$"), x).otherwise(F.concat(F.lit("&#"), F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10), F.lit(";")))), "")


def gml(nodes: DataFrame, ties: DataFrame, directed: bool = True) -> DataFrame:
    numbered = _numbered(nodes)
    kinds = dict(nodes.dtypes) | dict(ties.dtypes)
    safe = lambda c: re.sub(r"[^A-Za-z0-9]", "", c) or "x"

    def cells(columns: list[str]) -> list[Column]:
        number = lambda c: kinds[c] in ("bigint", "int", "double", "float")
        return [F.when(_known(c, kinds[c]), F.concat(F.lit(f" {safe(c)} "), _shown(c, kinds[c]) if number(c) else F.concat(F.lit('"'), _gml_text(F.col(f"`{c}`")), F.lit('"')))).otherwise("") for c in columns]

    ncols = [c for c in nodes.columns if c not in ("node", "label")]
    rows = numbered.select(F.concat(F.lit("  node [ id "), F.col("n").cast("string"), F.lit(' label "'), _gml_text(F.col("label")), F.lit('"'), *cells(ncols), F.lit(" ]")).alias("line"), "n")
    ecols = [c for c in ties.columns if c not in ("src", "dst", "w")]
    lines = _ends(ties, numbered).select(F.concat(F.lit("  edge [ source "), F.col("a").cast("string"), F.lit(" target "), F.col("b").cast("string"), F.lit(" weight "), _shown("w", "double"), *cells(ecols), F.lit(" ]")).alias("line"), "a", F.lpad(F.col("b").cast("string"), 20, "0").alias("tie"))
    return _document((["graph [", f"  directed {int(directed)}"], None), (rows, F.col("n")), (lines, F.col("a")), (["]"], None))


def pajek(nodes: DataFrame, ties: DataFrame, directed: bool = True) -> DataFrame:
    """Vertices from 1; nodes with a mode come mode 0 first, and the first line tells how many those are."""
    numbered = _numbered(nodes)
    modes = "mode" in nodes.columns
    if modes:
        numbered = ranked.numbered(numbered, F.col("mode") * 1e15 + F.col("n"), "m", ("node",)).withColumn("n", F.col("m") - 1).drop("m")
    sizes = numbered.agg(F.count("*").alias("n"), *([F.count_if(F.col("mode") == 0).alias("first")] if modes else [])).collect()[0]
    quoted = F.concat(F.lit('"'), F.replace(F.col("label"), F.lit('"'), F.lit("'")), F.lit('"'))
    rows = numbered.select(F.concat_ws(" ", (F.col("n") + 1).cast("string"), quoted).alias("line"), "n")
    lines = _ends(ties, numbered).select(F.concat_ws(" ", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string"), _shown("w", "double")).alias("line"), "a", F.lpad(F.col("b").cast("string"), 20, "0").alias("tie"))
    head = f"*Vertices {sizes['n']} {sizes['first']}" if modes else f"*Vertices {sizes['n']}"
    return _document(([head], None), (rows, F.col("n")), (["*Arcs" if directed else "*Edges"], None), (lines, F.col("a")))


def dl(nodes: DataFrame, ties: DataFrame, form: str = "edgelist1", directed: bool = True, most_cells: int = 250_000) -> DataFrame:
    """UCINET DL: an edge list, a full matrix, or with modes a rectangular matrix; matrices up to a number of cells."""
    numbered = _numbered(unique_labels(nodes if "label" in nodes.columns else nodes.withColumn("label", F.col("node").cast("string"))))
    label = F.concat(F.lit('"'), F.replace(F.col("label"), F.lit('"'), F.lit("'")), F.lit('"'))
    n = numbered.count()
    if form == "edgelist1":
        both = ties.select("src", "dst", "w") if directed else ties.select("src", "dst", "w").unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        rows = _ends(both, numbered).select(F.concat_ws(" ", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string"), _shown("w", "double")).alias("line"), "a", F.lpad(F.col("b").cast("string"), 20, "0").alias("tie"))
        return _document(([f"dl n={n} format=edgelist1", "labels:"], None), (numbered.select(label.alias("line"), "n"), F.col("n")), (["data:"], None), (rows, F.col("a")))
    two = "mode" in nodes.columns and form != "fullmatrix"
    across, down = (numbered.where("mode = 1"), numbered.where("mode = 0")) if two else (numbered, numbered)
    names = [r["n"] for r in across.orderBy("n").select("n").collect()] if n * n <= 4 * most_cells else None
    if names is None or len(names) * down.count() > most_cells:
        raise ValueError(f"a matrix of more than {most_cells} cells; use the edge list")
    both = _ends(ties, numbered).select("a", "b", "w")
    if not directed or two:
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    wide = down.select(F.col("n").alias("a")).join(both, "a", "left").groupBy("a").pivot("b", names).agg(F.sum("w"))
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).cast("string"), r"\.0$", "") for x in names]
    rows = wide.select(F.concat_ws(" ", *cells).alias("line"), "a")
    head = [f"dl nr={down.count()} nc={len(names)} format=fullmatrix", "row labels:"] if two else [f"dl n={n} format=fullmatrix", "labels:"]
    listed = [(down.select(label.alias("line"), "n"), F.col("n"))] + ([(["column labels:"], None), (across.select(label.alias("line"), "n"), F.col("n"))] if two else [])
    return _document((head, None), *listed, (["data:"], None), (rows, F.col("a")))
