"""Queries over the driver's tables for settings-driven networks, graph measures, series and groups, with the SQL that they equal.

Orders are messages of customers (mode 0) to suppliers (mode 1): the first line's supplier is addressed, the second gets a copy, the third is mentioned, others
get a blind copy; an order answers the one before it by number. Nations are contexts, whose layer is that of their region. Customers in debt are bots.
"""

from __future__ import annotations

import dataclasses
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import model, settings, storage
from kinweave.model import LAYERS, Dataset
from kinweave.operators import centrality, communities, components, construct, content, groups, ties, timewin, twomode, uncertainty
from kinweave.settings import Settings, TieFilter, TwoMode
from kinweave.sinks import networks as files

SPLIT = datetime(1996, 1, 1)
RANGE = (datetime(1994, 1, 1), datetime(1998, 1, 1))


def _read(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def trade(spark: SparkSession, sf_dir: str) -> Dataset:
    customers = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment")
    suppliers = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    person = lambda key, name, bot, mode, segment: [key.alias("node_id"), F.col(name).alias("key"), F.col(name).alias("label"), bot.alias("is_bot"), F.lit(mode).alias("mode"), segment.alias("attrs")]
    fields = lambda c, n, b: F.map_from_arrays(F.array(F.lit("segment"), F.lit("nation"), F.lit("balance")), F.array(c, n.cast("string"), b.cast("string")))
    nodes = customers.select(*person(F.col("c_custkey") * 2, "c_name", F.col("c_acctbal") < 0, 0, fields(F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_acctbal"))))
    nodes = nodes.unionByName(suppliers.select(*person(F.col("s_suppkey") * 2 + 1, "s_name", F.lit(False), 1, fields(F.lit("SUPPLY"), F.col("s_nationkey"), F.col("s_acctbal")))))
    layer = F.element_at(F.array(*[F.lit(v) for v in LAYERS]), F.col("n_regionkey") + 1)
    contexts = _read(spark, sf_dir, "nation", F.col("n_nationkey").alias("context_id"), F.col("n_name").alias("key"), F.lit("channel").alias("kind"), layer.alias("visibility"), F.concat(F.lit("m"), F.col("n_regionkey")).alias("medium"))
    role = F.element_at(F.array(F.lit("to"), F.lit("cc"), F.lit("mention"), F.lit("bcc")), F.least("l_linenumber", F.lit(4)))
    lines = _read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") * 2 + 1).alias("node"), role.alias("role"))
    orders = _read(spark, sf_dir, "orders", F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("t"), "o_custkey", (F.col("o_orderkey") - 1).alias("parent"), (F.col("o_orderkey") % 3).alias("source"), F.create_map(F.lit("status"), F.array("o_orderstatus"), F.lit("price"), F.array(F.col("o_totalprice").cast("string"))).alias("attrs"))
    orders = orders.join(customers.select("c_custkey", F.col("c_nationkey").alias("context")), F.col("o_custkey") == F.col("c_custkey")).withColumn("actor", F.col("o_custkey") * 2).drop("o_custkey", "c_custkey")
    sources = spark.range(3).select(F.col("id").alias("source_id"), F.lit("orders").alias("format"))
    return Dataset.of(nodes, model.with_targets(orders, lines), contexts, sources)


RULES = {"reply": 1.0, "mention": 2.0, "to": 1.0, "cc": 0.5}
TRADE = dataclasses.replace(Settings(directed=True).with_rules(**RULES), start=RANGE[0], end=RANGE[1], visibility=("public", "private", "group", "unknown"), tie_filters=(TieFilter("status", ("F", "O")),), min_weight=0.75, two_mode=None)


def member_ties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Affiliations of customers with suppliers as ties, and the modes of both."""
    lines, orders = _read(spark, sf_dir, "lineitem", "l_orderkey", (F.col("l_suppkey") * 2 + 1).alias("dst")), _read(spark, sf_dir, "orders", "o_orderkey", (F.col("o_custkey") * 2).alias("src"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    people = _read(spark, sf_dir, "customer", (F.col("c_custkey") * 2).alias("node"), F.lit(0).alias("mode"))
    return pairs, people.unionByName(_read(spark, sf_dir, "supplier", (F.col("s_suppkey") * 2 + 1).alias("node"), F.lit(1).alias("mode")))


def key_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn-taking where the number in an event's properties is the context: a sparse network."""
    events = _read(spark, sf_dir, "events", "event_id", F.col("ts").alias("t"), F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").alias("context"), F.lit(False).alias("addressed"))
    return ties.build(ties.adjacency_evidence(events), ties.ADJACENCY_WEIGHT)


def nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.plans.queries import nation_ties

    return storage.materialize(nation_ties(spark, sf_dir).select("src", "dst", "w"), "nations")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation", F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer", F.col("c_nationkey").alias("node"), "c_acctbal").groupBy("node").agg(F.avg("c_acctbal").alias("value"))


def stream(spark: SparkSession, sf_dir: str) -> Dataset:
    """Events of users as untargeted messages, the type is the context, the source is the user's remainder."""
    kinds = _read(spark, sf_dir, "events", F.col("event_type").alias("key")).distinct()
    contexts = kinds.select(F.crc32("key").alias("context_id"), "key", F.lit("channel").alias("kind"), F.lit("public").alias("visibility"))
    events = _read(spark, sf_dir, "events", "event_id", F.col("ts").alias("t"), F.col("user_id").alias("actor"), F.crc32("event_type").alias("context"), (F.col("user_id") % 4).alias("source"))
    nodes = _read(spark, sf_dir, "events", F.col("user_id").alias("node_id")).distinct()
    return Dataset.of(nodes, events, contexts, spark.range(4).select(F.col("id").alias("source_id")))


TURNS = Settings(directed=True).with_rules(adjacency=0.5)


def weekly(spark: SparkSession, sf_dir: str) -> timewin.Series:
    who = _read(spark, sf_dir, "events", F.col("user_id").alias("node"), (F.col("user_id") % 5).cast("string").alias("grp")).distinct()
    return timewin.series(stream(spark, sf_dir), TURNS, "week", groups=who)


def _tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _before_after(s: SparkSession, d: str) -> DataFrame:
    c = timewin.compare(trade(s, d), Settings(directed=True).with_rules(to=True), SPLIT, timedelta(days=365), reps=5)
    return c.paired.select("metric", "n", "before", "after", "diff", "sd", "dz")


def _views(s: SparkSession, d: str) -> DataFrame:
    ds = trade(s, d)
    by = dataclasses.replace(Settings(directed=False).with_rules(to=True), two_mode=TwoMode("mode1", "newman", 2), exclude_bots=False, include_isolates=False)
    return construct.build(ds, by).ties


def _top(t: DataFrame, column: str) -> DataFrame:
    return groups.standouts(t, column, 1)


def _strengths(s: SparkSession, d: str) -> DataFrame:
    from kinweave.operators import measures

    return measures.degrees(key_ties(s, d)).select("node", "strength", "degree")


def queries() -> dict:
    plans = {
        "build_network": lambda s, d: construct.build(trade(s, d), TRADE).ties,
        "drop_counters": lambda s, d: construct.fates(trade(s, d), dataclasses.replace(TRADE, max_recipients=5)),
        "evidence_counts": lambda s, d: settings.evidence_counts(trade(s, d)),
        "network_isolates": lambda s, d: construct.summary(construct.build(trade(s, d), TRADE)).where("part = 'network' OR part LIKE 'ties by%'"),
        "edge_evidence": lambda s, d: construct.edge_evidence(construct.build(trade(s, d), Settings(directed=True, exclude_bots=False).with_rules(to=True, cc=True)), 980, 55).select("event_id", "t", "rule", "amount", "a", "b", "layer"),
        "edge_tie_fields": lambda s, d: construct.edge_tie_fields(construct.build(trade(s, d), Settings(directed=True).with_rules(to=True)), model.tie_field_types(trade(s, d).events)).where("field = 'price'").select("src", "dst", F.col("value").cast("double").alias("price")),
        "two_mode_projection": _views,
        "tie_field_types": lambda s, d: model.tie_field_types(trade(s, d).events),
        "attribute_schema": lambda s, d: model.attribute_schema(trade(s, d).nodes).select("key", "type", "n", "distinct", "coverage"),
        "weak_components": lambda s, d: components.weak(key_ties(s, d)),
        "strong_components": lambda s, d: components.strong(key_ties(s, d)),
        "component_sizes": lambda s, d: components.sizes(components.weak(key_ties(s, d))),
        "betweenness": lambda s, d: centrality.shortest_paths(key_ties(s, d), approx=False).select("node", "betweenness"),
        "closeness": lambda s, d: centrality.closeness(key_ties(s, d)),
        "path_lengths": lambda s, d: centrality.path_lengths(key_ties(s, d)),
        "pagerank": lambda s, d: centrality.pagerank(key_ties(s, d)),
        "eigenvector": lambda s, d: centrality.eigenvector(key_ties(s, d)),
        "core_numbers": lambda s, d: centrality.cores(key_ties(s, d)),
        "ego_measures": lambda s, d: groups.ego_measures(key_ties(s, d)).select("node", "size", "strength", "among", "density"),
        "ego_homophily": lambda s, d: groups.ego_homophily(nation_table(s, d), regions(s, d)),
        "louvain": lambda s, d: communities.louvain(key_ties(s, d)),
        "numeric_assortativity": lambda s, d: groups.numeric_assortativity(nation_table(s, d), balances(s, d)),
        "group_table": lambda s, d: groups.group_table(nation_table(s, d), regions(s, d)),
        "mixing_table": lambda s, d: groups.mixing_table(nation_table(s, d), regions(s, d)),
        "weighted_assortativity": lambda s, d: groups.assortativity(nation_table(s, d), regions(s, d), weighted=True),
        "attribute_histogram": lambda s, d: groups.histogram(_read(s, d, "customer", F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("grp"))),
        "group_means": lambda s, d: groups.group_means(balances(s, d), regions(s, d), "value"),
        "top_share": lambda s, d: groups.top_share(_strengths(s, d), "strength"),
        "percentiles": lambda s, d: groups.percentiles(_strengths(s, d), "strength"),
        "tie_runs": lambda s, d: groups.tie_runs(_strengths(s, d), "strength", 0),
        "standouts": lambda s, d: _top(_strengths(s, d), "strength"),
        "two_mode_degrees": lambda s, d: twomode.degrees(*member_ties(s, d)),
        "two_mode_clustering": lambda s, d: twomode.clustering(*member_ties(s, d)),
        "two_mode_structure": lambda s, d: twomode.summary(*member_ties(s, d)),
        "time_series_windows": lambda s, d: weekly(s, d).windows.select("win", "label", "coverage", "events", "nodes", "ties"),
        "time_series_metrics": lambda s, d: weekly(s, d).network,
        "time_series_nodes": lambda s, d: weekly(s, d).nodes,
        "time_series_activity": lambda s, d: weekly(s, d).activity,
        "detected_shifts": lambda s, d: timewin.detect_shifts(weekly(s, d), stream(s, d)),
        "cusum_shifts": lambda s, d: timewin.detect_shifts(weekly(s, d), stream(s, d), "cusum"),
        "before_after": _before_after,
        "source_shares": lambda s, d: timewin.source_coverage(stream(s, d)),
        "node_sources": lambda s, d: timewin.node_sources(trade(s, d)),
        "departures": lambda s, d: timewin.departures(trade(s, d)),
        "suggested_range": lambda s, d: timewin.suggested_range(_read(s, d, "orders", F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderdate")).otherwise(F.expr("TIMESTAMP_NTZ'1997-06-01 00:00:00'") + F.make_dt_interval(mins=(F.col("o_orderkey") % 10_000).cast("int"))).alias("t"))),
        "null_model": lambda s, d: uncertainty.null_model(nation_table(s, d).where("w > 0").orderBy(F.desc("w"), "src", "dst").limit(150), True, regions(s, d), reps=20, statistics=("reciprocity", "transitivity", "ei")),
        "resample_ranks": lambda s, d: uncertainty.resample_ranks(stream(s, d), TURNS, "strength", reps=5),
        "krippendorff_alpha": lambda s, d: content.krippendorff(_codes(s, d)),
        "code_agreement": lambda s, d: content.agreement_by_code(_codes(s, d), "quality", "toxic"),
        "corpus_terms": lambda s, d: content.overall_terms(_posts(s, d).select("event_id", F.expr("regexp_extract_all(lower(text), r'[a-z]{3,}', 0)").alias("tokens"))),
        "first_uses": lambda s, d: content.first_uses(_posts(s, d).select("actor", "t", F.expr("regexp_extract_all(lower(text), r'[a-z]{5,}', 0)").alias("tokens"))),
        "edge_list_sums": lambda s, d: construct.from_edges(_read(s, d, "events", F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.col("value").alias("w"))),
        "csv_edges": lambda s, d: files.csv_edges(nation_table(s, d)).select("line"),
        "pajek_file": lambda s, d: files.pajek(regions(s, d).select("node", F.col("node").cast("string").alias("label")), nation_table(s, d)).select("line"),
    }
    return {name: (lambda s, d, f=f: _tidy(f(s, d))) for name, f in plans.items()}


def _codes(s: SparkSession, d: str) -> DataFrame:
    labels = _read(s, d, "labels", F.col("doc_id").alias("item"), "quality", "toxic")
    return labels.select("item", F.expr("stack(2, 'quality', cast(quality AS string), 'toxic', cast(toxic AS string)) AS (coder, code)")).where("code IS NOT NULL")


def _posts(s: SparkSession, d: str) -> DataFrame:
    """Documents as dated messages of ten people."""
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    return _read(s, d, "documents", F.col("doc_id").alias("event_id"), (F.col("doc_id") % 10).alias("actor"), (start + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("t"), "text")


_T = """p AS (SELECT c_custkey * 2 AS id, c_acctbal < 0 AS bot FROM customer),
ev AS (SELECT o_orderkey AS id, o_orderdate AS t, o_custkey * 2 AS actor, o_orderkey - 1 AS parent, o_orderstatus AS status, n_regionkey AS region, bot
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN p ON p.id = o_custkey * 2),
tg AS (SELECT DISTINCT l_orderkey AS id, l_suppkey * 2 + 1 AS b, CASE l_linenumber WHEN 1 THEN 'to' WHEN 2 THEN 'cc' WHEN 3 THEN 'mention' ELSE 'bcc' END AS rule FROM lineitem),
crowd AS (SELECT id FROM tg GROUP BY id HAVING count(DISTINCT b) > 25)"""
_USED = "used AS (SELECT * FROM ev WHERE t >= TIMESTAMP '1994-01-01' AND t < TIMESTAMP '1998-01-01' AND NOT bot AND region <> 2 AND status IN ('F', 'O'))"
_FOUND = """f AS (SELECT used.id, actor AS a, b, rule, region FROM used JOIN tg ON tg.id = used.id WHERE rule <> 'bcc' AND used.id NOT IN (SELECT id FROM crowd)
  UNION ALL SELECT used.id, used.actor, e2.actor, 'reply', used.region FROM used JOIN ev e2 ON e2.id = used.parent WHERE e2.actor <> used.actor AND NOT e2.bot),
n AS (SELECT a AS src, b AS dst, sum(CASE rule WHEN 'mention' THEN 2.0::DOUBLE WHEN 'cc' THEN 0.5 ELSE 1 END) AS raw, count(*) FILTER (rule = 'reply')::DOUBLE AS evidence_reply, count(*) FILTER (rule = 'mention')::DOUBLE AS evidence_mention,
  count(*) FILTER (rule = 'to')::DOUBLE AS evidence_to, count(*) FILTER (rule = 'cc')::DOUBLE AS evidence_cc, bit_or(1 << region)::INT AS layer_mask FROM f GROUP BY 1, 2 HAVING raw >= 0.75)"""
_K = """o AS (SELECT ts, user_id AS src, lag(user_id) OVER w AS dst, lag(ts) OVER w AS before FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL
  WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)), t AS (SELECT src, dst, 0.5::DOUBLE * count(*) AS w FROM o WHERE src <> dst AND ts - before <= INTERVAL 10 MINUTE GROUP BY 1, 2),
v AS (SELECT src AS node FROM t UNION SELECT dst FROM t)"""
_KU = "u AS (SELECT src AS x, dst AS y FROM t UNION SELECT dst, src FROM t)"
_KD = """d AS (SELECT node AS s, node AS v, 0 AS k FROM v UNION SELECT d.s, t.dst, d.k + 1 FROM d JOIN t ON t.src = d.v WHERE d.k < 40), dd AS (SELECT s, v, min(k) AS k FROM d GROUP BY 1, 2)"""
_KS = f"WITH RECURSIVE {_K}, {_KU}, r AS (SELECT node, node AS o FROM v UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.o), c AS (SELECT node, min(o) AS component FROM r GROUP BY 1)"
_N = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
g AS (SELECT n_nationkey AS node, n_regionkey AS grp FROM nation), z AS (SELECT grp, count(*) AS n FROM g GROUP BY 1),
m AS (SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS ties, sum(w) AS weight FROM t JOIN g a ON src = a.node JOIN g b ON dst = b.node GROUP BY 1, 2)"""
_M = """t AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
md AS (SELECT c_custkey * 2 AS node, 0 AS mode FROM customer UNION ALL SELECT s_suppkey * 2 + 1, 1 FROM supplier),
e AS (SELECT src AS x, dst AS y FROM t UNION ALL SELECT dst, src FROM t), k AS (SELECT x AS node, count(*) AS k FROM e GROUP BY 1),
sh AS (SELECT a.x AS x, b.x AS y, count(*) AS n FROM e a JOIN e b ON a.y = b.y AND a.x <> b.x GROUP BY 1, 2),
la AS (SELECT sh.x AS node, avg(n / (kx.k + ky.k - n)::DOUBLE) AS clustering FROM sh JOIN k kx ON kx.node = sh.x JOIN k ky ON ky.node = sh.y GROUP BY 1)"""
_W = """b AS (SELECT date_trunc('week', min(ts)) AS a, min(ts) AS lo, max(ts) AS hi FROM events), ew AS (SELECT *, (date_diff('day', a::DATE, ts::DATE) // 7)::INT AS win FROM events, b),
o AS (SELECT win, ts, user_id AS src, lag(user_id) OVER w AS dst, lag(ts) OVER w AS before FROM ew WINDOW w AS (PARTITION BY win, event_type ORDER BY ts, event_id)),
t AS (SELECT win, src, dst, 0.5::DOUBLE * count(*) AS w FROM o WHERE src <> dst AND ts - before <= INTERVAL 10 MINUTE GROUP BY 1, 2, 3),
sp AS (SELECT unnest(range(0, (date_diff('day', a::DATE, hi::DATE) // 7) + 1))::INT AS win FROM b),
nd AS (SELECT win, node, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(1 - i)::BIGINT AS out_degree, sum(w) AS strength FROM (SELECT win, src AS node, 0 AS i, w FROM t UNION ALL SELECT win, dst, 1, w FROM t) GROUP BY 1, 2),
wn AS (SELECT sp.win, coalesce(ev, 0) AS events, coalesce(nn, 0) AS nodes, coalesce(tt, 0) AS ties FROM sp LEFT JOIN (SELECT win, count(*) AS ev FROM ew GROUP BY 1) x ON x.win = sp.win
  LEFT JOIN (SELECT win, count(*) AS nn FROM nd GROUP BY 1) y ON y.win = sp.win LEFT JOIN (SELECT win, count(*) AS tt FROM t GROUP BY 1) q ON q.win = sp.win)"""
_CODES = "c AS (SELECT doc_id AS item, 'quality' AS coder, quality::VARCHAR AS code FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels WHERE toxic IS NOT NULL)"
_KSTR = "st AS (SELECT node, sum(w) AS strength FROM (SELECT src AS node, w FROM t UNION ALL SELECT dst, w FROM t) GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "build_network": f"WITH {_T}, {_USED}, {_FOUND} SELECT src, dst, raw AS w, raw, evidence_reply, evidence_mention, evidence_to, evidence_cc, layer_mask FROM n",
        "drop_counters": f"""WITH {_T}, x AS (SELECT id, CASE WHEN t < TIMESTAMP '1994-01-01' OR t >= TIMESTAMP '1998-01-01' THEN 'time' WHEN bot THEN 'bots' WHEN region = 2 THEN 'visibility' WHEN status NOT IN ('F', 'O') THEN 'tie_field' ELSE 'used' END AS fate FROM ev)
            SELECT fate, count(*) AS events FROM x GROUP BY 1 UNION ALL SELECT 'broadcast', count(*) FROM x WHERE fate = 'used' AND id IN (SELECT id FROM tg GROUP BY id HAVING count(DISTINCT b) > 5) HAVING count(*) > 0""",
        "evidence_counts": f"""WITH {_T}, l AS (SELECT CASE l_linenumber WHEN 1 THEN 'to' WHEN 2 THEN 'cc' WHEN 3 THEN 'mention' ELSE 'bcc' END AS rule FROM lineitem)
            SELECT (SELECT count(*) FROM ev a JOIN ev b ON b.id = a.parent WHERE a.actor <> b.actor) AS reply, count(*) FILTER (rule = 'mention') AS mention, 0::BIGINT AS dm, count(*) FILTER (rule = 'to') AS "to", count(*) FILTER (rule = 'cc') AS cc, count(*) FILTER (rule = 'bcc') AS bcc,
              0::BIGINT AS adjacency, 0::BIGINT AS copresence, 0::BIGINT AS declared, 0::BIGINT AS repost, 0::BIGINT AS "like", 0::BIGINT AS follow, 0::BIGINT AS reaction, 0::BIGINT AS undirected FROM l""",
        "network_isolates": f"""WITH {_T}, {_USED}, {_FOUND}, en AS (SELECT src AS x FROM n UNION SELECT dst FROM n), al AS (SELECT id FROM p WHERE NOT bot UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier),
            i AS (SELECT (SELECT count(*) FROM al WHERE id NOT IN (SELECT x FROM en)) AS iso, (SELECT count(*) FROM (SELECT x FROM en UNION SELECT id FROM al)) AS al)
            SELECT 'network' AS part, 'edges' AS name, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'network', 'nodes', al FROM i UNION ALL SELECT 'network', 'isolates', iso FROM i
            UNION ALL SELECT 'ties by rule', unnest(['reply', 'mention', 'to', 'cc']), unnest([count(*) FILTER (evidence_reply > 0), count(*) FILTER (evidence_mention > 0), count(*) FILTER (evidence_to > 0), count(*) FILTER (evidence_cc > 0)])::DOUBLE FROM n
            UNION ALL SELECT 'ties by layer', unnest(['public', 'private', 'group', 'unknown']), unnest([count(*) FILTER (layer_mask & 1 > 0), count(*) FILTER (layer_mask & 2 > 0), count(*) FILTER (layer_mask & 8 > 0), count(*) FILTER (layer_mask & 16 > 0)])::DOUBLE FROM n""",
        "edge_evidence": f"""WITH {_T} SELECT ev.id AS event_id, t, rule, 1.0::DOUBLE AS amount, actor AS a, b, ['public', 'private', 'direct', 'group', 'unknown'][region + 1] AS layer FROM ev JOIN tg ON tg.id = ev.id
            WHERE rule IN ('to', 'cc') AND actor = 980 AND b = 55 AND ev.id NOT IN (SELECT id FROM crowd) ORDER BY t, ev.id, rule LIMIT 50""",
        "edge_tie_fields": "SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, round(avg(o_totalprice), 6) AS price FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1, 2",
        "two_mode_projection": """WITH a AS (SELECT DISTINCT o_custkey AS p, l_suppkey * 2 + 1 AS s, n_regionkey AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_linenumber = 1),
            z AS (SELECT p, count(*) AS size FROM a GROUP BY 1), q AS (SELECT x.s AS src, y.s AS dst, count(*)::DOUBLE AS shared, sum(1.0::DOUBLE / (size - 1)) AS raw, bit_or(1 << x.region)::INT AS layer_mask FROM a x JOIN a y ON x.p = y.p AND x.s < y.s JOIN z ON z.p = x.p GROUP BY 1, 2 HAVING count(*) >= 2)
            SELECT src, dst, round(raw, 6) AS w, round(raw, 6) AS raw, layer_mask, shared FROM q""",
        "tie_field_types": "SELECT 'status' AS key, 'categorical' AS type, count(*) AS n, count(DISTINCT o_orderstatus) AS \"distinct\" FROM orders UNION ALL SELECT 'price', 'numeric', count(*), count(DISTINCT o_totalprice) FROM orders",
        "attribute_schema": """WITH a AS (SELECT c_mktsegment AS s, c_nationkey AS n, c_acctbal AS b FROM customer UNION ALL SELECT 'SUPPLY', s_nationkey, s_acctbal FROM supplier)
            SELECT 'segment' AS key, 'categorical' AS type, count(*) AS n, count(DISTINCT s) AS "distinct", 1.0::DOUBLE AS coverage FROM a UNION ALL SELECT 'nation', 'numeric', count(*), count(DISTINCT n), 1.0 FROM a UNION ALL SELECT 'balance', 'numeric', count(*), count(DISTINCT b), 1.0 FROM a""",
        "weak_components": f"{_KS} SELECT node, component FROM c",
        "component_sizes": f"{_KS}, z AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS components, sum(n)::BIGINT AS nodes, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share FROM z",
        "strong_components": f"WITH RECURSIVE {_K}, r AS (SELECT node, node AS o FROM v UNION SELECT r.node, t.dst FROM r JOIN t ON t.src = r.o) SELECT a.node, min(a.o) AS component FROM r a JOIN r b ON a.node = b.o AND a.o = b.node GROUP BY 1",
        "closeness": f"WITH RECURSIVE {_K}, {_KD}, s AS (SELECT v, sum(1.0::DOUBLE / k) AS x FROM dd WHERE k > 0 GROUP BY 1) SELECT node, round(coalesce(x, 0) / ((SELECT count(*) FROM v) - 1), 6) AS closeness FROM v LEFT JOIN s ON s.v = node",
        "path_lengths": f"WITH RECURSIVE {_K}, {_KD} SELECT round(avg(k) FILTER (k > 0), 6) AS mean_path, max(k)::BIGINT AS diameter, false AS sampled FROM dd",
        "betweenness": f"""WITH RECURSIVE {_K}, {_KD}, p AS (SELECT node AS s, node AS v, 0 AS k FROM v UNION ALL SELECT p.s, t.dst, p.k + 1 FROM p JOIN t ON t.src = p.v JOIN dd ON dd.s = p.s AND dd.v = t.dst AND dd.k = p.k + 1),
            c AS (SELECT s, v, any_value(k) AS k, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), b AS (SELECT x.v AS node, sum(x.n * y.n / z.n) AS raw FROM c x JOIN c y ON y.s = x.v JOIN c z ON z.s = x.s AND z.v = y.v AND z.k = x.k + y.k WHERE x.s <> x.v AND y.v <> x.v GROUP BY 1)
            SELECT v.node, round(coalesce(raw, 0) / (((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2)), 6) AS betweenness FROM v LEFT JOIN b ON b.node = v.node""",
        "ego_measures": f"""WITH {_K}, {_KU}, s AS (SELECT x AS node, count(*) AS size FROM u GROUP BY 1), g AS (SELECT node, sum(w) AS strength FROM (SELECT src AS node, w FROM t UNION ALL SELECT dst, w FROM t) GROUP BY 1),
            a AS (SELECT p.x AS node, count(*) AS among FROM u p JOIN u q ON q.x = p.x JOIN t ON t.src = p.y AND t.dst = q.y GROUP BY 1)
            SELECT s.node, size, strength, coalesce(among, 0) AS among, CASE WHEN size > 1 THEN round(coalesce(among, 0) / (size * (size - 1))::DOUBLE, 6) END AS density FROM s JOIN g ON g.node = s.node LEFT JOIN a ON a.node = s.node""",
        "ego_homophily": f"""WITH {_N}, u AS (SELECT x, y, sum(w) AS w FROM (SELECT src AS x, dst AS y, w FROM t UNION ALL SELECT dst, src, w FROM t) GROUP BY 1, 2),
            c AS (SELECT x AS node, o.grp AS own, b.grp AS value, count(*) AS n, sum(w) AS w FROM u JOIN g o ON o.node = x JOIN g b ON b.node = y GROUP BY 1, 2, 3),
            q AS (SELECT node, sum(n)::BIGINT AS known, 1 - sum(n * n) / (sum(n) * sum(n))::DOUBLE AS blau, coalesce(sum(n) FILTER (own = value), 0) AS same, coalesce(sum(w) FILTER (own = value), 0) AS sw, sum(w) AS tw FROM c GROUP BY 1)
            SELECT node, known, round(blau, 6) AS diversity, round(blau / (1 - 1 / (SELECT count(DISTINCT grp) FROM g)::DOUBLE), 6) AS diversity_normalized, round(same / known::DOUBLE, 6) AS homophily, round(sw / tw, 6) AS homophily_weighted, round((known - 2 * same) / known::DOUBLE, 6) AS ei FROM q""",
        "numeric_assortativity": f"WITH {_N}, b AS (SELECT c_nationkey AS node, avg(c_acctbal) AS x FROM customer GROUP BY 1) SELECT round(corr(p.x, q.x), 6) AS assortativity FROM t JOIN b p ON p.node = src JOIN b q ON q.node = dst",
        "mixing_table": f"WITH {_N} SELECT from_group, to_group, ties, weight, round(ties / (CASE WHEN from_group = to_group THEN a.n * (a.n - 1) ELSE a.n * b.n END)::DOUBLE, 6) AS density FROM m JOIN z a ON a.grp = from_group JOIN z b ON b.grp = to_group",
        "group_table": f"""WITH {_N}, s AS (SELECT z.grp, any_value(z.n) AS size, coalesce(sum(ties) FILTER (from_group = to_group), 0)::BIGINT AS internal, coalesce(sum(ties) FILTER (from_group <> to_group), 0)::BIGINT AS external,
              coalesce(sum(weight) FILTER (from_group = to_group), 0) AS internal_weight, coalesce(sum(weight) FILTER (from_group <> to_group), 0) AS external_weight FROM z LEFT JOIN m ON z.grp IN (from_group, to_group) GROUP BY 1)
            SELECT *, CASE WHEN size > 1 THEN round(internal / (size * (size - 1))::DOUBLE, 6) END AS density, round(external / (2 * size * ((SELECT sum(n) FROM z) - size))::DOUBLE, 6) AS external_density,
              CASE WHEN internal + external > 0 THEN round((external - internal) / (external + internal)::DOUBLE, 6) END AS ei FROM s""",
        "weighted_assortativity": f"""WITH {_N}, w AS (SELECT sum(weight) AS s FROM m), a AS (SELECT from_group AS grp, sum(weight) AS x FROM m GROUP BY 1), b AS (SELECT to_group AS grp, sum(weight) AS y FROM m GROUP BY 1),
            e AS (SELECT sum(x * y) / ((SELECT s FROM w) * (SELECT s FROM w)) AS ex FROM a JOIN b USING (grp)), r AS (SELECT sum(weight) / (SELECT s FROM w) AS tr FROM m WHERE from_group = to_group) SELECT round((tr - ex) / (1 - ex), 6) AS assortativity FROM e, r""",
        "attribute_histogram": "SELECT c_mktsegment AS grp, count(*) AS size FROM customer GROUP BY 1",
        "group_means": f"WITH {_N}, b AS (SELECT c_nationkey AS node, avg(c_acctbal) AS x FROM customer GROUP BY 1) SELECT grp, count(*) AS members, count(x) AS known, round(avg(x), 6) AS mean FROM g LEFT JOIN b ON b.node = g.node GROUP BY 1",
        "top_share": f"WITH {_K}, {_KSTR} SELECT round((SELECT sum(strength) FROM (SELECT strength FROM st ORDER BY strength DESC LIMIT 10)) / sum(strength), 6) AS share FROM st",
        "percentiles": f"WITH {_K}, {_KSTR} SELECT node, strength AS value, round(cume_dist() OVER (ORDER BY strength), 6) AS percentile FROM st",
        "tie_runs": f"WITH {_K}, {_KSTR} SELECT round(strength, 0) AS shown, count(*) AS members FROM st GROUP BY 1 HAVING count(*) > 1",
        "standouts": f"WITH {_K}, {_KSTR}, r AS (SELECT DISTINCT round(strength, 1) AS x FROM st ORDER BY 1 DESC LIMIT 2) SELECT node, round(strength, 1) AS shown, (SELECT min(x) FROM r) AS next FROM st WHERE round(strength, 1) = (SELECT max(x) FROM r)",
        "two_mode_degrees": f"WITH {_M} SELECT md.node, round(coalesce(k, 0) / (SELECT count(*) FROM md o WHERE o.mode <> md.mode)::DOUBLE, 6) AS degree FROM md LEFT JOIN k ON k.node = md.node",
        "two_mode_clustering": f"WITH {_M} SELECT md.node, round(coalesce(clustering, 0), 6) AS clustering FROM md LEFT JOIN la ON la.node = md.node",
        "two_mode_structure": f"""WITH {_M}, c AS (SELECT md.mode, coalesce(clustering, 0) AS c FROM md LEFT JOIN la ON la.node = md.node), s AS (SELECT count(*) FILTER (mode = 0) AS a, count(*) FILTER (mode = 1) AS b, avg(c) AS mc, avg(c) FILTER (mode = 0) AS m0, avg(c) FILTER (mode = 1) AS m1 FROM c),
            l AS (SELECT count(*) AS ties, sum((ka.k - 1) * (kb.k - 1))::BIGINT AS three FROM t JOIN k ka ON ka.node = src JOIN k kb ON kb.node = dst), q AS (SELECT (sum(n * (n - 1) / 2) // 2)::BIGINT AS four FROM sh JOIN md ON md.node = sh.x WHERE mode = 0)
            SELECT a AS nodes_0, b AS nodes_1, ties, round(ties / (a * b)::DOUBLE, 6) AS density, four AS four_cycles, three AS three_paths, round(4 * four / three::DOUBLE, 6) AS robins_alexander, round(mc, 6) AS mean_clustering, round(m0, 6) AS mean_clustering_0, round(m1, 6) AS mean_clustering_1 FROM s, l, q""",
        "time_series_windows": f"""WITH {_W} SELECT win, 'w/c ' || strftime(a + to_days((win * 7)::INT), '%Y-%m-%d') AS label,
            round((epoch_us(least(a + to_days(((win + 1) * 7)::INT), hi + INTERVAL 1 MICROSECOND)) - epoch_us(greatest(a + to_days((win * 7)::INT), lo))) / (7 * 86400 * 1000000::DOUBLE), 6) AS coverage, events, nodes, ties FROM wn, b""",
        "time_series_nodes": f"WITH {_W} SELECT win, node, degree, in_degree, out_degree, strength FROM nd",
        "time_series_activity": f"WITH {_W} SELECT win, user_id AS node, count(*) AS events FROM ew GROUP BY 1, 2",
        "time_series_metrics": f"""WITH {_W}, u AS (SELECT DISTINCT win, least(src, dst) AS x, greatest(src, dst) AS y FROM t), pr AS (SELECT win, x AS a, y AS b FROM u UNION ALL SELECT win, y, x FROM u), dg AS (SELECT win, a, count(*) AS d FROM pr GROUP BY 1, 2),
            tr AS (SELECT p.win, count(*) / 2 AS n FROM pr p JOIN pr q ON q.win = p.win AND q.a = p.a AND p.b < q.b JOIN u ON u.win = p.win AND u.x = p.b AND u.y = q.b GROUP BY 1), tp AS (SELECT win, sum(d * (d - 1) / 2.0::DOUBLE) AS n FROM dg GROUP BY 1),
            cl AS (SELECT p.win, count(*)::DOUBLE AS n FROM pr p JOIN pr q ON q.win = p.win AND q.a = p.a AND p.b < q.b JOIN u ON u.win = p.win AND u.x = p.b AND u.y = q.b GROUP BY 1)
            SELECT win, 'nodes' AS metric, nodes::DOUBLE AS value FROM wn WHERE nodes > 0 UNION ALL SELECT win, 'ties', ties FROM wn WHERE nodes > 0 UNION ALL SELECT win, 'density', round(CASE WHEN nodes > 1 THEN ties / (nodes * (nodes - 1))::DOUBLE ELSE 0 END, 6) FROM wn WHERE nodes > 0
            UNION ALL SELECT win, 'mean_degree', round(ties / nodes::DOUBLE, 6) FROM wn WHERE nodes > 0
            UNION ALL SELECT a.win, 'reciprocity', round(count(b.src) / count(*)::DOUBLE, 6) FROM t a LEFT JOIN t b ON b.win = a.win AND b.src = a.dst AND b.dst = a.src GROUP BY 1
            UNION ALL SELECT tp.win, 'transitivity', round(CASE WHEN tp.n > 0 THEN coalesce(cl.n, 0) / tp.n ELSE 0 END, 6) FROM tp LEFT JOIN cl ON cl.win = tp.win
            UNION ALL SELECT win, 'activity', events::DOUBLE FROM wn UNION ALL SELECT win, 'cross_share', round(count(*) FILTER (src % 5 <> dst % 5) / count(*)::DOUBLE, 6) FROM t GROUP BY 1 UNION ALL SELECT win, 'coded_ties', count(*)::DOUBLE FROM t GROUP BY 1""",
        "before_after": f"""WITH {_T}, e AS (SELECT DISTINCT ev.id, actor AS src, b AS dst, (t >= TIMESTAMP '1996-01-01')::INT AS p FROM ev JOIN tg ON tg.id = ev.id WHERE rule = 'to' AND NOT bot AND t >= TIMESTAMP '1995-01-01' AND t < TIMESTAMP '1996-12-31'),
            w AS (SELECT p, src, dst, count(*)::DOUBLE AS w FROM e GROUP BY 1, 2, 3), x AS (SELECT p, src AS node, 0 AS i, w FROM w UNION ALL SELECT p, dst, 1, w FROM w),
            n AS (SELECT node, count(*) FILTER (p = 0)::DOUBLE AS d0, count(*) FILTER (p = 1)::DOUBLE AS d1, count(*) FILTER (p = 0 AND i = 1)::DOUBLE AS i0, count(*) FILTER (p = 1 AND i = 1)::DOUBLE AS i1,
              count(*) FILTER (p = 0 AND i = 0)::DOUBLE AS o0, count(*) FILTER (p = 1 AND i = 0)::DOUBLE AS o1, coalesce(sum(w) FILTER (p = 0), 0) AS s0, coalesce(sum(w) FILTER (p = 1), 0) AS s1 FROM x GROUP BY 1),
            l AS (SELECT node, unnest(['degree', 'in_degree', 'out_degree', 'strength']) AS metric, unnest([d0, i0, o0, s0]) AS b, unnest([d1, i1, o1, s1]) AS a FROM n)
            SELECT metric, count(*) AS n, round(avg(b), 6) AS before, round(avg(a), 6) AS after, round(avg(a - b), 6) AS diff, round(stddev_samp(a - b), 6) AS sd, round(avg(a - b) / stddev_samp(a - b), 6) AS dz FROM l GROUP BY 1""",
        "source_shares": "SELECT user_id % 4 AS source, min(ts) AS start, max(ts) AS \"end\", count(*) AS events, count(*) AS in_range, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, count(*) / sum(count(*)) OVER ()::DOUBLE >= 0.05 AS material FROM events GROUP BY 1",
        "node_sources": """WITH x AS (SELECT o_custkey * 2 AS node, o_orderkey % 3 AS source FROM orders UNION ALL SELECT l_suppkey * 2 + 1, l_orderkey % 3 FROM lineitem), c AS (SELECT node, source, count(*) AS n FROM x GROUP BY 1, 2),
            s AS (SELECT node, source, n / sum(n) OVER (PARTITION BY node)::DOUBLE AS share FROM c) SELECT node, source, round(share, 6) AS share FROM s WHERE share >= 0.25""",
        "departures": """WITH b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders), u AS (SELECT o_custkey * 2 AS node, count(*) AS events, max(o_orderdate) AS last FROM orders GROUP BY 1),
            s AS (SELECT *, date_sub('second', last, hi) / 86400.0::DOUBLE AS silent, date_sub('second', lo, hi) / 86400.0::DOUBLE AS span FROM u, b)
            SELECT node, events, last, round(silent, 6) AS silent_days FROM s WHERE span >= 28 AND events >= 5 AND silent >= greatest(14, 0.15::DOUBLE * span)""",
        "suggested_range": """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate ELSE TIMESTAMP '1997-06-01' + to_minutes((o_orderkey % 10000)::INT) END AS t FROM orders), n AS (SELECT count(*) AS n, ceil(0.95::DOUBLE * count(*))::BIGINT AS k, min(t) AS lo, max(t) AS hi FROM t),
            r AS (SELECT t, row_number() OVER (ORDER BY t, id) AS i FROM t), p AS (SELECT a.t AS lo, b.t AS hi FROM r a, n JOIN r b ON b.i = a.i + k - 1), m AS (SELECT lo, hi FROM p ORDER BY hi - lo, lo LIMIT 1),
            e AS (SELECT date_trunc('day', m.lo)::TIMESTAMP AS s, date_trunc('day', m.hi)::TIMESTAMP + INTERVAL 1 DAY AS f FROM m, n WHERE epoch_us(m.hi) - epoch_us(m.lo) <= 0.5::DOUBLE * (epoch_us(n.hi) - epoch_us(n.lo)) AND n.n >= 20)
            SELECT s AS start, f AS "end", round((SELECT count(*) FROM t WHERE t >= s AND t < f) / (SELECT n FROM n)::DOUBLE, 6) AS share FROM e""",
        "krippendorff_alpha": f"""WITH {_CODES}, i AS (SELECT item, count(*) AS m FROM c GROUP BY 1 HAVING count(*) > 1), n AS (SELECT c.item, m, code, count(*) AS n FROM c JOIN i ON i.item = c.item GROUP BY 1, 2, 3), s AS (SELECT sum(n * (n - 1) / (m - 1)::DOUBLE) AS same FROM n),
            t AS (SELECT sum(n)::DOUBLE AS al, sum(n * (n - 1))::DOUBLE AS ch FROM (SELECT code, sum(n) AS n FROM n GROUP BY 1)) SELECT (SELECT count(*) FROM i) AS items, round(1 - (1 - same / al) / (1 - ch / (al * (al - 1))), 6) AS alpha FROM s, t""",
        "code_agreement": f"WITH {_CODES}, k AS (SELECT code, item, count(DISTINCT coder) AS n FROM c GROUP BY 1, 2) SELECT code, count(*) FILTER (n = 2) AS both, count(*) AS either, round(count(*) FILTER (n = 2) / count(*)::DOUBLE, 6) AS agreement FROM k GROUP BY 1",
        "corpus_terms": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents WHERE text IS NOT NULL) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS messages FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 30",
        "first_uses": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents WHERE text IS NOT NULL) SELECT term, doc_id % 10 AS node, TIMESTAMP '2024-01-01' + to_hours(min(doc_id)::INT) AS t FROM w GROUP BY 1, 2",
        "edge_list_sums": "SELECT least(user_id, event_id % 50) AS src, greatest(user_id, event_id % 50) AS dst, round(sum(coalesce(value, 1)), 6) AS w FROM events WHERE user_id <> event_id % 50 GROUP BY 1, 2",
        "csv_edges": f"WITH {_N} SELECT 'Source,Target,Type,Weight' AS line UNION ALL SELECT src || ',' || dst || ',Directed,' || regexp_replace(w::VARCHAR, '\\.0$', '') FROM t",
        "pajek_file": f"WITH {_N} SELECT '*Vertices 25' AS line UNION ALL SELECT (node + 1) || ' \"' || node || '\"' FROM g UNION ALL SELECT '*Arcs' UNION ALL SELECT (src + 1) || ' ' || (dst + 1) || ' ' || regexp_replace(w::VARCHAR, '\\.0$', '') FROM t",
    }

