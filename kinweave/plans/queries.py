"""Queries that bind the driver's tables to the operators, each with the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import content, measures, series, structure, ties
from kinweave.plans import networks


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def turn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as unaddressed messages; the event type is the context."""
    events = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return ties.adjacency_evidence(events.select("event_id", F.col("ts").alias("t"), F.col("user_id").alias("actor"), F.col("event_type").alias("context"), F.lit(False).alias("addressed")))


def turn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ties.build(turn_evidence(spark, sf_dir), ties.ADJACENCY_WEIGHT)


def nation_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as declared ties from the customer's nation to the supplier's, weighted by quantity."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = _read(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = _read(spark, sf_dir, "supplier", "s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return ties.build(joined.select("src", "dst", F.col("l_quantity").alias("amount")))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation", F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("person"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of customers: the first line's supplier is addressed, the others get a copy."""
    orders = _read(spark, sf_dir, "orders", F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("t"), F.concat(F.lit("c"), F.col("o_custkey")).alias("actor"), F.lit(None).cast("bigint").alias("parent"))
    role = F.when(F.col("l_linenumber") == 1, "to").otherwise("cc")
    lines = _read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("event_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("person"), role.alias("role"))
    return ties.addressed_evidence(orders, lines).groupBy("src", "dst", "rule").agg(F.count("*").alias("n"))


def reply_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages whose parent is the turn before, between roles."""
    key = lambda turn: F.concat_ws(":", "conv_id", turn)
    turns = _read(spark, sf_dir, "conversations", key(F.col("turn")).alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("t"), F.col("role").alias("actor"), key(F.col("turn") - 1).alias("parent"))
    none = turns.select("event_id", F.col("actor").alias("person"), F.lit("reply").alias("role")).where("false")
    return ties.build(ties.addressed_evidence(turns, none))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", F.col("event_type").alias("series"), F.col("ts").alias("t"), F.col("user_id").alias("actor"))


def _affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_suppkey").alias("event")), _read(spark, sf_dir, "orders", "o_orderkey", F.col("o_custkey").alias("person"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("person", "event")


def _strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.degrees(turn_ties(spark, sf_dir)).select("node", "strength")


def foreign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "source", content.likely_non_english(F.col("text")).cast("bigint").alias("hit"))
    return docs.groupBy("source").agg(F.count("*").alias("texts"), F.sum("hit").alias("foreign_texts"))


def queries() -> dict:
    plans = {
        "ties_adjacency": turn_ties,
        "ties_copresence": lambda s, d: ties.build(ties.copresence_evidence(_presence(s, d))),
        "ties_declared": nation_ties,
        "ties_projection": lambda s, d: ties.project(_presence(s, d), 2),
        "node_degrees": lambda s, d: measures.degrees(turn_ties(s, d)),
        "node_reciprocity": lambda s, d: measures.reciprocity(turn_ties(s, d)),
        "network_summary": lambda s, d: measures.summary(turn_ties(s, d)),
        "strength_gini": lambda s, d: measures.gini(measures.degrees(turn_ties(s, d)), "strength"),
        "node_clustering": lambda s, d: measures.clustering(turn_ties(s, d)),
        "transitivity": lambda s, d: measures.transitivity(turn_ties(s, d)),
        "group_mixing": lambda s, d: measures.mixing(nation_ties(s, d), _regions(s, d)),
        "ei_index": lambda s, d: measures.ei_index(nation_ties(s, d), _regions(s, d)),
        "top_strength": lambda s, d: measures.top_nodes(measures.degrees(turn_ties(s, d)).select("node", "strength"), "strength"),
        "tie_turnover": lambda s, d: networks.weekly(s, d).turnover,
        "degree_centralization": lambda s, d: structure.centralization(turn_ties(s, d)),
        "degree_assortativity": lambda s, d: structure.degree_assortativity(turn_ties(s, d)),
        "group_ties": lambda s, d: structure.group_ties(nation_ties(s, d), _regions(s, d)),
        "group_assortativity": lambda s, d: structure.group_assortativity(nation_ties(s, d), _regions(s, d)),
        "modularity": lambda s, d: structure.modularity(nation_ties(s, d), _regions(s, d)),
        "node_brokerage": lambda s, d: structure.brokerage(nation_ties(s, d)),
        "strength_ranks": lambda s, d: structure.ranks(_strengths(s, d), "strength"),
        "strength_quantiles": lambda s, d: structure.quantiles(_strengths(s, d), "strength"),
        "two_mode_summary": lambda s, d: structure.two_mode_summary(_affiliations(s, d)),
        "coder_agreement": lambda s, d: structure.coder_agreement(_read(s, d, "labels", "quality", "toxic"), "quality", "toxic"),
        "ties_addressed": order_messages,
        "ties_reply": reply_ties,
        "ties_log": lambda s, d: ties.weighted(ties.build(turn_evidence(s, d), ties.ADJACENCY_WEIGHT, 1.0), "log"),
        "activity_by_day": lambda s, d: series.activity(_streams(s, d)),
        "activity_shifts": lambda s, d: series.shifts(series.activity(_streams(s, d))),
        "source_coverage": lambda s, d: series.coverage(_streams(s, d)),
        "keywords": lambda s, d: content.keywords(_read(s, d, "documents", F.col("source").alias("unit"), "text")),
        "foreign_texts": foreign_texts,
    }
    return {name: (lambda s, d, f=f: _rounded(f(s, d))) for name, f in plans.items()} | networks.queries()


_EVIDENCE = """o AS (SELECT ts, user_id AS src, lag(user_id) OVER w AS dst, lag(ts) OVER w AS before FROM events
  WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
e AS (SELECT src, dst, ts FROM o WHERE src <> dst AND ts - before <= INTERVAL 10 MINUTE)"""
_TURNS = f"WITH {_EVIDENCE}, t AS (SELECT src, dst, 0.5::DOUBLE * count(*) AS w, count(*) AS n FROM e GROUP BY 1, 2)"
_ENDS = """ends AS (SELECT src AS node, dst AS other, 1 AS o, w FROM t UNION ALL SELECT dst, src, 0, w FROM t),
alters AS (SELECT node, other, sum(o) AS o, count(*) AS n, sum(w) AS w FROM ends GROUP BY 1, 2),
g AS (SELECT node, sum(n)::BIGINT AS degree, sum(o)::BIGINT AS out_degree, sum(w) AS strength, count(*) AS contacts, count(*) FILTER (n = 2) AS mutual FROM alters GROUP BY 1)"""
_TRIANGLES = """p AS (SELECT DISTINCT src AS u, dst AS v FROM t UNION SELECT dst, src FROM t),
c AS (SELECT u, count(*) AS d FROM p GROUP BY 1),
x AS (SELECT a.u, count(*) AS tri FROM p a JOIN p b ON a.u = b.u AND a.v < b.v JOIN p q ON q.u = a.v AND q.v = b.v GROUP BY 1),
k AS (SELECT c.u AS node, d AS degree, coalesce(tri, 0)::BIGINT AS triangles, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(tri, 0) / (d * (d - 1)) ELSE 0 END AS clustering FROM c LEFT JOIN x ON c.u = x.u)"""
_NATIONS = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
_MIXING = f"{_NATIONS}, m AS (SELECT a.n_regionkey AS from_group, b.n_regionkey AS to_group, count(*) AS ties, sum(w) AS weight FROM t JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey GROUP BY 1, 2)"
_DAYS = """c AS (SELECT event_type AS series, ts::DATE AS win, count(*) AS events, count(DISTINCT user_id) AS actors FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT series, unnest(generate_series(min(win), max(win), INTERVAL 1 DAY))::DATE AS win FROM c GROUP BY series),
days AS (SELECT sp.series, sp.win, coalesce(events, 0) AS events, coalesce(actors, 0) AS actors FROM sp LEFT JOIN c ON c.series = sp.series AND c.win = sp.win)"""
_REGIONAL = """r AS (SELECT from_group AS grp, sum(ties)::DOUBLE AS a, 0::DOUBLE AS b, sum(weight) AS s FROM m GROUP BY 1 UNION ALL SELECT to_group, 0, sum(ties), sum(weight) FROM m GROUP BY 1),
q AS (SELECT grp, sum(a) AS a, sum(b) AS b, sum(s) AS s FROM r GROUP BY 1),
i AS (SELECT sum(ties)::DOUBLE AS same, sum(weight) AS within FROM m WHERE from_group = to_group)"""
_AT = "a AS (SELECT DISTINCT l_orderkey AS event, l_suppkey AS person FROM lineitem), s AS (SELECT event, count(*) AS size FROM a GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "ties_adjacency": f"{_TURNS} SELECT src, dst, w, n FROM t",
        "ties_copresence": f"WITH {_AT} SELECT x.person AS src, y.person AS dst, round(sum(1.0::DOUBLE / (size - 1)), 6) AS w, count(*) AS n FROM a x JOIN a y ON x.event = y.event AND x.person < y.person JOIN s ON s.event = x.event WHERE size <= 25 GROUP BY 1, 2",
        "ties_declared": f"WITH {_NATIONS} SELECT * FROM t",
        "ties_projection": f"WITH {_AT} SELECT x.person AS src, y.person AS dst, count(*) AS shared, round(sum(1.0::DOUBLE / (size - 1)), 6) AS newman FROM a x JOIN a y ON x.event = y.event AND x.person < y.person JOIN s ON s.event = x.event GROUP BY 1, 2 HAVING count(*) >= 2",
        "node_degrees": f"{_TURNS}, {_ENDS} SELECT node, degree, out_degree, strength, contacts, mutual, degree - out_degree AS in_degree FROM g",
        "node_reciprocity": f"{_TURNS}, {_ENDS} SELECT node, round(2.0::DOUBLE * mutual / degree, 6) AS reciprocity FROM g",
        "network_summary": f"""{_TURNS}, {_ENDS}, z AS (SELECT count(*) AS nodes, sum(mutual) AS mutual FROM g), y AS (SELECT count(*) AS ties, min(w) AS least_w, max(w) AS most_w, avg(w) AS mean_w FROM t)
            SELECT nodes, ties, round(ties / (nodes * (nodes - 1))::DOUBLE, 6) AS density, round(ties / nodes::DOUBLE, 6) AS mean_degree, round(mutual / ties::DOUBLE, 6) AS reciprocity, least_w, most_w, round(mean_w, 6) AS mean_w FROM y, z""",
        "strength_gini": f"{_TURNS}, {_ENDS}, r AS (SELECT strength AS x, row_number() OVER (ORDER BY strength) AS i FROM g) SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r",
        "node_clustering": f"{_TURNS}, {_TRIANGLES} SELECT node, degree, triangles, round(clustering, 6) AS clustering FROM k",
        "transitivity": f"{_TURNS}, {_TRIANGLES} SELECT (sum(triangles) / 3)::BIGINT AS triangles, round(sum(triangles) / sum(degree * (degree - 1) / 2.0::DOUBLE), 6) AS transitivity, round(avg(clustering), 6) AS mean_clustering FROM k",
        "group_mixing": f"WITH {_MIXING} SELECT * FROM m",
        "ei_index": f"WITH {_MIXING} SELECT round(sum(CASE WHEN from_group = to_group THEN -ties ELSE ties END) / sum(ties)::DOUBLE, 6) AS ei, round(sum(CASE WHEN from_group = to_group THEN -weight ELSE weight END) / sum(weight), 6) AS ei_weighted FROM m",
        "top_strength": f"{_TURNS}, {_ENDS} SELECT node, strength FROM g ORDER BY strength DESC, node LIMIT 10",
        "tie_turnover": f"""WITH {networks._W}, j AS (SELECT sp.win, count(t.win) AS ties FROM sp LEFT JOIN t ON t.win = sp.win GROUP BY 1), q AS (SELECT a.win, count(*) AS persisted FROM t a JOIN t b ON b.win = a.win - 1 AND a.src = b.src AND a.dst = b.dst GROUP BY 1),
            r AS (SELECT j.win, j.ties, coalesce(persisted, 0) AS persisted, coalesce(l.ties, 0) AS had FROM j LEFT JOIN j l ON l.win = j.win - 1 LEFT JOIN q ON q.win = j.win)
            SELECT win, ties, ties - persisted AS formed, had - persisted AS dissolved, persisted, CASE WHEN win > 0 AND ties + had > persisted THEN round(persisted / (ties + had - persisted)::DOUBLE, 6) END AS jaccard FROM r""",
        "degree_centralization": f"{_TURNS}, {_TRIANGLES} SELECT round((max(d) * count(*) - sum(d)) / ((count(*) - 1) * (count(*) - 2))::DOUBLE, 6) AS centralization FROM c",
        "degree_assortativity": f"""{_TURNS}, o1 AS (SELECT src, count(*) AS x FROM t GROUP BY 1), i1 AS (SELECT dst, count(*) AS y FROM t GROUP BY 1)
            SELECT round(corr(x, y), 6) AS assortativity FROM t JOIN o1 ON t.src = o1.src JOIN i1 ON t.dst = i1.dst""",
        "group_ties": f"""WITH {_MIXING}, v AS (SELECT r_regionkey AS grp,
              coalesce(sum(ties) FILTER (from_group = to_group), 0)::BIGINT AS internal, coalesce(sum(ties) FILTER (from_group <> to_group), 0)::BIGINT AS external,
              coalesce(sum(weight) FILTER (from_group = to_group), 0) AS internal_weight, coalesce(sum(weight) FILTER (from_group <> to_group), 0) AS external_weight
              FROM region JOIN m ON r_regionkey IN (from_group, to_group) GROUP BY 1)
            SELECT *, round((external - internal) / (external + internal)::DOUBLE, 6) AS ei FROM v""",
        "group_assortativity": f"""WITH {_MIXING}, {_REGIONAL}, z AS (SELECT any_value(same) / sum(a) AS tr, sum(a * b) / (sum(a) * sum(a)) AS ex FROM q, i) SELECT round((tr - ex) / (1 - ex), 6) AS assortativity FROM z""",
        "modularity": f"""WITH {_MIXING}, {_REGIONAL} SELECT round(any_value(within) / (sum(s) / 2) - sum(s * s) / (sum(s) * sum(s)), 6) AS modularity FROM q, i""",
        "node_brokerage": f"""WITH {_NATIONS}, b2 AS (SELECT src, dst, w FROM t UNION ALL SELECT dst, src, w FROM t), m AS (SELECT src, dst, sum(w) AS m FROM b2 GROUP BY 1, 2),
            p AS (SELECT src, dst, m / sum(m) OVER (PARTITION BY src) AS p, m / max(m) OVER (PARTITION BY src) AS s FROM m),
            y AS (SELECT v.src AS v, v.dst AS j, any_value(v.p) AS p, coalesce(sum(a.p * b.p), 0) AS via, coalesce(sum(a.p * h.s), 0) AS red
              FROM p v LEFT JOIN p a ON a.src = v.src AND a.dst <> v.dst LEFT JOIN p b ON b.src = a.dst AND b.dst = v.dst LEFT JOIN p h ON h.src = v.dst AND h.dst = a.dst GROUP BY 1, 2)
            SELECT v AS node, round(sum((p + via) * (p + via)), 6) AS "constraint", round(sum(1 - red), 6) AS effective_size FROM y GROUP BY 1""",
        "strength_ranks": f"{_TURNS}, {_ENDS} SELECT node, strength AS value, rank() OVER (ORDER BY strength DESC) AS rank, count(*) OVER (PARTITION BY strength) AS tied FROM g",
        "strength_quantiles": f"""{_TURNS}, {_ENDS}, u AS (SELECT unnest([0.025::DOUBLE, 0.5, 0.975]) AS q, unnest((SELECT quantile_cont(strength, [0.025::DOUBLE, 0.5, 0.975]) FROM g)) AS value) SELECT q, round(value, 6) AS value FROM u""",
        "two_mode_summary": """WITH a AS (SELECT DISTINCT o_custkey AS p, l_suppkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            z AS (SELECT count(DISTINCT p) AS people, count(DISTINCT e) AS events, count(*) AS affiliations FROM a)
            SELECT *, round(affiliations / (people * events)::DOUBLE, 6) AS density, round(affiliations / people::DOUBLE, 6) AS events_each, round(affiliations / events::DOUBLE, 6) AS people_each FROM z""",
        "coder_agreement": """WITH c AS (SELECT quality AS x, toxic AS y FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
            k AS (SELECT x AS code, 1 AS a, 0 AS b FROM c UNION ALL SELECT y, 0, 1 FROM c), g AS (SELECT code, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM k GROUP BY 1),
            z AS (SELECT (SELECT count(*) FROM c) AS items, (SELECT avg((x = y)::INT) FROM c) AS po, (SELECT sum(a * b) / (sum(a) * sum(a)) FROM g) AS pe)
            SELECT items, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM z""",
        "ties_addressed": """WITH e AS (SELECT DISTINCT l_orderkey AS k, 's' || l_suppkey AS dst, CASE WHEN l_linenumber = 1 THEN 'to' ELSE 'cc' END AS rule FROM lineitem)
            SELECT 'c' || o_custkey AS src, dst, rule, count(*) AS n FROM e JOIN orders ON k = o_orderkey WHERE k IN (SELECT k FROM e GROUP BY k HAVING count(DISTINCT dst) <= 25) GROUP BY 1, 2, 3""",
        "ties_reply": "SELECT a.role AS src, b.role AS dst, count(*)::DOUBLE AS w, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role <> b.role GROUP BY 1, 2",
        "ties_log": f"{_TURNS} SELECT src, dst, round(ln(1 + w), 6) AS w, n FROM t WHERE w >= 1",
        "activity_by_day": f"WITH {_DAYS} SELECT * FROM days",
        "activity_shifts": f"""WITH {_DAYS}, b AS (SELECT series, win, events::DOUBLE AS value, list(events::DOUBLE) OVER (PARTITION BY series ORDER BY win ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS base FROM days),
            h AS (SELECT *, list_median(base) AS median FROM b WHERE len(base) > 0), o AS (SELECT *, list_transform(base, lambda x: abs(x - median)) AS off FROM h),
            z AS (SELECT *, CASE WHEN len(base) >= 4 THEN (value - median) / greatest(1.4826 * list_median(off), 1.2533 * list_avg(off), 0.05 * abs(median), sqrt(greatest(median, 1)), 1e-9) END AS z FROM o)
            SELECT series, win, value, round(median, 6) AS median, round(z, 6) AS z, coalesce(abs(z) >= 3.5, false) AS flagged FROM z""",
        "source_coverage": """SELECT event_type AS series, min(ts) AS first, max(ts) AS last, count(*) AS dated, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share
            FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""",
        "keywords": r"""WITH w AS (SELECT source AS unit, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS term FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
            c AS (SELECT unit, term, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT unit, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 20), h AS (SELECT c.*, total FROM c JOIN t USING (unit)),
            d AS (SELECT term, count(*) AS df FROM h GROUP BY 1), s AS (SELECT unit, h.term, n, n / total::DOUBLE * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)::DOUBLE) + 1) AS score FROM h JOIN d ON h.term = d.term WHERE n >= 2),
            k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(score, 9) DESC, n DESC, term)::INT AS place FROM s)
            SELECT unit, term, n, round(score, 6) AS score, place FROM k WHERE place <= 30""",
        "foreign_texts": r"""WITH l AS (SELECT source, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents)
            SELECT source, count(*) AS texts, sum(coalesce(n >= 4 AND n - a > 0.3::DOUBLE * n, false)::INT)::BIGINT AS foreign_texts FROM l GROUP BY 1""",
    } | networks.oracle_sql()
