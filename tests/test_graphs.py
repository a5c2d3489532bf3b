"""Measures of networks whose values are known, by kernels and by rounds alike."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from graphs import CLASS, CLIQUES, CLUBS, KARATE, KARATE_INSTRUCTOR, MAJORS, PATH, RING, SMALL_WORLD, STAR, TEAMS, groups, nodes, ties
from pyspark.sql import functions as F

from kinweave import kernels
from kinweave.operators import centrality, communities, components, measures, structure, twomode
from kinweave.operators import groups as by_group

#: A folder of saved networks (karate.json and others), if there is one.
CLASSIC = os.environ.get("CLASSIC_NETWORKS", "")


def values(table, column):
    return {r["node"]: r[column] for r in table.collect()}


@pytest.fixture(params=["kernel", "rounds"])
def way(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(centrality, "KERNEL_TIES", 0)
    return request.param


def test_paths_of_two_cliques(spark, way):
    t = ties(spark, CLIQUES)
    found = centrality.shortest_paths(t, directed=False)
    between, close = values(found, "betweenness"), values(found, "closeness")
    assert between["hal"] == pytest.approx(0.571, abs=5e-4) and sorted({round(v, 3) for v in between.values()}) == [0, 0.179, 0.571]
    assert sorted({round(v, 3) for v in close.values()}) == [0.583, 0.708, 0.75]
    row = centrality.path_lengths(t, directed=False).collect()[0]
    assert row.mean_path == 2 and not row.sampled


def test_paths_of_a_path_and_a_star(spark, way):
    found = centrality.shortest_paths(ties(spark, PATH), directed=False)
    assert {k: round(v, 3) for k, v in values(found, "betweenness").items()} == {"A": 0, "B": 0.4, "C": 0.6, "D": 0.6, "E": 0.4, "F": 0}
    assert {k: round(v, 3) for k, v in values(found, "closeness").items()} == {"A": 0.457, "B": 0.617, "C": 0.667, "D": 0.667, "E": 0.617, "F": 0.457}
    star = centrality.shortest_paths(ties(spark, STAR), directed=False)
    assert values(star, "betweenness")["hub"] == 1 and values(star, "closeness") == {"hub": 1.0, **dict.fromkeys(["L1", "L2", "L3", "L4", "L5"], pytest.approx(0.6))}


def test_weighted_and_directed_paths(spark, way):
    """Equal lengths that differ in the last bit are equal; directions count."""
    rows = [("a", "b", 10.0), ("b", "d", 10.0), ("a", "c", 5.0), ("c", "d", 1e12), ("a", "d", 1.0), ("d", "e", 1.0)]
    t = spark.createDataFrame(rows, "src string, dst string, w double")
    found = centrality.shortest_paths(t, directed=True, weighted=True)
    between = values(found, "betweenness")
    assert between["b"] == pytest.approx(2 * 0.5 / 12) or between["b"] == pytest.approx(2 / 12)
    close = values(found, "closeness")
    assert close["a"] == 0 and close["b"] == pytest.approx(10 / 4) and close["e"] == pytest.approx((1 / 1.2 + 1 / 1.1 + 1 + 1 / 1.0) / 4, rel=1e-6)


def brute_betweenness(n, arcs):
    """By counting shortest paths between all pairs."""
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    count = np.eye(n)
    adjacent = np.zeros((n, n))
    for a, b in arcs:
        adjacent[a, b] = 1
    step, reach = adjacent.copy(), 1
    while True:
        new = (step > 0) & np.isinf(far)
        if not new.any():
            break
        far[new] = reach
        count = np.where(new, step, count)
        step = np.where(new, step, 0) @ adjacent
        reach += 1
    between = np.zeros(n)
    for v in range(n):
        for s in range(n):
            for t in range(n):
                if len({s, t, v}) == 3 and np.isfinite(far[s, t]) and far[s, v] + far[v, t] == far[s, t]:
                    between[v] += count[s, v] * count[v, t] / count[s, t]
    return between / ((n - 1) * (n - 2)), np.where(np.isfinite(far) & (far > 0), 1 / np.where(far > 0, far, 1), 0).sum(0) / (n - 1)


def test_paths_equal_brute_force(spark, way):
    rng = random.Random(2)
    n = 12 if way == "rounds" else 25
    arcs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)} - {(i, i) for i in range(n)})
    t = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src bigint, dst bigint, w double")
    found = centrality.shortest_paths(t, spark.range(n).withColumnRenamed("id", "node"))
    between, close = brute_betweenness(n, arcs)
    assert [values(found, "betweenness")[i] for i in range(n)] == pytest.approx(between) and [values(found, "closeness")[i] for i in range(n)] == pytest.approx(close)


def test_rings(spark):
    for edges, path, closed in ((RING, 2.895, 0.5), (SMALL_WORLD, 2.347, 0.441)):
        t = ties(spark, edges)
        assert centrality.path_lengths(t, directed=False).collect()[0].mean_path == pytest.approx(path, abs=5e-4)
        assert measures.transitivity(t).collect()[0].transitivity == pytest.approx(closed, abs=5e-4)
    assert structure.centralization(ties(spark, STAR)).collect()[0][0] == 1


def test_class(spark):
    t, majors = ties(spark, CLASS), groups(spark, MAJORS)
    who = nodes(spark, MAJORS)
    assert measures.ei_index(t, majors).collect()[0].ei == pytest.approx(-0.667, abs=5e-4)
    assert by_group.assortativity(t, majors, directed=False).collect()[0][0] == pytest.approx(0.75, abs=5e-4)
    found = communities.louvain(t, who)
    parts = {}
    for node, c in values(found, "community").items():
        parts.setdefault(c, set()).add(node)
    assert sum(len(p) > 1 for p in parts.values()) == 3
    assert structure.modularity(t, found.withColumnRenamed("community", "grp")).collect()[0][0] == pytest.approx(0.5, abs=5e-3)
    row = components.sizes(components.weak(t, who)).collect()[0]
    assert row.components == 2 and row.nodes == 13
    table = {r.grp: r for r in by_group.group_table(t, majors, directed=False).collect()}
    assert table["CS"].ei == pytest.approx(-0.429, abs=5e-4) and table["Sociology"].size == 5


def test_removal(spark):
    t, who = ties(spark, CLIQUES), nodes(spark, [*TEAMS, "hal"])
    rows = {r.when: r for r in by_group.removal(t, groups(spark, TEAMS), who, nodes(spark, ["hal"])).collect()}
    assert (rows["before"].pieces, rows["after"].pieces, rows["before"].ties, rows["after"].ties) == (1, 2, 16, 12)
    assert rows["before"].mean_path == 2 and rows["after"].mean_path == 1 and rows["after"].largest_share == 0.5
    left = centrality.shortest_paths(t.where("src <> 'hal' AND dst <> 'hal'"), directed=False)
    assert {round(v, 3) for v in values(left, "closeness").values()} == {0.429}


def test_ego(spark):
    settings = {"Family": ["Mom", "Dad", "Ana"], "College": ["Kai", "Lena", "Raf", "Zoe"], "Work": ["Priya", "Tom", "Jo"]}
    from itertools import combinations

    pairs = [p for members in settings.values() for p in combinations(members, 2)] + [("Ana", "Kai")]
    pairs.remove(("Raf", "Zoe"))
    assert len(pairs) == 12
    t = ties(spark, pairs + [("ego", a) for members in settings.values() for a in members])
    row = by_group.ego_measures(t, directed=False).where("node = 'ego'").collect()[0]
    assert (row["size"], row.among) == (10, 12) and row.density == pytest.approx(0.267, abs=5e-4)
    assert row.effective_size == pytest.approx(7.6) and row.constraint == pytest.approx(0.292, abs=5e-4)
    assert by_group.simple_ego(10, 12)["effective_size"] == pytest.approx(7.6)
    kinds = groups(spark, {a: s for s, members in settings.items() for a in members} | {"ego": "Work"})
    row = by_group.ego_homophily(t, kinds).where("node = 'ego'").collect()[0]
    assert row.known == 10 and row.diversity == pytest.approx(1 - 0.09 - 0.16 - 0.09) and row.diversity_normalized == pytest.approx(0.66 * 1.5) and row.homophily == pytest.approx(0.3) and row.ei == pytest.approx(0.4)


def clubs(spark):
    names = {n: int(n in ("chess", "choir", "drama", "robotics")) for edge in CLUBS for n in edge}
    return ties(spark, CLUBS), spark.createDataFrame(list(names.items()), "node string, mode int")


def test_clubs(spark):
    t, modes = clubs(spark)
    row = twomode.summary(t, modes).collect()[0]
    assert row.density == pytest.approx(0.417, abs=5e-4) and row.robins_alexander == pytest.approx(0.333, abs=5e-4) and (row.nodes_0, row.nodes_1, row.ties) == (6, 4, 10)
    assert values(twomode.degrees(t, modes), "degree")["dev"] == 0.5
    between = values(twomode.betweenness(t, modes), "betweenness")
    assert between["cara"] == pytest.approx(0.667, abs=5e-4) and between["dev"] == pytest.approx(0.6, abs=5e-4)
    close = values(twomode.closeness(t, modes), "closeness")
    assert 0 < close["ana"] < close["cara"] <= 1
    assert values(twomode.clustering(t, modes), "clustering")["ana"] == pytest.approx((1 + 1 / 3) / 2)
    parts = communities.two_mode(t, modes)
    assert parts.count() == 10 and 0 < twomode.modularity(t, modes, parts).collect()[0][0] < 1
    sides = values(twomode.colouring(t, modes.select("node")), "mode")
    assert len({(modes_, sides[n]) for n, modes_ in values(modes, "mode").items()}) == 2
    assert twomode.colouring(ties(spark, CLASS), nodes(spark, MAJORS)).count() == 0


def classic(spark, name, keep=None):
    """Ties and numbered nodes of a saved network; each event is one tie."""
    path = f"{CLASSIC}/{name}.json"
    if not CLASSIC or not os.path.exists(path):
        pytest.skip("the saved network is not here")
    data = json.load(open(path, encoding="utf-8"))
    plain = lambda x: x["d"] if isinstance(x, dict) and "d" in x else x
    ev = data["events"]
    attrs = ev.get("attrs") or [None] * ev["count"]
    actor, off, to, weight = (plain(ev[k]) for k in ("actor", "tOff", "tgt", "weight"))
    rows = [(actor[i], to[off[i]], float(weight[i])) for i in range(ev["count"]) if keep is None or keep(attrs[i] or {})]
    return rows, data["nodes"]


def test_karate(spark):
    t = spark.createDataFrame([(a, b, 1.0) for a, b in KARATE], "src bigint, dst bigint, w double")
    assert t.count() == 78
    between = sorted(values(centrality.shortest_paths(t, directed=False), "betweenness").values())
    assert between[-1] == pytest.approx(0.438, abs=5e-4) and between[-2] == pytest.approx(0.304, abs=5e-4)
    faction = spark.createDataFrame([(i, str(i in KARATE_INSTRUCTOR)) for i in range(1, 35)], "node bigint, grp string")
    assert measures.ei_index(t, faction).collect()[0].ei == pytest.approx(-0.718, abs=5e-4)
    assert communities.louvain(t).select("community").distinct().count() == 4
    cores = values(centrality.cores(t), "core")
    assert max(cores.values()) == 4 and sum(c == 4 for c in cores.values()) == 10


def test_karate_weights(spark):
    rows, _ = classic(spark, "karate")
    assert len(rows) == 78 and sum(w for *_, w in rows) == 231


def test_florentine(spark):
    for kept, n, pieces, first, second in ((("marriage",), 20, 2, 0.452, 0.221), (("business",), 15, 6, None, None), (("marriage", "business"), 27, 2, 0.413, None)):
        rows, people = classic(spark, "florentine", lambda a, kept=kept: bool({a.get("relation")} & set(kept)) if isinstance(a.get("relation"), str) else bool(set(a.get("relation") or []) & set(kept)))
        t = spark.createDataFrame(rows, "src bigint, dst bigint, w double").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
        assert t.count() == n
        who = spark.range(len(people["keys"])).withColumnRenamed("id", "node")
        assert components.weak(t, who).select("component").distinct().count() == pieces
        if first:
            between = sorted(values(centrality.shortest_paths(t, who, directed=False), "betweenness").values())
            assert between[-1] == pytest.approx(first, abs=5e-4) and (second is None or between[-2] == pytest.approx(second, abs=5e-4))


def test_krackhardt(spark):
    rows, people = classic(spark, "krackhardt", lambda a: a.get("relation") == "advice")
    t = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    assert t.count() == 190 and measures.summary(t).collect()[0].reciprocity == pytest.approx(0.474, abs=5e-4)
    assert max(values(centrality.shortest_paths(t), "betweenness").values()) == pytest.approx(0.234, abs=5e-4)


def test_lesmis_and_dolphins(spark):
    rows, people = classic(spark, "lesmis")
    t = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    assert (len(people["keys"]), t.count(), sum(w for *_, w in rows)) == (77, 254, 820)
    between = sorted(values(centrality.shortest_paths(t, directed=False), "betweenness").values())
    assert between[-1] == pytest.approx(0.570, abs=5e-4) and between[-2] == pytest.approx(0.177, abs=5e-4)
    assert max(values(measures.degrees(t), "strength").values()) == 158
    rows, people = classic(spark, "dolphins")
    t = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    between = sorted(values(centrality.shortest_paths(t, directed=False), "betweenness").values())
    assert t.count() == 159 and between[-1] == pytest.approx(0.248, abs=5e-4) and between[-2] == pytest.approx(0.213, abs=5e-4)


def test_davis(spark):
    rows, people = classic(spark, "davis")
    t = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    modes = spark.createDataFrame([(i, int(a["bipartite"])) for i, a in enumerate(people["attrs"])], "node bigint, mode int")
    row = twomode.summary(t, modes).collect()[0]
    assert (row.nodes_0, row.nodes_1, row.ties) == (18, 14, 89) and max(values(twomode.degrees(t, modes), "degree").values()) == pytest.approx(14 / 18)
    assert twomode._shared(t, modes, 0).count() == 139


def test_spectra(spark, way):
    rng = random.Random(5)
    n = 8 if way == "rounds" else 30
    arcs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)} - {(i, i) for i in range(n)})
    t = spark.createDataFrame([(a, b, float(rng.randint(1, 5))) for a, b in arcs], "src bigint, dst bigint, w double")
    who = spark.range(n + 1).withColumnRenamed("id", "node")
    kwargs = {"tolerance": 1e-6, "rounds": 12} if way == "rounds" else {}
    x = values(centrality.eigenvector(t, who, **kwargs), "eigenvector")
    matrix = np.zeros((n + 1, n + 1))
    for r in t.collect():
        matrix[r.src, r.dst] += r.w
    both = matrix + matrix.T
    top = np.abs(np.linalg.eigh(both)[1][:, -1])
    close = 0.1 if way == "rounds" else 1e-8
    assert x[n] == 0 and [x[i] for i in range(n)] == pytest.approx(top[:n], abs=close)
    p = values(centrality.pagerank(t, who, **kwargs), "pagerank")
    out = matrix.sum(1, keepdims=True)
    walk = np.where(out > 0, matrix / np.where(out > 0, out, 1), 1 / (n + 1))
    exact = np.linalg.solve(np.eye(n + 1) - 0.85 * walk.T, np.full(n + 1, 0.15 / (n + 1)))
    assert sum(p.values()) == pytest.approx(1) and [p[i] for i in range(n + 1)] == pytest.approx(exact, abs=0.05 if way == "rounds" else 1e-9)


def test_components_and_cores(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)]
    t = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src bigint, dst bigint, w double")
    who = spark.range(1, 10).withColumnRenamed("id", "node")
    assert values(components.weak(t, who), "component") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 9: 9}
    assert values(components.strong(t, who), "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    rows = kernels.Rows.of(10, np.array([a for a, _ in arcs]), np.array([b for _, b in arcs]), np.ones(len(arcs)))
    assert kernels.strong_labels(rows)[1:9].tolist() == [1, 1, 1, 4, 4, 6, 7, 8]
    assert values(centrality.cores(t, who), "core") == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0}
    none = t.where("false")
    assert centrality.shortest_paths(none).count() == centrality.cores(none).count() == components.strong(none).count() == 0


def test_ego_density_and_numbers(spark):
    t = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "src bigint, dst bigint, w double")
    assert values(centrality.ego_density(t), "ego_density") == {1: 0.5, 2: 0.5, 3: pytest.approx(2 / 6), 4: None}
    assert values(centrality.ego_density(t, directed=False), "ego_density") == {1: 1.0, 2: 1.0, 3: pytest.approx(1 / 3), 4: None}
    ages = spark.createDataFrame([(1, 10.0), (2, 12.0), (3, 30.0), (4, None)], "node bigint, value double")
    x, y = zip((10, 12), (12, 10), (10, 30), (12, 30))
    assert by_group.numeric_assortativity(t, ages).collect()[0][0] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_large_networks_are_contracted_first(spark, monkeypatch):
    """Two dense parts, found alike when the kernel is only let at what is left."""
    rng = random.Random(8)
    edges = [(a, b) for base in (0, 20) for a in range(base, base + 20) for b in range(a + 1, base + 20) if rng.random() < 0.5] + [(0, 20), (5, 25)]
    t = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src bigint, dst bigint, w double")
    monkeypatch.setattr(centrality, "KERNEL_TIES", 60)
    q = structure.modularity(t, communities.louvain(t).withColumnRenamed("community", "grp")).collect()[0][0]
    best = structure.modularity(t, t.select(F.col("src").alias("node")).union(t.select("dst")).distinct().withColumn("grp", (F.col("node") >= 20).cast("int"))).collect()[0][0]
    assert q >= best - 0.08


def test_partitions_compared(spark):
    one = spark.createDataFrame([(i, i // 5) for i in range(20)], "node bigint, community bigint")
    same = communities.agreement(one, one.withColumn("community", 9 - F.col("community"))).collect()[0]
    assert same.nmi == pytest.approx(1) and same.ari == pytest.approx(1)
    other = spark.createDataFrame([(i, i % 4) for i in range(20)], "node bigint, community bigint")
    row = communities.agreement(one, other).collect()[0]
    assert 0 <= row.nmi < 0.1 and -0.3 < row.ari < 0
    assert [r.number for r in communities.by_size(one).where("node = 19").collect()] == [3]
    assert communities.matched(one, one).where("community <> was").count() == 0


def test_two_mode_blocks(spark, monkeypatch):
    """Blocks that meet two by two, rows and sorted pairs, all give the pairs' sums; pairs themselves leave no worker."""
    import random

    draw = random.Random(5)
    pairs = sorted({(2 * draw.randrange(60), 2 * draw.randrange(25) + 1) for _ in range(400)} | {(2 * i, 1) for i in range(60)} | {(2000, 2001)})
    t = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    modes = spark.createDataFrame([(v, v % 2) for v in sorted({v for p in pairs for v in p} | {3000})], "node bigint, mode int")
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
        of.setdefault(b, set()).add(a)
    mates = {v: [u for u in of if u != v and u % 2 == v % 2 and of[u] & of[v]] for v in of}
    means = {v: sum(len(of[u] & of[v]) / len(of[u] | of[v]) for u in mates[v]) / len(mates[v]) if mates[v] else 0.0 for v in of} | {3000: 0.0}
    cycles = sum(len(of[u] & of[v]) * (len(of[u] & of[v]) - 1) // 2 for v in of for u in mates[v] if u < v and v % 2 == 0)
    monkeypatch.setattr(twomode, "project", None)
    monkeypatch.setattr(twomode, "BLOCK_TIES", 150)
    monkeypatch.setattr(twomode, "LEAST_TIES", 1)
    row = twomode.summary(t, modes).collect()[0]
    assert (row.ties, row.four_cycles) == (len(pairs), cycles) and row.mean_clustering == pytest.approx(sum(means.values()) / len(means))
    own = [v for v in sorted(of) if v % 2 == 0]
    packs = [twomode._pack(pa.table({"block": pa.array([i] * len(part), pa.int32()), "number": part, "others": [sorted(of[v]) for v in part]})) for i, part in enumerate((own[:20], own[20:]))]
    for sparse, paths in [(12, 1 << 21), (0, 64), (10**6, 64)]:
        monkeypatch.setattr(twomode, "SPARSE", sparse)
        monkeypatch.setattr(twomode, "PATHS", paths)
        found = pa.concat_tables([twomode._meeting(pa.concat_tables(met)) for met in (packs[:1], packs[1:], packs)]).to_pandas()
        sums = found.groupby("number").sum()
        assert (sums["likes"] / sums["others"]).to_dict() == pytest.approx({v: means[v] for v in own if mates[v]}) and sums["cycles"].sum() == cycles


def test_two_mode_disk(spark, monkeypatch, tmp_path):
    """A summary moves no packed block among tasks, leaves no table, and knows null ends as SQL does."""
    draw = random.Random(6)
    pairs = sorted({(2 * draw.randrange(50), 2 * draw.randrange(20) + 1) for _ in range(300)}) + [(None, 5), (None, 7), (None, 7), (8, None)]
    of = {v: {p[1 - i] for p in pairs if p[i] == v} for i in (0, 1) for v in {p[i] for p in pairs} - {None}}
    t = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    modes = spark.createDataFrame([(v, v % 2) for v in sorted(of)], "node bigint, mode int")
    both = lambda u, v: len((of[u] & of[v]) - {None})
    mates = {v: [u for u in of if u != v and u % 2 == v % 2 and both(u, v)] for v in of}
    means = [sum(both(u, v) / (len(of[u]) + len(of[v]) - both(u, v)) for u in mates[v]) / len(mates[v]) if mates[v] else 0.0 for v in of]
    whole = [p for p in pairs if None not in p]
    monkeypatch.setattr(twomode, "BLOCK_TIES", 60)
    monkeypatch.setattr(twomode, "LEAST_TIES", 1)
    plans, made = [], twomode.storage.stored
    monkeypatch.setattr(twomode.storage, "stored", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), made(df, label))[1])
    monkeypatch.setattr(twomode.storage, "scratch_dir", lambda spark: str(tmp_path))
    row = twomode.summary(t, modes).collect()[0]
    assert row.ties == len(whole) and row.three_paths == sum((len(of[a]) - 1) * (len(of[b]) - 1) for a, b in whole)
    assert row.four_cycles == sum(both(u, v) * (both(u, v) - 1) // 2 for v in of for u in mates[v] if u < v and v % 2 == 0)
    assert row.mean_clustering == pytest.approx(sum(means) / len(means))
    assert not [name for _, _, names in os.walk(tmp_path) for name in names]
    assert "".join(p for label, p in plans if label == "met").count("CartesianProduct") == 2


def test_paths_beyond_the_bound(spark, monkeypatch, tmp_path):
    """Unweighted networks are held up to four times the bound; beyond, batches of sources give the same sums and leave no tables."""
    draw = random.Random(7)
    pairs = sorted({(draw.randrange(90), draw.randrange(90)) for _ in range(160)} | {(i, i + 1) for i in range(100, 140)})
    t = spark.createDataFrame([(a, b, 1.0) for a, b in pairs if a != b], "src bigint, dst bigint, w double")
    monkeypatch.setattr(kernels, "GATHERED", 16)
    arcs, every = t, centrality.all_nodes(t, None)
    monkeypatch.setattr(centrality, "KERNEL_TIES", every.count())
    assert centrality.held(arcs, every) is None and centrality.held(arcs, every, weighted=False) is not None
    whole = {r.node: r for r in centrality.shortest_paths(t).collect()}
    assert values(centrality.closeness(t), "closeness") == pytest.approx({v: r.closeness for v, r in whole.items()})
    small = t.where("src < 8 AND dst < 60")
    flat = lambda t: {(r.node, c): r[c] for r in centrality.shortest_paths(t).collect() for c in ("betweenness", "closeness")}
    kept = flat(small)
    monkeypatch.setattr(centrality, "KERNEL_TIES", 0)
    monkeypatch.setattr(centrality, "ROUND_ROWS", small.count() * centrality.all_nodes(small, None).count() // 2)
    made = []
    monkeypatch.setattr(centrality.storage, "discard", lambda s, *paths, inner=centrality.storage.discard: (made.extend(paths), inner(s, *paths))[1])
    assert flat(small) == pytest.approx(kept)
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in made} >= {"steps", "passed", "open", "distances", "sums"} and not any(os.path.exists(p.removeprefix("file://")) for p in made)


def test_betweenness_driver_memory(spark, monkeypatch):
    """The driver gets numbers of four bytes for a tie's ends, no row for each tie; names of any type keep their values."""
    pairs = sorted({(i, (i * k + 7) % 40) for i in range(40) for k in range(2, 12)})
    t = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs if a != b], "src string, dst string, w double")
    between, close = brute_betweenness(40, [(a, b) for a, b in pairs if a != b])
    kind, sent = type(t), []
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("gathered as rows"))
    monkeypatch.setattr(kind, "collect", lambda self: pytest.fail("gathered as rows"))
    monkeypatch.setattr(kind, "toArrow", lambda self, inner=kind.toArrow: (sent.append(inner(self)), sent[-1])[1])
    found = centrality.shortest_paths(t, approx=False)
    assert [len(x) for x in sent] == [40, t.count()] and sent[1].nbytes <= 9 * t.count()
    monkeypatch.undo()
    rows = {r.node: r for r in found.collect()}
    assert [rows[f"n{i}"].betweenness for i in range(40)] == pytest.approx(between) and [rows[f"n{i}"].closeness for i in range(40)] == pytest.approx(close)


@pytest.mark.parametrize("n, ties", [(60, 90), (60, 1500), (300, 900), (2000, 12000), (2000, 2100)])
def test_dependencies_touch_few_ties(n, ties, monkeypatch):
    """Sparse and dense networks, with nodes out of reach: sums equal brute force whichever way steps go; no step looks at most ties but once each."""
    draw = np.random.default_rng(n + ties)
    key = np.unique(draw.integers(0, n - 5, ties) * n + draw.integers(0, n, ties))
    src, dst = (key // n).astype(np.int32), (key % n).astype(np.int32)
    src, dst = src[src != dst], dst[src != dst]
    g = kernels.Rows.unweighted(n, src, dst)
    looked = []
    monkeypatch.setattr(kernels.Rows, "spread", lambda self, nodes, inner=kernels.Rows.spread: (looked.append(x := inner(self, nodes)), x)[1])
    for source in (0, 7, n - 1):
        looked.clear()
        share, near = kernels.dependencies(g, source)
        steps, rings = kernels.levels(g, source)
        paths, want = np.zeros(n), np.zeros(n)
        paths[source] = 1
        for ring in rings[1:]:
            for v in ring:
                paths[v] = paths[[u for u in src[dst == v] if steps[u] == steps[v] - 1]].sum()
        for ring in reversed(rings):
            for v in ring:
                for u in src[dst == v]:
                    if steps[u] == steps[v] - 1 >= 0:
                        want[u] += paths[u] / paths[v] * (1 + want[v])
        want[source] = 0
        assert share == pytest.approx(want) and near == pytest.approx(np.where(steps > 0, 1 / np.maximum(steps, 1), 0))
        assert all(len(to) <= kernels.WHOLE * len(src) for to, _, _ in looked)
    if (n, ties) == (2000, 12000):
        assert sum(len(to) for to, _, _ in looked) < 0.9 * len(src)


def test_closeness_driver_memory(spark, monkeypatch):
    """As betweenness: eight bytes a tie to the driver. Pieces of any size give the same steps, and no step goes on from nodes that have all targets."""
    draw = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in draw.integers(0, 150, (900, 2)) if a != b} | {(i, 200) for i in range(150)} | {(i, i + 1) for i in range(300, 340)})
    t = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    kind, sent = type(t), []
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("gathered as rows"))
    monkeypatch.setattr(kind, "collect", lambda self: pytest.fail("gathered as rows"))
    monkeypatch.setattr(kind, "toArrow", lambda self, inner=kind.toArrow: (sent.append(inner(self)), sent[-1])[1])
    found = centrality.closeness(t)
    assert len(sent) == 2 and sent[1].num_rows == len(pairs) and sent[1].nbytes <= 9 * len(pairs)
    monkeypatch.undo()
    names = np.unique(pairs)
    src, dst = np.searchsorted(names, np.array(pairs)).astype(np.int32).T
    g = kernels.Rows.unweighted(len(names), src, dst)
    want = sum(kernels.dependencies(g, v)[1] for v in range(len(names)))
    assert values(found, "closeness") == pytest.approx(dict(zip(names.tolist(), want / (len(names) - 1))))
    looked = []
    monkeypatch.setattr(kernels.Rows, "spread", lambda self, nodes, inner=kernels.Rows.spread: (looked.append(len((x := inner(self, nodes))[0])), x)[1])
    for gathered in (1, 1 << 18):
        monkeypatch.setattr(kernels, "GATHERED", gathered)
        for at in (np.arange(len(names)), np.arange(3, 67), np.array([names.tolist().index(200)])):
            looked.clear()
            assert kernels.inverse_steps(g, at) == pytest.approx(want[at])
    assert sum(looked) == 150 + len(pairs) - 40  # the ties to the hub, then once those of the nodes tied to it; none of the chain out of reach
