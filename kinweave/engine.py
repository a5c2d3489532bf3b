"""The engine's methods on one dataset: settings, networks, measures, series and content by name, each a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import model, settings
from kinweave.model import Dataset
from kinweave.operators import applicability, centrality, communities, components, construct, content, groups, measures, structure, timewin, twomode, uncertainty
from kinweave.operators.construct import Network
from kinweave.settings import RULES, Settings

#: Node measures by name: what makes them of (ties, nodes, directed).
NODE_MEASURES = {
    "degree": lambda t, n, d: measures.degrees(t).select("node", "degree"),
    "in_degree": lambda t, n, d: measures.degrees(t).select("node", "in_degree"),
    "out_degree": lambda t, n, d: measures.degrees(t).select("node", "out_degree"),
    "strength": lambda t, n, d: measures.degrees(t).select("node", "strength"),
    "contacts": lambda t, n, d: measures.degrees(t).select("node", "contacts"),
    "reciprocity": lambda t, n, d: measures.reciprocity(t),
    "betweenness": lambda t, n, d: centrality.shortest_paths(t, n, d).select("node", "betweenness"),
    "closeness": lambda t, n, d: centrality.shortest_paths(t, n, d).select("node", "closeness"),
    "betweenness_weighted": lambda t, n, d: centrality.shortest_paths(t, n, d, True).select("node", F.col("betweenness").alias("betweenness_weighted")),
    "closeness_weighted": lambda t, n, d: centrality.shortest_paths(t, n, d, True).select("node", F.col("closeness").alias("closeness_weighted")),
    "eigenvector": lambda t, n, d: centrality.eigenvector(t, n),
    "pagerank": lambda t, n, d: centrality.pagerank(t, n, d),
    "core": lambda t, n, d: centrality.cores(t, n),
    "clustering": lambda t, n, d: measures.clustering(t).select("node", "clustering"),
    "ego_density": lambda t, n, d: centrality.ego_density(t, d),
    "constraint": lambda t, n, d: structure.brokerage(t).select("node", "constraint"),
    "effective_size": lambda t, n, d: structure.brokerage(t).select("node", "effective_size"),
}


class Engine:
    """A dataset and what can be asked of it. ``build`` sets the network that measures are taken of."""

    def __init__(self, dataset: Dataset):
        self.dataset = dataset
        self.net: Network | None = None

    def rules(self) -> list[str]:
        return list(RULES)

    def glossary(self) -> dict[str, str]:
        return dict(applicability.GLOSSARY)

    def default_settings(self) -> Settings:
        return settings.default_settings(self.dataset)

    def evidence_counts(self) -> DataFrame:
        return settings.evidence_counts(self.dataset)

    def build(self, given: dict | Settings | None = None) -> Network:
        self.net = construct.build(self.dataset, settings.normalized(self.dataset, given))
        return self.net

    def network(self) -> Network:
        return self.net or self.build()

    def _parts(self) -> tuple[DataFrame, DataFrame, bool]:
        net = self.network()
        return net.pairs(), net.nodes.select(F.col("node_id").alias("node")), net.directed

    def summary(self) -> DataFrame:
        return construct.summary(self.network())

    def node_metrics(self, which: list[str]) -> DataFrame:
        """(node, measures...) of every node of the network; counts of nodes without ties are 0."""
        ties, nodes, directed = self._parts()
        out = nodes
        for name in which:
            out = out.join(NODE_MEASURES[name](ties, nodes, directed), "node", "left")
        counts = [w for w in which if w in ("degree", "in_degree", "out_degree", "contacts", "core")]
        amounts = [w for w in which if w in ("strength", "clustering")]
        return out.fillna(0, counts).fillna(0.0, amounts) if counts or amounts else out

    def network_metrics(self) -> DataFrame:
        """(metric, value) of the whole network."""
        ties, nodes, directed = self._parts()
        size = components.sizes(components.weak(ties, nodes)).select(F.col("nodes").cast("double"), F.col("components").cast("double"), "largest_share")
        shape = measures.transitivity(ties).select("transitivity", "mean_clustering")
        paths = centrality.path_lengths(ties, nodes, directed).select("mean_path", F.col("diameter").cast("double"))
        gini = measures.gini(measures.degrees(ties), "strength")
        m = ties.agg(F.count("*").cast("double").alias("ties"))
        row = size.join(F.broadcast(m)).join(F.broadcast(shape)).join(F.broadcast(paths)).join(F.broadcast(gini)).join(F.broadcast(structure.centralization(ties)))
        n = F.col("nodes")
        row = row.withColumn("density", F.when(n > 1, F.col("ties") / (n * (n - 1)) * (1 if directed else 2)).otherwise(0.0)).withColumn("mean_degree", F.col("ties") / n * (1 if directed else 2))
        if directed:
            row = row.join(F.broadcast(measures.summary(ties).select("reciprocity")))
        cells = [c for c in row.columns]
        return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cells]), F.array(*[F.col(c).cast("double") for c in cells]))).alias("metric", "value"))

    def _groups(self, attr: str) -> DataFrame:
        value = F.col("attrs")[attr]
        return self.dataset.nodes.select(F.col("node_id").alias("node"), F.when(value != "", value).alias("grp"))

    def communities(self, resolution: float = 1.0, seed: int = 1) -> DataFrame:
        net = self.network()
        ties, nodes, _ = self._parts()
        if net.settings.two_mode and net.basis is None:
            return communities.two_mode(ties, net.nodes.select(F.col("node_id").alias("node"), "mode"), resolution, seed)
        return communities.louvain(ties, nodes, resolution, seed)

    def group_metrics(self, attr: str) -> dict[str, DataFrame]:
        ties, _, directed = self._parts()
        by = self._groups(attr)
        return {"groups": groups.group_table(ties, by, directed), "mixing": groups.mixing_table(ties, by, directed), "ei": measures.ei_index(ties, by), "assortativity": groups.assortativity(ties, by, directed)}

    def ego_metrics(self, node: int, attr: str | None = None) -> DataFrame:
        ties, nodes, directed = self._parts()
        own = groups.ego_measures(ties, nodes, directed).where(F.col("node") == node)
        return own.join(groups.ego_homophily(ties, self._groups(attr)), "node", "left") if attr else own

    def two_mode(self) -> dict[str, DataFrame]:
        net = self.network()
        ties, modes = net.pairs(), net.nodes.select(F.col("node_id").alias("node"), "mode")
        return {"summary": twomode.summary(ties, modes), "degree": twomode.degrees(ties, modes), "betweenness": twomode.betweenness(ties, modes), "closeness": twomode.closeness(ties, modes), "clustering": twomode.clustering(ties, modes)}

    def null_model(self, attr: str | None = None, **kwargs) -> DataFrame:
        ties, _, directed = self._parts()
        return uncertainty.null_model(ties, directed, self._groups(attr) if attr else None, **kwargs)

    def resample_ranks(self, metric: str = "betweenness", **kwargs) -> DataFrame:
        return uncertainty.resample_ranks(self.dataset, self.network().settings, metric, **kwargs)

    def applicability(self) -> dict[str, tuple[str, list[str]]]:
        kinds = {r["key"]: (r["type"], r["coverage"]) for r in model.attribute_schema(self.dataset.nodes).collect()}  # a row for each attribute
        return applicability.applicability(applicability.facts(self.network(), kinds))

    def time_series(self, window="week", attr: str | None = None, **kwargs) -> timewin.Series | None:
        return timewin.series(self.dataset, self.network().settings, window, groups=self._groups(attr) if attr else None, **kwargs)

    def detect_shifts(self, window="week", method: str = "robust", **kwargs) -> DataFrame | None:
        found = self.time_series(window)
        return None if found is None else timewin.detect_shifts(found, self.dataset, method, **kwargs)

    def compare_before_after(self, date: datetime, attr: str | None = None, **kwargs) -> timewin.Comparison:
        return timewin.compare(self.dataset, self.network().settings, date, groups=self._groups(attr) if attr else None, **kwargs)

    def keywords(self, by: str = "node", top: int = 10, **kwargs) -> DataFrame:
        return content.keywords_of(content.unit(self.dataset, content.corpus(self.dataset), by, **kwargs), top)

    def topics(self, **kwargs):
        return content.topics(content.corpus(self.dataset), **kwargs)

    def affect(self, lexicon: DataFrame, by: str = "all", least: int = 1, **kwargs) -> DataFrame:
        texts = self.dataset.events.where("type = 'message' AND text IS NOT NULL")
        units = content.unit(self.dataset, texts.select("event_id", "actor", "context", "source", "t"), by, **kwargs)
        return content.tone_by_unit(content.tone(texts, lexicon).join(units.select("event_id", "unit"), "event_id"), least)

    def diffusion(self, terms: list[str] | None = None, common: list[str] = (), **kwargs) -> DataFrame:
        ties, _, _ = self._parts()
        docs = content.corpus(self.dataset)
        uses = content.first_uses(docs)
        wanted = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string") if terms else content.new_terms(uses, docs, list(common))
        pairs = centrality.both_ways(ties).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        people = pairs.select(F.col("u").alias("node")).distinct()
        return content.diffusion(uses.join(F.broadcast(wanted), "term").join(people, "node", "left_semi"), pairs, **kwargs)

    def edge_evidence(self, a: int, b: int, **kwargs) -> DataFrame:
        return construct.edge_evidence(self.network(), a, b, **kwargs)

    def search_nodes(self, text: str, limit: int = 20) -> DataFrame:
        """Nodes whose key, label or an attribute holds the text, in any case of letters."""
        like = lambda c: F.lower(c).contains(text.lower())
        found = like(F.col("key")) | like(F.col("label")) | F.exists(F.map_values(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), like)
        return self.dataset.nodes.where(F.coalesce(found, F.lit(False))).orderBy("key").limit(limit)

    def top_nodes(self, metric: str, k: int = 10, attr: tuple[str, str] | None = None, ascending: bool = False) -> DataFrame:
        """(node, value) of the k highest, or lowest, of those with an attribute's value; at most 50."""
        values = self.node_metrics([metric]).withColumnRenamed(metric, "value").where("value IS NOT NULL")
        if attr:
            values = values.join(self._groups(attr[0]).where(F.col("grp") == attr[1]).select("node"), "node", "left_semi")
        return values.orderBy(F.asc("value") if ascending else F.desc("value"), "node").limit(min(k, 50))
