"""Query facade: the tools people and agents call, each one DataFrame plan.

An ``Estate`` holds the tables of the permitted repositories; permission is a
semi-join made once, before any tool counts anything.  Traversals follow drawn
edges unless bands are named.  What is not known is said so: ``references``
without a precise index answers ``provider_unavailable``, never zero rows as if
there were none, and ``definition`` labels a search fallback as such.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vocab import DRAWN, band_of_rank, band_rank
from graphloom.operators import analytics, graph, search, structure
from graphloom.operators.text import excerpt


@dataclass
class Estate:
    """nodes (repo_id, node_id, kind, name, qualified_name, doc, parent_id, file_id, start_line, end_line),
    edges (repo_id, src, dst, kind, band), files, texts (file_id, blob_sha, text), and optional tables."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    texts: DataFrame | None = None
    candidates: DataFrame | None = None
    contracts: DataFrame | None = None
    findings: DataFrame | None = None
    occurrences: DataFrame | None = None
    metrics: DataFrame | None = None
    permitted: Iterable[str] | None = None
    _feedback: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.permitted is not None:
            keep = self.nodes.sparkSession.createDataFrame([(r,) for r in self.permitted], "repo_id string")
            for name in ("nodes", "edges", "files", "candidates", "contracts", "findings", "occurrences", "metrics"):
                df = getattr(self, name)
                if df is not None and "repo_id" in df.columns:
                    setattr(self, name, df.join(keep, "repo_id", "left_semi"))
            # Texts and ends of edges are permitted with their files and nodes.
            if self.texts is not None:
                self.texts = self.texts.join(self.files.select("file_id").distinct(), "file_id", "left_semi")
            for end in ("src", "dst"):
                ids = self.nodes.select(F.col("node_id").alias(end)).distinct()
                self.edges = self.edges.join(ids, end, "left_semi")
                if self.candidates is not None and end in self.candidates.columns:
                    self.candidates = self.candidates.join(ids, end, "left_semi")

    def _edges(self, bands: Iterable[str] | None, kind: str | None = "CALLS") -> DataFrame:
        e = self.edges.filter(F.col("band").isin(*(bands or DRAWN)))
        return e if kind is None or "kind" not in e.columns else e.filter(F.col("kind") == kind)

    def _one(self, node_id: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(node_id,)], "node_id string")

    def manifest(self) -> DataFrame:
        return self.files.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"))

    def search(self, text: str, *, kinds: Iterable[str] | None = None, limit: int = 20) -> DataFrame:
        n = self.nodes if kinds is None else self.nodes.filter(F.col("kind").isin(*kinds))
        body = n.select("node_id", F.concat_ws(" ", "name", "qualified_name", "doc").alias("body"))
        hits = search.bm25(body, "node_id", "body", text.split())
        if self.metrics is not None:
            hits = hits.join(self.metrics.filter("metric = 'importance'").select("node_id", F.col("value").alias("importance")), "node_id", "left")
        else:
            hits = hits.withColumn("importance", F.lit(None).cast("double"))
        return hits.join(n.select("node_id", "kind", "name", "qualified_name"), "node_id").orderBy(F.col("score").desc(), F.col("importance").desc_nulls_last(), "node_id").limit(limit)

    def symbol(self, node_id: str) -> DataFrame:
        """The node with its chain of parents, nearest first."""
        parents = self.nodes.filter("parent_id is not null").select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
        chain = graph.reach(parents, self._one(node_id), None).select(F.col("node").alias("node_id"), "distance")
        return chain.join(self.nodes.select("node_id", "kind", "name", "qualified_name"), "node_id").orderBy("distance")

    def callers(self, node_id: str, depth: int = 1, bands: Iterable[str] | None = None) -> DataFrame:
        return graph.reach(self._edges(bands), self._one(node_id), max(1, min(5, depth)), reverse=True).filter("distance > 0").select("node", "distance")

    def callees(self, node_id: str, depth: int = 1, bands: Iterable[str] | None = None) -> DataFrame:
        return graph.reach(self._edges(bands), self._one(node_id), max(1, min(5, depth))).filter("distance > 0").select("node", "distance")

    def trace(self, src: str, dst: str) -> DataFrame:
        return graph.traces(self._edges(None), src, dst, depth=8, most=5)

    def blast_radius(self, node_ids: Iterable[str], depth: int = 3) -> DataFrame:
        changed = self.nodes.sparkSession.createDataFrame([(n,) for n in node_ids], "node_id string")
        owners = self.nodes.filter("file_id is not null").select(F.col("node_id").alias("node"), F.lit("file").alias("level"), F.col("file_id").alias("owner"))
        loose = self.candidates.join(self.nodes.select(F.col("node_id").alias("src"), F.col("file_id").alias("owner")), "src") if self.candidates is not None else owners.select("owner").limit(0)
        return graph.blast_radius(self._edges(None), changed, depth, owners, loose)

    def diff_impact(self, hunks: DataFrame, depth: int = 3) -> DataFrame:
        """(node, distance) of everything that reaches a definition a hunk (file_id, start, end) touches."""
        defs = self.nodes.filter("start_line is not null").select(F.col("node_id").alias("node"), F.col("file_id").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        touched = structure.diff_impact(defs, hunks.withColumnRenamed("file_id", "file"))
        return graph.reach(self._edges(None), touched, depth, reverse=True).groupBy("node").agg(F.min("distance").alias("distance"))

    def architecture(self, level: str = "repo_id") -> DataFrame:
        """(src, dst, n, worst_band) between the groups a column of ``nodes`` names."""
        a = self.nodes.select(F.col("node_id").alias("src"), F.col(level).alias("a"))
        b = self.nodes.select(F.col("node_id").alias("dst"), F.col(level).alias("b"))
        e = self._edges(None, None).select("src", "dst", "band").join(a, "src").join(b, "dst").filter("a <> b")
        return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"), band_of_rank(F.min(band_rank(F.col("band")))).alias("worst_band"))

    def contract_list(self, kind: str | None = None, key: str | None = None) -> DataFrame:
        c = self.contracts
        c = c if kind is None else c.filter(F.col("kind") == kind)
        return c if key is None else c.filter(F.col("namespace_key") == key)

    def coverage(self) -> DataFrame:
        return self.files.groupBy("language").agg(F.count("*").alias("files"), *(F.count_if(F.col("status") == s).alias(s) for s in ("parsed", "partial", "failed", "skipped")))

    def open_candidates(self, node_id: str) -> DataFrame:
        return self.candidates.filter(F.col("src") == node_id)

    def snippet(self, node_id: str, context: int = 3) -> DataFrame:
        """(node_id, path, first_line, code): a definition's lines with context."""
        n = self.nodes.filter((F.col("node_id") == node_id) & F.col("start_line").isNotNull())
        n = n.join(self.files.select("file_id", "blob_sha", "path"), "file_id").join(self.texts.select("file_id", "blob_sha", "text").dropDuplicates(["file_id", "blob_sha"]), ["file_id", "blob_sha"])
        first = F.greatest(F.lit(1), F.col("start_line") - context)
        lines = F.slice(F.split("text", "\n"), first, F.col("end_line") + context - first + 1)
        return n.select("node_id", "path", first.alias("first_line"), F.array_join(lines, "\n").alias("code"))

    def definition(self, name: str) -> DataFrame:
        """Precise occurrences if there are any, else exact names, labelled by provider."""
        by_name = self.nodes.filter((F.col("qualified_name") == name) | (F.col("name") == name)).select("node_id", F.lit("name_search").alias("provider"))
        if self.occurrences is None:
            return by_name
        precise = self.occurrences.filter((F.col("role") == "definition") & (F.col("symbol") == name)).select("node_id", F.lit("precise").alias("provider"))
        return precise.unionByName(by_name.join(precise.select("node_id"), "node_id", "left_anti"))

    def references(self, name: str) -> DataFrame:
        """Occurrences of a symbol; one row saying the provider is missing where no precise index exists."""
        if self.occurrences is None:
            return self.nodes.sparkSession.createDataFrame([(None, None, "provider_unavailable")], "file_id string, start_byte bigint, provider string")
        return self.occurrences.filter((F.col("role") == "reference") & (F.col("symbol") == name)).select("file_id", "start_byte", F.lit("precise").alias("provider"))

    def implementations(self, node_id: str) -> DataFrame:
        return self.edges.filter((F.col("dst") == node_id) & F.col("kind").isin("IMPLEMENTS", "INHERITS")).select(F.col("src").alias("node_id"), "band")

    def finding_list(self, *, severity: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        f = self.findings
        f = f if severity is None else f.filter(F.col("severity") == severity)
        f = f if kind is None else f.filter(F.col("kind") == kind)
        return analytics.page(f, [F.col("kind"), F.col("scope")], limit, offset)

    def feedback(self, rows: DataFrame) -> DataFrame:
        """Append verdicts (edge_src, edge_dst, verdict); returns verdict counts per band."""
        self._feedback.append(rows)
        every = self._feedback[0]
        for f in self._feedback[1:]:
            every = every.unionByName(f)
        e = self.edges.select(F.col("src").alias("edge_src"), F.col("dst").alias("edge_dst"), "band")
        return every.join(e, ["edge_src", "edge_dst"]).groupBy("band", "verdict").agg(F.count("*").alias("n"))

    def lines(self, file_id: str, first: int, last: int) -> DataFrame:
        return self.texts.filter(F.col("file_id") == file_id).select("file_id", "blob_sha", excerpt(F.col("text"), first, last).alias("lines")).distinct()
