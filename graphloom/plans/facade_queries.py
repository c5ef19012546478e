"""The facade's tools over the driver's tables, and the last operators that only tests reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.api import Estate
from graphloom.operators import graph, segments, structure
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query
from graphloom.plans.shared import materialise, shared_dir


def estate(spark: SparkSession, d: str) -> Estate:
    """Latest nodes and files; each node is called by its parent, in a band its line decides."""
    n = materialise(facts.latest_graph(spark, d, "kind", "name", "qualified_name", "doc", "parent_id", "file_id", "start_line", "end_line", "layer_role"), "nodes")
    band = F.when(F.col("start_line") % 3 == 0, "exact").when(F.col("start_line") % 3 == 1, "typed").otherwise("candidate")
    e = n.filter("parent_id is not null and start_line is not null").select("repo_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("CALLS").alias("kind"), band.alias("band"))
    r = table(spark, d, "reference").filter("category = 'typed'").select(F.col("callee").alias("symbol"), F.lit("reference").alias("role"), F.concat_ws("/", "corpus", "file").alias("file_id"), "start_byte", F.lit(None).cast("string").alias("node_id"))
    c = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "ApiContract").otherwise("Channel").alias("kind"), F.concat(F.lit("k"), (F.col("s_suppkey") % 10).cast("string")).alias("namespace_key"), "s_name")
    f = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "error").otherwise("warning").alias("severity"), F.col("p_brand").alias("kind"), F.col("p_name").alias("scope"), "p_partkey")
    return Estate(n, e, facts.latest_files(spark, d), texts=table(spark, d, "sources").select("file_id", "blob_sha", "text"), occurrences=r, contracts=c, findings=f)


_CALLS = "e AS (SELECT repo_id, parent_id AS src, node_id AS dst, CASE start_line % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'typed' ELSE 'candidate' END AS band FROM g_nodes WHERE parent_id IS NOT NULL AND start_line IS NOT NULL)"
_ASKED = "(SELECT min(node_id) FROM g_nodes WHERE kind = 'Method' AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_id IN (SELECT f.file_id FROM g_files f JOIN sources s ON s.file_id = f.file_id AND s.blob_sha = f.blob_sha WHERE s.text IS NOT NULL))"


def _asked(e: Estate) -> str:
    read = e.files.join(e.texts.filter("text is not null").select("file_id", "blob_sha").distinct(), ["file_id", "blob_sha"], "left_semi").select("file_id")
    return e.nodes.filter("kind = 'Method' and start_line is not null and end_line is not null").join(read, "file_id", "left_semi").agg(F.min("node_id")).first()[0]


@query(ctes("latest", "g_nodes", "g_files", recursive=True) + f", a AS (SELECT node_id, parent_id, 0 AS distance FROM g_nodes WHERE node_id = {_ASKED} UNION SELECT n.node_id, n.parent_id, a.distance + 1 FROM a JOIN g_nodes n ON n.node_id = a.parent_id) SELECT a.node_id, distance, kind, name, qualified_name FROM a JOIN g_nodes USING (node_id)")
def sec_symbol(spark: SparkSession, d: str) -> DataFrame:
    """A node with all its parents."""
    e = estate(spark, d)
    return e.symbol(_asked(e))


@query(ctes("latest", "g_nodes", "g_files") + f" SELECT DISTINCT n.node_id, f.path, greatest(1, n.start_line - 2) AS first_line, array_to_string(string_split(s.text, chr(10))[greatest(1, n.start_line - 2):n.end_line + 2], chr(10)) AS code FROM g_nodes n JOIN g_files f ON f.file_id = n.file_id JOIN sources s ON s.file_id = f.file_id AND s.blob_sha = f.blob_sha WHERE n.node_id = {_ASKED}")
def sec_snippet(spark: SparkSession, d: str) -> DataFrame:
    """A definition's lines with two around them."""
    e = estate(spark, d)
    return e.snippet(_asked(e), 2)


@query("SELECT corpus || '/' || file AS file_id, start_byte, 'precise' AS provider FROM reference WHERE category = 'typed' AND callee = (SELECT max(callee) FROM reference WHERE category = 'typed')")
def sec_references(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence that refers to a symbol."""
    e = estate(spark, d)
    return e.references(e.occurrences.agg(F.max("symbol")).first()[0])


@query(ctes("latest", "g_nodes", "band_rank") + f", {_CALLS}, x AS (SELECT a.layer_role AS src, b.layer_role AS dst, count(*) AS n, min(r.rank) AS rank FROM e JOIN g_nodes a ON a.node_id = e.src JOIN g_nodes b ON b.node_id = e.dst JOIN band_rank r USING (band) WHERE band <> 'candidate' AND a.layer_role <> b.layer_role GROUP BY ALL) SELECT src, dst, n, band AS worst_band FROM x JOIN band_rank USING (rank)")
def sec_architecture_level(spark: SparkSession, d: str) -> DataFrame:
    """Calls between layer roles with the weakest band of each."""
    return estate(spark, d).architecture("layer_role")


@query(ctes("latest", "g_nodes") + f", {_CALLS} SELECT band, CASE WHEN dst < 'G' THEN 'correct' ELSE 'wrong' END AS verdict, count(*) AS n FROM e GROUP BY ALL")
def sec_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on edges, counted by band."""
    e = estate(spark, d)
    return e.feedback(e.edges.select(F.col("src").alias("edge_src"), F.col("dst").alias("edge_dst"), F.when(F.col("dst") < "G", "correct").otherwise("wrong").alias("verdict")))


@query("SELECT severity, kind, scope, p_partkey FROM (SELECT 'error' AS severity, p_brand AS kind, p_name AS scope, p_partkey FROM part WHERE p_size % 2 = 0 AND p_brand = 'Brand#11') ORDER BY kind, scope, p_partkey LIMIT 40")
def sec_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first findings of one severity and kind."""
    e = estate(spark, d)
    e.findings = e.findings.withColumn("scope", F.struct("scope", "p_partkey"))
    return e.finding_list(severity="error", kind="Brand#11", limit=40)[0].select("severity", "kind", "scope.scope", "scope.p_partkey")


@query("SELECT 'Channel' AS kind, 'k3' AS namespace_key, s_name FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 10 = 3")
def flt_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of one kind and key."""
    return estate(spark, d).contract_list("Channel", "k3")


@query("WITH m AS (SELECT unnest(['commit_sha', 'engine_version', 'profile', 'repo_id', 'repo_id', 'odd', 'repo_url']) AS key, unnest(['a', 'b', ' ', 'c', 'c', 'd', 'e']) AS value) SELECT 'missing' AS defect, unnest(['language_matrix_version', 'tool_version', 'precise_sources', 'repo_id_source', 'schema_version']) AS key UNION ALL VALUES ('blank', 'profile'), ('repeated', 'repo_id'), ('unknown', 'odd')")
def snk_meta_defects(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a segment's meta table."""
    rows = list(zip(["commit_sha", "engine_version", "profile", "repo_id", "repo_id", "odd", "repo_url"], ["a", "b", " ", "c", "c", "d", "e"]))
    return segments.meta_defects(spark.createDataFrame(rows, "key string, value string"))


@query("WITH p AS (SELECT p_brand, p_size FROM part), c AS (SELECT DISTINCT 'Brand#' || (s_nationkey + 11) AS p_brand, s_suppkey % 50 AS p_size FROM supplier) SELECT 'hit' AS outcome, count(*) AS n FROM p JOIN c USING (p_brand, p_size) UNION ALL SELECT 'miss', count(*) FROM p ANTI JOIN c USING (p_brand, p_size)")
def snk_cache(spark: SparkSession, d: str) -> DataFrame:
    """Facts found in a cache under their whole key, and those to be made."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 11).cast("string")).alias("p_brand"), (F.col("s_suppkey") % 50).alias("p_size")).distinct()
    hits, misses = segments.cached(table(spark, d, "part").select("p_brand", "p_size"), s, ["p_brand", "p_size"])
    n = lambda df, outcome: df.agg(F.count("*").alias("n")).select(F.lit(outcome).alias("outcome"), "n")
    return n(hits, "hit").unionByName(n(misses, "miss"))


@query("SELECT p_brand, count(*) AS parts, min(p_partkey) AS first FROM part GROUP BY 1")
def snk_segment(spark: SparkSession, d: str) -> DataFrame:
    """A segment written in identity order, opened again with its checks."""
    import uuid

    path = f"{shared_dir(spark)}/segment-{uuid.uuid4().hex}"
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    checksum = segments.write_segment(p, path, ["p_partkey"]).first()["checksum"]
    meta = spark.createDataFrame([(k, "v") for k in segments.META_KEYS], "key string, value string")
    again = segments.open_segment(spark, path, "p_partkey bigint, p_brand string", ["p_partkey"], checksum, meta)
    return again.groupBy("p_brand").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS child, s_suppkey - 1 - s_suppkey % 7 AS parent FROM supplier WHERE s_suppkey > 8 UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey > 8), r AS (SELECT s_suppkey AS node, s_suppkey AS ancestor, 0 AS level FROM supplier UNION SELECT r.node, e.parent, r.level + 1 FROM r JOIN e ON e.child = r.ancestor), v AS (SELECT s_suppkey AS ancestor FROM supplier WHERE s_suppkey % 6 = 0), m AS (SELECT node, ancestor, min(level) AS level FROM r SEMI JOIN v USING (ancestor) GROUP BY ALL) SELECT node, ancestor AS shown FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY level, ancestor) = 1")
def gr_nearest_visible(spark: SparkSession, d: str) -> DataFrame:
    """Each node's nearest visible ancestor, itself included, among several parents."""
    from graphloom.plans.code_queries import supplier_parents

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.nearest_visible(supplier_parents(spark, d), s.filter("node % 6 = 0"), s)


@query("SELECT s_suppkey AS segment FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey % 90 FROM customer WHERE c_nationkey < 20)")
def snk_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """Segments that no kept manifest names."""
    kept = table(spark, d, "customer").filter("c_nationkey < 20").select((F.col("c_custkey") % 90).alias("segment")).distinct()
    return segments.unreferenced(table(spark, d, "supplier").select(F.col("s_suppkey").alias("segment")), kept)


@query("WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0) SELECT 'nodes' AS what, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM k WHERE p_partkey % 2 = 0")
def gr_routes(spark: SparkSession, d: str) -> DataFrame:
    """Route nodes of annotated endpoints, and the edges from those handlers that are known."""
    from graphloom.plans.code_queries import con_annotated_endpoints

    e = materialise(con_annotated_endpoints(spark, d), "endpoints")
    h = e.filter("int(substring(path, 2)) % 2 = 0").select("path", "key", F.concat(F.lit("n"), "path").alias("node_id"))
    nodes, edges = structure.routes(e, h, "r")
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(nodes.select("node_id").distinct(), "nodes").unionByName(n(edges, "edges"))


@query("WITH d AS (SELECT DISTINCT path FROM sources), f AS (SELECT DISTINCT path FROM files WHERE language IN ('python', 'go', 'java')) SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d SEMI JOIN f USING (path)) AS mapped, (SELECT count(*) FROM d SEMI JOIN f USING (path)) >= 0.5 * (SELECT count(*) FROM d) AS accepted")
def gr_mapped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whether enough of a provider's documents are files of the index."""
    return structure.mapped_documents(table(spark, d, "sources"), table(spark, d, "files").filter("language in ('python', 'go', 'java')"))


@query("WITH m AS (SELECT p_partkey AS site, CASE p_partkey % 5 WHEN 0 THEN 'kept' WHEN 1 THEN 'insert' WHEN 2 THEN 'conflict' WHEN 3 THEN 'upgrade' ELSE 'contradict' END AS outcome FROM part) SELECT l_partkey AS site, l_suppkey AS candidate FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN m ON site = l_partkey WHERE outcome IN ('kept', 'conflict')")
def gr_left_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that stay after a precise merge."""
    k = (F.col("p_partkey") % 5 + 1).cast("int")
    m = table(spark, d, "part").select(F.col("p_partkey").alias("site"), F.element_at(F.array(*map(F.lit, ("kept", "insert", "conflict", "upgrade", "contradict"))), k).alias("outcome"))
    return structure.merged_candidates(table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("candidate")).distinct(), m)
