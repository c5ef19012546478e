"""Imports, settlement, layouts and the last operators of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.operators import imports, layout, resolution
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query


def _imports(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(F.col("language").isin(*imports.STATEMENTS)).select("repo_id", "path", "language", "text")
    return imports.statements(s).distinct()


@query()
def res_imports(spark: SparkSession, d: str) -> DataFrame:
    """Every import statement with what it can mean inside its repository."""
    f = table(spark, d, "sources").select("repo_id", "path").distinct()
    out = imports.interpreted(_imports(spark, d), f)
    return out.select("repo_id", "path", "language", "module", "decision", F.coalesce(F.size("places"), F.lit(0)).alias("places"))


@query(r"WITH i AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(text, '(?m)^\s*import\s+(?:static\s+)?([\w.]+)', 1)) AS module FROM sources WHERE language = 'java'), f AS (SELECT DISTINCT repo_id, path FROM sources) SELECT i.repo_id, i.path, i.module, CASE WHEN f.path IS NULL THEN 'external' ELSE 'internal' END AS decision FROM i LEFT JOIN f ON f.repo_id = i.repo_id AND f.path = replace(i.module, '.', '/') || '.java'")
def res_java_imports(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sources").select("repo_id", "path").distinct()
    return imports.interpreted(_imports(spark, d).filter("language = 'java'"), f).select("repo_id", "path", "module", "decision")


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderpriority LIKE '1%' AND o_custkey % 7 = 0 THEN 'external' WHEN o_orderpriority LIKE '2%' THEN 'typed' WHEN o_custkey % 11 = 0 THEN 'blocked' WHEN o_custkey % 13 = 0 THEN 'external' WHEN o_orderpriority LIKE '3%' THEN 'exact' WHEN o_totalprice > 200000 THEN 'candidate' ELSE 'unresolved' END AS band, count(*) AS sites FROM orders GROUP BY 1")
def res_settlement(spark: SparkSession, d: str) -> DataFrame:
    """Precedence of what is known about a site, over made-up flags of orders."""
    p = F.col("o_orderpriority")
    flags = {
        "blocked": F.col("o_orderstatus") == "P", "engine_external": p.startswith("1") & (F.col("o_custkey") % 7 == 0), "typed": p.startswith("2"), "local": F.col("o_custkey") % 11 == 0,
        "external_import": F.col("o_custkey") % 13 == 0, "has_candidates": F.col("o_totalprice") > 200000,
    }
    band = resolution.settlement(flags, F.when(p.startswith("3"), "exact"))
    return table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("sites"))


_EV = "c AS (SELECT DISTINCT l_partkey AS site, l_suppkey AS candidate FROM lineitem)"


@query(f"WITH {_EV}, e AS (SELECT site, candidate, s_nationkey = p_size % 25 AS e1, s_suppkey % 10 = p_partkey % 10 AS e2, p_brand LIKE '%5' AS blocked FROM c JOIN supplier ON s_suppkey = candidate JOIN part ON p_partkey = site), n AS (SELECT site, count(DISTINCT candidate) AS n, max(CAST(blocked AS INT)) AS b, sum(CAST(e1 AS INT)) AS n1 FROM e GROUP BY 1), a AS (SELECT e.*, n.n, n.b, n.n1, CASE WHEN n1 > 0 THEN e1 ELSE true END AS i1 FROM e JOIN n USING (site)), m AS (SELECT site, n, b, n1, sum(CAST(i1 AND e2 AS INT)) AS n2 FROM a GROUP BY ALL) SELECT CASE WHEN n = 1 THEN 'exact' WHEN b = 1 THEN 'blocked' WHEN n1 = 1 THEN 'same_file' WHEN n2 = 1 THEN 'same_folder' ELSE 'ambiguous' END AS stage, count(*) AS sites FROM m GROUP BY 1")
def res_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The first-generation resolver's scopes; blocked names are stopped only when ambiguous."""
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("candidate")).distinct()
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    e = c.join(s, c.candidate == s.s_suppkey).join(p, c.site == p.p_partkey).select("site", "candidate", (F.col("s_nationkey") == F.col("p_size") % 25).alias("e1"), (F.col("s_suppkey") % 10 == F.col("p_partkey") % 10).alias("e2"), F.col("p_brand").endswith("5").alias("blocked"))
    return imports.scoped_resolution(e, "site", "candidate", [("e1", "same_file"), ("e2", "same_folder")], "blocked").groupBy("stage").agg(F.count("*").alias("sites"))


@query("SELECT band, count(*) AS sites, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT " + facts._BAND_SQL + " AS band FROM lineitem) GROUP BY 1")
def agg_resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(facts.band_expr().alias("band")).agg(F.count("*").alias("sites"))
    return g.select("band", "sites", F.round(100 * F.col("sites") / F.sum("sites").over(Window.partitionBy()), 6).alias("percent"))  # one row per band


@query(ctes("call_edges", "band_rank") + ", e AS (SELECT s_nationkey % 4 AS from_role, p_size % 5 AS to_role, weight, rank FROM call_edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst JOIN band_rank USING (band) WHERE rank >= 5), g AS (SELECT from_role, to_role, CAST(sum(weight) AS BIGINT) AS n, min(rank) AS r FROM e GROUP BY ALL) SELECT from_role, to_role, n, band AS worst_band FROM g JOIN band_rank ON rank = r")
def agg_layer_depends(spark: SparkSession, d: str) -> DataFrame:
    """Drawn calls between roles with the weakest band among them."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") % 4).alias("from_role"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") % 5).alias("to_role"))
    e = facts.call_edges(spark, d).filter(V.is_drawn(F.col("band"))).join(s, "src").join(p, "dst")
    return e.groupBy("from_role", "to_role").agg(F.sum("weight").alias("n"), V.band_of_rank(F.min(V.band_rank(F.col("band")))).alias("worst_band"))


@query("WITH c AS (SELECT DISTINCT l_suppkey % 50 AS caller, p_name AS callee FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT lower(p_name) AS name, p_brand AS module FROM part WHERE p_size < 6) SELECT caller, coalesce(module, '(unresolved)') AS module, count(DISTINCT callee) AS names FROM c LEFT JOIN s ON lower(callee) = name WHERE module IS NULL OR module NOT LIKE '%1' GROUP BY ALL")
def join_subsystem_imports(spark: SparkSession, d: str) -> DataFrame:
    """Callee names by the module that defines them; what nothing defines stays, as unresolved."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    c = li.join(p, li.l_partkey == p.p_partkey).select((F.col("l_suppkey") % 50).alias("caller"), F.col("p_name").alias("callee")).distinct()
    s = p.filter("p_size < 6").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("module")).distinct()
    j = c.join(s, F.lower("callee") == F.col("name"), "left").filter(F.col("module").isNull() | ~F.col("module").endswith("1"))
    return j.groupBy("caller", F.coalesce("module", F.lit("(unresolved)")).alias("module")).agg(F.count_distinct("callee").alias("names"))


@query(ctes("sym_edges") + ", o AS (SELECT src AS node, count(*) AS d FROM sym_edges GROUP BY 1), t AS (SELECT node, d, CASE WHEN p_size = 5 THEN 0 ELSE 1 END AS tier FROM o JOIN part ON p_partkey = node WHERE p_size = 5 OR node NOT IN (SELECT dst FROM sym_edges)) SELECT node, tier, row_number() OVER (ORDER BY tier, d DESC, node) AS position FROM t QUALIFY position <= 6")
def top_flow_roots(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints first, else callers nobody calls, by what they call."""
    e = facts.sym_edges(spark, d)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    t = out.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size"), "node")
    lone = t.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").filter("p_size <> 5")
    tiers = t.filter("p_size = 5").withColumn("tier", F.lit(0)).unionByName(lone.withColumn("tier", F.lit(1)))
    six = tiers.orderBy("tier", F.col("d").desc(), "node").limit(6)
    return six.select("node", "tier", F.row_number().over(Window.orderBy("tier", F.col("d").desc(), "node")).alias("position"))


@query("SELECT o_orderpriority AS repository, round(median(o_totalprice), 6) AS median_time, max(o_totalprice) AS peak, count(*) AS samples FROM orders GROUP BY 1")
def agg_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median of samples and greatest peak per repository."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("repository")).agg(F.round(F.percentile("o_totalprice", 0.5), 6).alias("median_time"), F.max("o_totalprice").alias("peak"), F.count("*").alias("samples"))


@query(ctes("latest", "g_nodes", recursive=True) + ", e AS (SELECT n.repo_id AS g, n.node_id AS id, p.node_id AS parent, CAST(n.kind IN ('Method', 'Function') AS INT) AS b, CAST(n.kind IN ('Folder', 'Class') AS INT) AS l FROM g_nodes n LEFT JOIN g_nodes p ON p.repo_id = n.repo_id AND p.node_id = n.parent_id), t AS (SELECT g, id, b, b AS around, l AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.g, e.id, e.b, t.around + e.b, t.depth + e.l FROM t JOIN e ON e.g = t.g AND e.parent = t.id) SELECT g AS repo_id, CAST(1 + sum(b) AS BIGINT) AS cyclomatic, CAST(sum(b * around) AS BIGINT) AS cognitive, CAST(max(depth) AS INT) AS loop_depth FROM t GROUP BY 1")
def agg_tree_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Branching, nesting and loop depth, counted over containment trees as over syntax trees."""
    from graphloom.operators import hierarchy

    n = facts.latest_graph(spark, d, "kind", "parent_id")
    tree = hierarchy.forest(n, group="repo_id", node="node_id", parent="parent_id")
    ok = hierarchy.roots_and_depths(tree).filter("depth >= 0").select("g", "id")
    ast = tree.join(ok, ["g", "id"], "left_semi").join(n.select(F.col("repo_id").alias("g"), F.col("node_id").alias("id"), F.col("kind").alias("type")), ["g", "id"]).select("g", "id", "p", "type")
    return layout.complexity(ast, ["Method", "Function"], ["Folder", "Class"]).withColumnRenamed("g", "repo_id")


@query(ctes("call_edges") + ", g AS (SELECT dst AS node, sum(weight) AS n FROM call_edges GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, node) AS k, count(*) OVER () AS total FROM g) SELECT node, CAST(n AS BIGINT) AS n, total > 300 AS truncated FROM r WHERE k <= 300")
def top_level_of_detail(spark: SparkSession, d: str) -> DataFrame:
    """A layer's view cut to its budget, with the fact that it was cut."""
    g = facts.call_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("n"))
    rows, meta = layout.level_of_detail(g, "layer", [F.col("n").desc(), F.col("node")])
    return rows.withColumn("truncated", F.lit(meta.first()["truncated"]))


@query(ctes("sym_edges") + ", d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM sym_edges UNION ALL SELECT dst FROM sym_edges) GROUP BY 1), n AS (SELECT p_partkey AS node, p_size = 1 AS entry, p_brand LIKE '%1' AS test, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON node = p_partkey) SELECT row_number() OVER (ORDER BY test, entry DESC, degree DESC, node) AS position, node, CASE WHEN entry THEN 'entry point' ELSE 'central' END AS why FROM n QUALIFY position <= 7")
def top_tour(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") == 1).alias("entry"), F.col("p_brand").endswith("1").alias("test"))
    return layout.tour(p, facts.sym_edges(spark, d))


@query()
def gr_treemap(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each brand as a squarified treemap."""
    return layout.treemap(table(spark, d, "part"), "p_brand", "p_partkey", "p_size")


@query(ctes("latest", "g_files") + ", f AS (SELECT repo_id, regexp_replace(path, '(^|/)[^/]*$', '') AS root, regexp_extract(path, '[^/]*$') AS name FROM g_files), r AS (SELECT repo_id, root, CASE WHEN name = 'component.yaml' THEN 0 WHEN lower(name) = 'dockerfile' THEN 1 WHEN regexp_matches(name, '^(main\\.(go|rs|py)|__main__\\.py|index\\.[jt]s)$') THEN 2 WHEN name IN ('package.json', 'Cargo.toml', 'go.mod', 'pom.xml', 'pyproject.toml') THEN 3 END AS rank FROM f) SELECT repo_id, root, ['explicit', 'dockerfile', 'entry', 'library'][min(rank) + 1] AS evidence FROM r WHERE rank IS NOT NULL GROUP BY ALL")
def gr_components_detected(spark: SparkSession, d: str) -> DataFrame:
    return layout.components(facts.latest_files(spark, d))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def flt_view_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A view's nodes: by type, by size, and by membership in any chosen layer."""
    layers = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 1000)).join(layers, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def snk_event_retention(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last week before the newest."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts")).first()[0]
    return e.filter(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 7 DAYS")).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("WITH p AS (SELECT c_nationkey, c_custkey, length(c_name) AS n FROM customer), r AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS used FROM p) SELECT c_nationkey, CAST((used - 1) // 200 AS BIGINT) AS pack, count(*) AS items FROM r GROUP BY ALL")
def sec_packing(spark: SparkSession, d: str) -> DataFrame:
    """Items packed in order into packs of about 200 characters."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "customer").withColumn("used", F.sum(F.length("c_name")).over(w))
    return c.groupBy("c_nationkey", F.floor((F.col("used") - 1) / 200).cast("bigint").alias("pack")).agg(F.count("*").alias("items"))


@query("WITH d AS (SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_size < 10 GROUP BY 1), r AS (SELECT p_partkey, lower(p_name) AS name FROM part WHERE p_size >= 40) SELECT r.p_partkey AS src, CASE WHEN n = 1 THEN target END AS dst, n AS candidates FROM r JOIN d USING (name)")
def sec_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    """References by name: drawn when one definition has it, counted when several do."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.lower("p_name").alias("name"))
    defs = p.filter("p_size < 10").groupBy("name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("target"))
    return p.filter("p_size >= 40").join(defs, "name").select(F.col("p_partkey").alias("src"), F.when(F.col("n") == 1, F.col("target")).alias("dst"), F.col("n").alias("candidates"))
