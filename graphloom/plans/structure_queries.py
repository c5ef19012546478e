"""Derived structure and the smaller operators of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.vocab import PATH_ROLES, path_role
from graphloom.operators import graph, intervals
from graphloom.operators import structure as S
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query


@query(ctes("latest", "g_files") + ", f AS (SELECT DISTINCT repo_id, path, string_split(path, '/') AS p FROM g_files), x AS (SELECT repo_id, p, unnest(generate_series(1, len(p) - 1)) AS k FROM f WHERE len(p) > 1) SELECT repo_id, path AS child, array_to_string(p[1:len(p) - 1], '/') AS parent, 'File' AS kind FROM f UNION ALL SELECT DISTINCT repo_id, array_to_string(p[1:k], '/'), array_to_string(p[1:k - 1], '/'), 'Folder' FROM x")
def gr_containment(spark: SparkSession, d: str) -> DataFrame:
    return S.containment(facts.latest_files(spark, d))


@query(ctes("latest", "g_files") + ", f AS (SELECT repo_id, language, path, string_split(path, '/') AS p FROM g_files), g AS (SELECT repo_id, language, count(*) AS files, max(len(p)) AS deep FROM f GROUP BY ALL), k AS (SELECT f.repo_id, f.language, unnest(generate_series(1, 40)) AS k, f.p FROM f), c AS (SELECT repo_id, language, k, count(DISTINCT array_to_string(p[1:k], '/')) AS folders, min(len(p) - 1) AS room, min(array_to_string(p[1:k], '/')) AS folder FROM k GROUP BY ALL) SELECT g.repo_id, g.language, g.files, coalesce((SELECT folder FROM c WHERE c.repo_id = g.repo_id AND c.language = g.language AND folders = 1 AND k <= room ORDER BY k DESC LIMIT 1), '') AS folder FROM g")
def gr_common_folder(spark: SparkSession, d: str) -> DataFrame:
    """The deepest folder holding all files of a language in a repository."""
    return S.common_folder(facts.latest_files(spark, d), ["repo_id", "language"], "path")


_T = " OR ".join(f"(language = '{lang}' AND regexp_matches(path, '{p}'))" for lang, p in S.TEST_FILES.items())
_TEST = f"(regexp_matches(path, '(^|/)tests?/') OR {_T})"


@query(ctes("latest", "g_files") + f" SELECT repo_id, file_id, coalesce({_TEST}, false) AS is_test FROM g_files")
def gr_test_files(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_files(spark, d).select("repo_id", "file_id", S.is_test_path(F.col("language"), F.col("path")).alias("is_test"))


_ROLE = "CASE " + " ".join(f"WHEN list_has_any(string_split(lower(path), '/')[1:len(string_split(path, '/')) - 1], {words}) THEN '{role}'" for role, words in PATH_ROLES.items()) + " END"


@query(ctes("latest", "g_files") + f" SELECT repo_id, file_id, coalesce({_ROLE}, CASE WHEN {_TEST} THEN 'test' END, 'unknown') AS role FROM g_files")
def gr_file_roles(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return facts.latest_files(spark, d).select("repo_id", "file_id", S.layer_role(none, none, F.col("path"), S.is_test_path(F.col("language"), F.col("path"))).alias("role"))


@query(ctes("latest", "g_files") + f", r AS (SELECT repo_id, language, coalesce({_ROLE}, 'none') AS role FROM g_files) SELECT repo_id, language, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'unknown' END AS role FROM r GROUP BY ALL")
def gr_agreed_roles(spark: SparkSession, d: str) -> DataFrame:
    """Files that disagree leave their group unknown."""
    f = facts.latest_files(spark, d).withColumn("role", F.coalesce(path_role(F.col("path")), F.lit("none")))
    return S.agreed_role(f, ["repo_id", "language"], "role")


@query(ctes("latest", "g_nodes", "g_files") + " SELECT n.repo_id, n.node_id FROM g_nodes n JOIN g_files f ON n.repo_id = f.repo_id AND n.file_id = f.file_id WHERE (n.kind IN ('Function', 'Method') AND n.name IN ('main', 'Main', '__main__')) OR (regexp_matches(f.path, '(^|/)(__main__\\.py|main\\.(go|rs|py)|index\\.[jt]s)$') AND n.kind = 'File')")
def gr_entry_points(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "kind", "name", "file_id").join(facts.latest_files(spark, d).select("repo_id", "file_id", "path"), ["repo_id", "file_id"])
    return n.filter(S.entry_point(F.col("kind"), F.col("name"), F.col("path"))).select("repo_id", "node_id")


@query("SELECT outcome, count(*) AS sites FROM (SELECT CASE WHEN band IN ('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped') THEN 'edge' WHEN band = 'candidate' THEN 'several candidates' ELSE 'nothing found' END AS outcome FROM (SELECT " + facts._BAND_SQL + " AS band FROM lineitem)) GROUP BY 1")
def gr_materialised(spark: SparkSession, d: str) -> DataFrame:
    """Every site becomes one edge or one candidate row."""
    li = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("site"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("target"), facts.band_expr().alias("band"))
    edges, candidates = S.materialised(li)
    return edges.select(F.lit("edge").alias("outcome")).unionByName(candidates.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("sites"))


@query(ctes("call_edges") + " SELECT src, dst, band, weight, 'TESTS' AS kind FROM call_edges JOIN supplier ON s_suppkey = src WHERE s_acctbal < 0 AND band IN ('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped')")
def gr_test_edges(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return S.test_edges(facts.call_edges(spark, d), tests).select("src", "dst", "band", "weight", "kind")


_OPENED = "".join(
    f""", c{k} AS (SELECT *, array_to_string(p[1:least(depth, len(p) - 1)], '/') AS c FROM s{k}), h{k} AS (SELECT repo_id, c FROM c{k} JOIN (SELECT repo_id, count(*) AS total FROM c{k} GROUP BY 1) USING (repo_id) GROUP BY repo_id, c HAVING count(*) > 0.7 * max(total) AND max(len(p) - 1 - depth) > 0),
s{k + 1} AS (SELECT c{k}.repo_id, p, depth + CASE WHEN h{k}.c IS NULL THEN 0 ELSE 1 END AS depth FROM c{k} LEFT JOIN h{k} ON h{k}.repo_id = c{k}.repo_id AND h{k}.c = c{k}.c)""" for k in range(10))


@query(ctes("latest", "g_files") + ", s0 AS (SELECT repo_id, string_split(path, '/') AS p, 1 AS depth FROM g_files)" + _OPENED + " SELECT repo_id, array_to_string(p[1:least(depth, len(p) - 1)], '/') AS container, count(*) AS members FROM s10 GROUP BY ALL")
def gr_containers(spark: SparkSession, d: str) -> DataFrame:
    """Folders as containers, overfull ones opened level by level."""
    return S.containers(facts.latest_files(spark, d), ["repo_id"], "path")


@query(ctes("sym_edges", recursive=True) + ", o AS (SELECT p_partkey AS root FROM part WHERE p_size = 4), r AS (SELECT root, root AS node, 0 AS distance FROM o UNION SELECT r.root, e.dst, r.distance + 1 FROM r JOIN sym_edges e ON e.src = r.node WHERE r.distance < 4), m AS (SELECT root, node, min(distance) AS distance FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY distance, node) AS position FROM m QUALIFY position <= 12) SELECT root, node, distance, position, round(position / (count(*) OVER (PARTITION BY root) + 1), 6) AS weight FROM k")
def gr_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flow steps from each root: at most twelve, four deep, weighted by position."""
    out = S.flow_steps(facts.sym_edges(spark, d), table(spark, d, "part").filter("p_size = 4").select("p_partkey"))
    return out.select("root", "node", "distance", "position", F.round("weight", 6).alias("weight"))


@query(ctes("call_edges") + ", e AS (SELECT src, dst, s_nationkey AS a, p_size % 25 AS b FROM call_edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst) SELECT DISTINCT 'out' AS side, src AS node FROM e WHERE a <> b UNION ALL SELECT DISTINCT 'in', dst FROM e WHERE a <> b")
def gr_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with an edge into or out of another layer."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("a"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") % 25).alias("b"))
    e = facts.call_edges(spark, d).join(s, "src").join(p, "dst").filter("a <> b")
    return e.select(F.lit("out").alias("side"), F.col("src").alias("node")).distinct().unionByName(e.select(F.lit("in").alias("side"), F.col("dst").alias("node")).distinct())


_V = "v AS (SELECT DISTINCT corpus || ':' || file || ':' || start_byte || ':' || end_byte AS site, corpus || ':' || file AS file, start_byte AS s, end_byte AS e, split_part(callee, '.', -1) AS target FROM vendored WHERE category = 'typed' AND start_byte < end_byte QUALIFY row_number() OVER (PARTITION BY corpus, file, start_byte, end_byte ORDER BY emitted_at DESC, callee DESC) = 1), r AS (SELECT DISTINCT corpus || ':' || file AS file, start_byte AS s, end_byte AS e, split_part(callee, '.', -1) AS target FROM reference WHERE category = 'typed' AND start_byte < end_byte)"


@query(f"WITH {_V}, h AS (SELECT v.site, count(DISTINCT r.target) AS n, min(r.target) AS now, max(v.target) AS was FROM v JOIN r ON v.file = r.file AND v.s < r.e AND r.s < v.e GROUP BY 1), o AS (SELECT site, CASE WHEN n > 1 THEN 'conflict' WHEN was IS NULL THEN 'insert' WHEN was = now THEN 'upgrade' ELSE 'contradict' END AS outcome FROM h) SELECT coalesce(o.outcome, 'kept') AS outcome, count(*) AS sites FROM v LEFT JOIN o USING (site) GROUP BY 1")
def gr_precise_merge(spark: SparkSession, d: str) -> DataFrame:
    """One engine's call sites corrected by the other's occurrences, by overlap of byte ranges."""
    tail = F.element_at(F.split("callee", r"\."), -1)
    file = F.concat_ws(":", "corpus", "file")
    v = table(spark, d, "vendored").filter("category = 'typed' and start_byte < end_byte")
    v = graph.first_by(v, ["corpus", "file", "start_byte", "end_byte"], [F.col("emitted_at").desc(), F.col("callee").desc()])
    sites = v.select(F.concat_ws(":", "corpus", "file", "start_byte", "end_byte").alias("site"), file.alias("file"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.lit("typed").alias("band"), tail.alias("target"))
    occ = table(spark, d, "reference").filter("category = 'typed' and start_byte < end_byte").select(file.alias("file"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), tail.alias("target")).distinct()
    return S.precise_merge(sites, occ).groupBy("outcome").agg(F.count("*").alias("sites"))


@query(ctes("latest", "g_nodes") + " SELECT DISTINCT n.repo_id, n.node_id FROM g_nodes n WHERE n.kind IN ('Function', 'Method') AND n.start_line <= 30 AND n.end_line >= 20")
def gr_diff_impact(spark: SparkSession, d: str) -> DataFrame:
    """Callables whose lines meet lines 20 to 30 of their file, as a diff hunk over every file would."""
    n = facts.latest_graph(spark, d, "kind", "file_id", "start_line", "end_line").filter(F.col("kind").isin("Function", "Method") & F.col("start_line").isNotNull())
    defs = n.select(F.struct("repo_id", "node_id").alias("node"), F.concat_ws("/", "repo_id", "file_id").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    hunks = defs.select("file").distinct().select("file", F.lit(20).alias("start"), F.lit(30).alias("end"))
    return S.diff_impact(defs, hunks).select("node.repo_id", "node.node_id")


@query("WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R') SELECT coalesce(a.src, o.src) AS src, coalesce(a.dst, o.dst) AS dst, CASE WHEN a.src IS NULL THEN 'topology.observed_not_declared' WHEN o.src IS NULL THEN 'topology.declared_not_observed' ELSE 'observed' END AS finding FROM a FULL JOIN o ON a.src = o.src AND a.dst = o.dst")
def an_topology(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "src", "l_partkey": "dst"})
    return S.topology(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"))


@query("SELECT p_brand, count(*) AS members, CASE WHEN count(*) FILTER (WHERE p_size > 40) > count(*) * 0.3 THEN 'complex' WHEN count(*) FILTER (WHERE p_size BETWEEN 21 AND 40) > count(*) * 0.3 THEN 'moderate' ELSE 'simple' END AS complexity FROM part GROUP BY 1")
def agg_layer_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("complexity", F.when(F.col("p_size") > 40, "complex").when(F.col("p_size") > 20, "moderate").otherwise("simple"))
    return S.layer_stats(p, "p_brand", "complexity")


@query(ctes("latest", "g_nodes") + " SELECT repo_id, kind, count(*) AS nodes FROM g_nodes GROUP BY ALL")
def agg_golden_kinds(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_graph(spark, d, "kind").groupBy("repo_id", "kind").agg(F.count("*").alias("nodes"))


@query(ctes("latest", "g_files") + " SELECT repo_id, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages, count(*) AS files FROM g_files GROUP BY 1")
def sec_languages(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_files(spark, d).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count("*").alias("files"))


@query(ctes("latest", "g_nodes") + " SELECT repo_id, parent_id AS node_id, count(*) AS folded, array_to_string(list_sort(list(name))[1:5], ',') AS first_names FROM g_nodes WHERE kind = 'ConfigKey' AND parent_id IS NOT NULL GROUP BY ALL")
def sec_folded(spark: SparkSession, d: str) -> DataFrame:
    """Small children folded into their parents; a parent's children are bounded by its file."""
    k = facts.latest_graph(spark, d, "kind", "parent_id", "name").filter("kind = 'ConfigKey' and parent_id is not null")
    return k.groupBy("repo_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("folded"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 5), ",").alias("first_names"))


@query("SELECT s_nationkey AS src, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN r_name = '{r}' THEN n END), 0) AS BIGINT) AS {r.lower().replace(' ', '_')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM (SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def sec_dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Dependency matrix: one row per source, one column per target group."""
    li, s, o, c = (table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.lower(F.regexp_replace("r_name", " ", "_")).alias("r"))
    e = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n")).join(n, "c_nationkey")
    return e.groupBy(F.col("s_nationkey").alias("src")).pivot("r", ["africa", "america", "asia", "europe", "middle_east"]).agg(F.sum("n")).na.fill(0)


@query("SELECT p_brand AS tile, count(*) AS members, CAST(sum(p_size) AS BIGINT) AS primitives FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS used FROM part) WHERE used <= 500 GROUP BY 1")
def sec_tile_budget(spark: SparkSession, d: str) -> DataFrame:
    """Members of a tile by importance until its primitive budget is spent."""
    from graphloom.operators.analytics import byte_budget

    kept = byte_budget(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], F.col("p_size"), 500)
    return kept.groupBy(F.col("p_brand").alias("tile")).agg(F.count("*").alias("members"), F.sum("p_size").alias("primitives"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def sec_approved(spark: SparkSession, d: str) -> DataFrame:
    """Of the approved proposals the latest applies."""
    o = graph.first_by(table(spark, d, "orders").filter("o_orderstatus = 'F'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query(ctes("audit") + ", w AS (SELECT principal, tool, event_id, row_number() OVER (PARTITION BY principal ORDER BY ts DESC, event_id DESC) AS r, result_rows FROM audit) SELECT principal, CAST(sum(result_rows) AS BIGINT) AS kept_rows, count(*) AS kept FROM (SELECT *, sum(result_rows + 1) OVER (PARTITION BY principal ORDER BY r ROWS UNBOUNDED PRECEDING) AS used FROM w) WHERE used <= 300 GROUP BY 1")
def sec_condensed(spark: SparkSession, d: str) -> DataFrame:
    """A transcript condensed from its newest end within a budget."""
    from graphloom.operators.analytics import byte_budget

    kept = byte_budget(facts.audit(spark, d), ["principal"], [F.col("ts").desc(), F.col("event_id").desc()], F.col("result_rows") + 1, 300)
    return kept.groupBy("principal").agg(F.sum("result_rows").alias("kept_rows"), F.count("*").alias("kept"))


@query("SELECT doc_id, coalesce(length(text), 0) // 4 AS tokens FROM documents")
def sec_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("bigint").alias("tokens"))


@query("SELECT DISTINCT source, doc_id AS first_doc, substr(regexp_extract(ltrim(text, ' ' || chr(10) || chr(13) || chr(9)), '^[^' || chr(10) || ']*'), 1, 60) AS title FROM documents WHERE source IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) = 1")
def sec_titles(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's title is the start of its first message."""
    doc = table(spark, d, "documents").filter("source is not null and created_at is not null")
    first = graph.first_by(doc, ["source"], [F.col("created_at"), F.col("doc_id")])
    return first.select("source", F.col("doc_id").alias("first_doc"), F.substring(F.regexp_extract(F.regexp_replace("text", r"^[ \n\r\t]+", ""), r"^[^\n]*", 0), 1, 60).alias("title"))


@query("SELECT DISTINCT a.user_id, a.event_id, max(b.event_id) AS nearest FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.event_id <= a.event_id WHERE a.event_type = 'click' GROUP BY ALL")
def sec_nearest_indexed(spark: SparkSession, d: str) -> DataFrame:
    """For every click the nearest earlier view: an ordered lookup by one sort per user."""
    e = table(spark, d, "events")
    seen = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("nearest", seen).filter("event_type = 'click' and nearest is not null").select("user_id", "event_id", "nearest")


@query("SELECT p_type, p_brand, parts FROM (SELECT p_type, p_brand, count(*) AS parts, dense_rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC) AS r FROM part GROUP BY p_type, p_brand) WHERE r <= 2")
def win_step_rank(spark: SparkSession, d: str) -> DataFrame:
    """Steps ranked by weight, ties sharing a rank."""
    g = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("parts"))
    return g.withColumn("r", F.dense_rank().over(Window.partitionBy("p_type").orderBy(F.col("parts").desc()))).filter("r <= 2").select("p_type", "p_brand", "parts")


@query(ctes("call_edges") + ", g AS (SELECT s_nationkey AS src, p_size % 25 AS dst, sum(weight) AS n FROM call_edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst GROUP BY ALL) SELECT src, dst, CAST(n AS BIGINT) AS n, round(n / (SELECT max(n) FROM g WHERE src <> dst), 4) AS weight FROM g WHERE src <> dst")
def agg_cross_domain(spark: SparkSession, d: str) -> DataFrame:
    """Edges between domains, weighed against the busiest."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src0"), F.col("s_nationkey").alias("a"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dst0"), (F.col("p_size") % 25).alias("b"))
    e = facts.call_edges(spark, d).withColumnsRenamed({"src": "src0", "dst": "dst0"}).join(s, "src0").join(p, "dst0").filter("a <> b")
    g = e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("n"))
    most = g.agg(F.max("n")).first()[0] or 1
    return g.select("src", "dst", "n", F.round(F.col("n") / most, 4).alias("weight"))


@query("SELECT a.l_suppkey AS repo_a, b.l_suppkey AS repo_b, count(DISTINCT a.l_orderkey) AS shared FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 3")
def an_cross_repo_change(spark: SparkSession, d: str) -> DataFrame:
    """Repositories changed under the same change id; orders are the change ids."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = x.select("l_orderkey", F.col("l_suppkey").alias("repo_a")), x.select("l_orderkey", F.col("l_suppkey").alias("repo_b"))
    return a.join(b, "l_orderkey").filter("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared")).filter("shared >= 3")


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, o_orderdate, o_orderkey) AS position FROM orders) WHERE position <= 100")
def sec_job_queue(spark: SparkSession, d: str) -> DataFrame:
    """The head of the job queue: state, priority, age."""
    o = table(spark, d, "orders").orderBy("o_orderstatus", "o_orderpriority", "o_orderdate", "o_orderkey").limit(100)
    return o.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderstatus", "o_orderpriority", "o_orderdate", "o_orderkey")).alias("position"))


@query("SELECT DISTINCT a.l_orderkey, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey AND b.l_shipdate BETWEEN a.l_shipdate AND a.l_shipdate + INTERVAL 86400 SECOND")
def join_within_day(spark: SparkSession, d: str) -> DataFrame:
    """Lines followed within a day by another line of their order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").distinct()
    other = li.select("l_orderkey", F.col("l_partkey").alias("p2"), F.col("l_shipdate").alias("later"))
    return intervals.within(li, other, ["l_orderkey"], "l_shipdate", "later", 86400).filter("l_partkey <> p2").select("l_orderkey", "l_partkey").distinct()
