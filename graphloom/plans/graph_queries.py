"""Joins, resolution, traversal and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.operators import graph, hierarchy, intervals, resolution, segments
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query
from graphloom.plans.shared import materialise

# ---- joins


@query(ctes("latest", "g_nodes", "g_files") + " SELECT n.repo_id, n.node_id, f.path, n.start_line, n.end_line FROM g_nodes n LEFT JOIN g_files f ON n.repo_id = f.repo_id AND n.file_id = f.file_id")
def join_locations(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "file_id", "start_line", "end_line")
    return n.join(facts.latest_files(spark, d).select("repo_id", "file_id", "path"), ["repo_id", "file_id"], "left").select("repo_id", "node_id", "path", "start_line", "end_line")


_SIDES = "v AS (SELECT DISTINCT corpus, category, file, start_byte, end_byte FROM vendored), r AS (SELECT DISTINCT corpus, category, file, start_byte, end_byte FROM reference)"


@query(f"WITH {_SIDES} SELECT coalesce(v.corpus, r.corpus) AS corpus, count(*) FILTER (WHERE v.file IS NOT NULL AND r.file IS NOT NULL) AS matched, count(*) FILTER (WHERE v.file IS NULL) AS only_reference, count(*) FILTER (WHERE r.file IS NULL) AS only_vendored FROM v FULL JOIN r ON v.corpus = r.corpus AND v.category = r.category AND v.file = r.file AND v.start_byte = r.start_byte AND v.end_byte = r.end_byte GROUP BY 1")
def join_stages_match(spark: SparkSession, d: str) -> DataFrame:
    """Two stages' outputs must match one to one; what does not is counted."""
    keys = ["corpus", "category", "file", "start_byte", "end_byte"]
    v = table(spark, d, "vendored").select(*keys).distinct().withColumn("v", F.lit(True))
    r = table(spark, d, "reference").select(*keys).distinct().withColumn("r", F.lit(True))
    both = v.join(r, keys, "full_outer")
    return both.groupBy("corpus").agg(F.count_if(F.col("v") & F.col("r")).alias("matched"), F.count_if(F.col("v").isNull()).alias("only_reference"), F.count_if(F.col("r").isNull()).alias("only_vendored"))


@query("SELECT corpus, file, start_byte, end_byte, count(DISTINCT coalesce(callee, '')) AS answers, CASE WHEN count(DISTINCT coalesce(callee, '')) = 1 THEN min(callee) END AS callee FROM vendored WHERE category = 'typed' GROUP BY ALL")
def join_typed_answers(spark: SparkSession, d: str) -> DataFrame:
    """One answer per call site; answers that disagree are refused."""
    t = table(spark, d, "vendored").filter("category = 'typed'").groupBy("corpus", "file", "start_byte", "end_byte")
    t = t.agg(F.count_distinct(F.coalesce("callee", F.lit(""))).alias("answers"), F.min("callee").alias("c"))
    return t.select("corpus", "file", "start_byte", "end_byte", "answers", F.when(F.col("answers") == 1, F.col("c")).alias("callee"))


_CALLABLE = "c AS (SELECT repo_id, node_id, name, qualified_name, file_id, parent_id, json_extract_string(props, '$.language') AS language FROM g_nodes WHERE kind IN ('Function', 'Method', 'Constructor')), m AS (SELECT repo_id, language, name, count(*) AS definitions FROM c GROUP BY ALL)"


def _callables(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "kind", "name", "qualified_name", "file_id", "parent_id", "props").filter(F.col("kind").isin("Function", "Method", "Constructor"))
    return n.select("repo_id", "node_id", "name", "qualified_name", "file_id", "parent_id", F.get_json_object("props", "$.language").alias("language"))


@query(ctes("latest", "g_nodes") + f", {_CALLABLE} SELECT a.repo_id, a.node_id, b.node_id AS candidate FROM c a JOIN c b ON a.repo_id = b.repo_id AND a.language = b.language AND a.name = b.name AND a.node_id <> b.node_id JOIN m ON m.repo_id = a.repo_id AND m.language = a.language AND m.name = a.name WHERE m.definitions <= 256")
def join_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of the same short name in one language; names with more than 256 definitions are left to the blocklist, as the rule has it."""
    c = _callables(spark, d)
    few = c.groupBy("repo_id", "language", "name").agg(F.count("*").alias("n")).filter("n between 2 and 256").select("repo_id", "language", "name")
    c = c.join(few, ["repo_id", "language", "name"], "left_semi")
    other = c.select("repo_id", "language", "name", F.col("node_id").alias("candidate"))
    return c.join(other, ["repo_id", "language", "name"]).filter("node_id <> candidate").select("repo_id", "node_id", "candidate")


@query(ctes("latest", "g_nodes") + f", {_CALLABLE}, x AS (SELECT a.*, b.node_id AS candidate, b.qualified_name AS q FROM c a JOIN c b ON a.repo_id = b.repo_id AND a.language = b.language AND a.name = b.name AND a.node_id <> b.node_id JOIN m ON m.repo_id = a.repo_id AND m.language = a.language AND m.name = a.name WHERE m.definitions <= 256), p AS (SELECT *, list_aggregate(list_transform(generate_series(1, least(len(string_split(qualified_name, '.')), len(string_split(q, '.')))), lambda i: CAST(string_split(qualified_name, '.')[1:i] = string_split(q, '.')[1:i] AS INT)), 'sum') - CASE WHEN regexp_matches(q, '(?i)(^|[._])tests?([._]|$)') THEN 1000 ELSE 0 END AS score FROM x) SELECT repo_id, node_id, candidate, CAST(score AS BIGINT) AS score FROM p QUALIFY row_number() OVER (PARTITION BY repo_id, node_id ORDER BY score DESC, len(string_split(q, '.')), q, candidate) = 1")
def res_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Among definitions of one name, the one whose qualified name shares most with the caller's; tests last."""
    pairs = join_by_name(spark, d)
    c = _callables(spark, d)
    pairs = pairs.join(c.select("repo_id", "node_id", "qualified_name"), ["repo_id", "node_id"]).join(c.select("repo_id", F.col("node_id").alias("candidate"), F.col("qualified_name").alias("q")), ["repo_id", "candidate"])
    best = resolution.nearest_by_import(pairs, ["repo_id", "node_id"], "qualified_name", "q", "candidate")
    return best.select("repo_id", "node_id", "candidate", F.col("score").cast("bigint").alias("score"))


@query(ctes("latest", "g_nodes") + f", {_CALLABLE}, s AS (SELECT repo_id, node_id, array_to_string(string_split(qualified_name, '.')[-2:], '.') AS suffix FROM c), u AS (SELECT repo_id, suffix, min(node_id) AS target, count(*) AS n FROM s GROUP BY ALL HAVING count(*) = 1) SELECT repo_id, suffix, target FROM u")
def res_unique_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Two-part tails of qualified names that one definition alone carries."""
    parts = F.split("qualified_name", r"\.")
    c = _callables(spark, d).select("repo_id", "node_id", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("suffix"))
    return c.groupBy("repo_id", "suffix").agg(F.count("*").alias("n"), F.min("node_id").alias("target")).filter("n = 1").select("repo_id", "suffix", "target")


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_linenumber AS other_line, b.l_partkey AS other_part FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + 1 + CAST(l_quantity AS BIGINT) % 9 AS e FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + 1 + CAST(l_quantity AS BIGINT) % 9 AS e FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND a.s < b.e AND b.s < a.e""")
def join_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one order that intersect."""
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", day.alias("s"), (day + 1 + F.col("l_quantity").cast("bigint") % 9).alias("e")).distinct()
    b = li.select("l_orderkey", F.col("l_linenumber").alias("other_line"), F.col("l_partkey").alias("other_part"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return intervals.overlap_join(li, b, ["l_orderkey"], ("s", "e"), ("s2", "e2"), 8).filter("l_partkey < other_part").select("l_orderkey", "l_linenumber", "l_partkey", "other_line", "other_part")


@query(ctes("audit") + " SELECT a.event_id, b.event_id AS follow_up FROM audit a JOIN audit b ON a.principal = b.principal AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1800 SECOND WHERE a.tool = 'error'")
def join_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Calls of one principal within half an hour after a failed one."""
    a = facts.audit(spark, d)
    failed = a.filter("tool = 'error'").select("event_id", "ts", "principal")
    after = a.select(F.col("event_id").alias("follow_up"), F.col("ts").alias("later"), "principal")
    return intervals.within(failed, after, ["principal"], "ts", "later", 1800).filter("event_id <> follow_up").select("event_id", "follow_up")


@query(ctes("audit") + " SELECT a.event_id, b.event_id AS latest_signup FROM audit a ASOF JOIN (SELECT * FROM audit WHERE tool = 'signup') b ON a.principal = b.principal AND a.ts >= b.ts WHERE a.tool = 'purchase'")
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the principal's latest signup before it."""
    a = facts.audit(spark, d)
    left = a.filter("tool = 'purchase'").select("event_id", "ts", "principal")
    right = a.filter("tool = 'signup'").select(F.col("event_id").alias("latest_signup"), F.col("ts"), "principal")
    return intervals.as_of(left, right, ["principal"], "ts", "ts", ["latest_signup"]).filter("latest_signup is not null").select("event_id", "latest_signup")


@query(ctes("latest", "g_nodes", "g_files") + """, c AS (SELECT n.repo_id, n.name, split_part(f.path, '/', 1) AS module FROM g_nodes n JOIN g_files f ON n.repo_id = f.repo_id AND n.file_id = f.file_id WHERE n.kind IN ('Class', 'Struct') AND position('/' IN f.path) > 0)
SELECT repo_id, module, count(DISTINCT name) AS names, array_to_string(list_sort(list_distinct(list(name)))[1:10], ',') AS sample FROM c GROUP BY ALL""")
def join_subsystem_exports(spark: SparkSession, d: str) -> DataFrame:
    """Types each top-level module defines: distinct count and an ordered sample."""
    n = facts.latest_graph(spark, d, "kind", "name", "file_id").filter(F.col("kind").isin("Class", "Struct"))
    c = n.join(facts.latest_files(spark, d).select("repo_id", "file_id", "path"), ["repo_id", "file_id"]).filter("instr(path, '/') > 0")
    c = c.select("repo_id", "name", F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).distinct()
    w = Window.partitionBy("repo_id", "module").orderBy("name")
    c = c.withColumn("r", F.row_number().over(w))
    return c.groupBy("repo_id", "module").agg(F.count("*").alias("names"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.col("name")))), ",").alias("sample"))


@query("SELECT n_name, s_suppkey, c_custkey FROM nation JOIN (SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1) ON c_nationkey = n_nationkey")
def join_preferred(spark: SparkSession, d: str) -> DataFrame:
    """One preferred row per group on each side, then the catalogue join."""
    s = graph.first_by(table(spark, d, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")])
    c = graph.first_by(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")])
    n = table(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey).join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", "s_suppkey", "c_custkey")


@query("SELECT p_brand, p_type, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS value, count(DISTINCT p_size) AS n FROM part GROUP BY ALL")
def join_single_value(spark: SparkSession, d: str) -> DataFrame:
    """A placeholder resolves only if its key has one value."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_size").alias("n"), F.min("p_size").alias("v"))
    return p.select("p_brand", "p_type", F.when(F.col("n") == 1, F.col("v")).alias("value"), "n")


@query(ctes("latest", "g_files") + " SELECT a.repo_id, a.file_id, b.file_id AS paired FROM g_files a JOIN g_files b ON a.repo_id = b.repo_id AND regexp_replace(a.path, '\\.[^./]*$', '') = regexp_replace(b.path, '\\.[^./]*$', '') AND a.file_id < b.file_id")
def join_paired_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of one stem in one directory."""
    f = facts.latest_files(spark, d).select("repo_id", "file_id", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    return f.join(f.select("repo_id", "stem", F.col("file_id").alias("paired")), ["repo_id", "stem"]).filter("file_id < paired").select("repo_id", "file_id", "paired")


@query(ctes("latest", "g_files") + """, o(pattern, owner) AS (VALUES ('(^|/)api/', 'team-api'), ('\\.go$', 'team-go'), ('\\.(ts|js)$', 'team-web'), ('(^|/)tests/', 'team-quality'))
SELECT repo_id, file_id, max_by(owner, pattern) AS owner FROM g_files JOIN o ON regexp_matches(path, pattern) GROUP BY ALL""")
def join_code_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners by pattern; of several matching patterns the greatest decides. The rules are a config file's few rows."""
    rules = {r"(^|/)api/": "team-api", r"\.go$": "team-go", r"\.(ts|js)$": "team-web", r"(^|/)tests/": "team-quality"}
    owner = F.lit(None).cast("string")
    for pattern in sorted(rules):
        owner = F.when(F.col("path").rlike(pattern), rules[pattern]).otherwise(owner)
    return facts.latest_files(spark, d).select("repo_id", "file_id", owner.alias("owner")).filter("owner is not null")


# ---- resolution

_NARROW = """c AS (SELECT DISTINCT l_partkey AS site, l_suppkey AS candidate FROM lineitem), e AS (SELECT site, candidate, s_nationkey = p_size % 25 AS e1, s_suppkey % 10 = p_partkey % 10 AS e2, s_acctbal > 6000 AS e3, s_suppkey % 3 = p_size % 3 AS e4 FROM c JOIN supplier ON s_suppkey = candidate JOIN part ON p_partkey = site),
a AS (SELECT site, candidate, e1, e2, e3, e4, CASE WHEN sum(CAST(e1 AS INT)) OVER w > 0 THEN e1 ELSE true END AS i1, sum(CAST(e1 AS INT)) OVER w AS n1 FROM e WINDOW w AS (PARTITION BY site)),
b AS (SELECT *, CASE WHEN sum(CAST(i1 AND e2 AS INT)) OVER w > 0 THEN i1 AND e2 ELSE i1 END AS i2, sum(CAST(i1 AND e2 AS INT)) OVER w AS n2 FROM a WINDOW w AS (PARTITION BY site)),
f AS (SELECT *, CASE WHEN sum(CAST(i2 AND e3 AS INT)) OVER w > 0 THEN i2 AND e3 ELSE i2 END AS i3, sum(CAST(i2 AND e3 AS INT)) OVER w AS n3 FROM b WINDOW w AS (PARTITION BY site)),
g AS (SELECT *, CASE WHEN sum(CAST(i3 AND e4 AS INT)) OVER w > 0 THEN i3 AND e4 ELSE i3 END AS i4, sum(CAST(i3 AND e4 AS INT)) OVER w AS n4 FROM f WINDOW w AS (PARTITION BY site)),
h AS (SELECT *, CASE WHEN n1 = 1 THEN 'import-guided' WHEN n2 = 1 THEN 'inheritance-guided' WHEN n3 = 1 THEN 'exact' WHEN n4 = 1 THEN 'scoped' END AS stage, CASE WHEN n1 = 1 THEN e1 WHEN n2 = 1 THEN i1 AND e2 WHEN n3 = 1 THEN i2 AND e3 WHEN n4 = 1 THEN i3 AND e4 ELSE false END AS hit FROM g)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("candidate")).distinct()
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    c = c.join(s, c.candidate == s.s_suppkey).join(p, c.site == p.p_partkey)
    return c.select("site", "candidate", (F.col("s_nationkey") == F.col("p_size") % 25).alias("e1"), (F.col("s_suppkey") % 10 == F.col("p_partkey") % 10).alias("e2"), (F.col("s_acctbal") > 6000).alias("e3"), (F.col("s_suppkey") % 3 == F.col("p_size") % 3).alias("e4"))


_STAGES = [("e1", "import-guided"), ("e2", "inheritance-guided"), ("e3", "exact"), ("e4", "scoped")]


@query(f"WITH {_NARROW} SELECT site, max(stage) AS stage, max(CASE WHEN hit THEN candidate END) AS target, CASE WHEN max(stage) IS NULL THEN count(*) FILTER (WHERE i4) ELSE 0 END AS left_over FROM h GROUP BY 1")
def res_narrowing(spark: SparkSession, d: str) -> DataFrame:
    out = resolution.narrow(_evidence(spark, d), "site", "candidate", _STAGES)
    return out.select("site", "stage", "target", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("left_over"))


@query(f"WITH {_NARROW} SELECT coalesce(stage, 'candidate') AS band, count(*) AS sites FROM (SELECT site, max(stage) AS stage FROM h GROUP BY 1) GROUP BY 1")
def res_bands(spark: SparkSession, d: str) -> DataFrame:
    out = resolution.narrow(_evidence(spark, d), "site", "candidate", _STAGES)
    return out.groupBy(F.coalesce("stage", F.lit("candidate")).alias("band")).agg(F.count("*").alias("sites"))


@query("""WITH c AS (SELECT DISTINCT callee FROM vendored WHERE callee IS NOT NULL) SELECT callee, nullif(regexp_extract(callee, '^(.*)(?:->|::|\\.|\\\\)[^.:>\\\\]*$', 1), '') AS receiver, regexp_extract(callee, '(?:^|->|::|\\.|\\\\)([^.:>\\\\]*)$', 1) AS name FROM c""")
def res_split_callee(spark: SparkSession, d: str) -> DataFrame:
    receiver, name = resolution.split_callee(F.col("callee"))
    return table(spark, d, "vendored").select("callee").filter("callee is not null").distinct().select("callee", receiver.alias("receiver"), name.alias("name"))


@query("SELECT c_custkey, CASE WHEN sum(CAST(o_orderstatus = 'O' AS INT)) > 0 THEN 'own' WHEN sum(CAST(o_orderstatus = 'P' AS INT)) > 0 THEN 'internal' WHEN count(o_orderkey) > 0 AND count(o_orderkey) = sum(CAST(o_orderpriority LIKE '1%' AS INT)) THEN 'external' ELSE 'unknown' END AS provenance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def res_provenance(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    g = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(
        F.coalesce(F.bool_or(F.col("o_orderstatus") == "O"), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.col("o_orderstatus") == "P"), F.lit(False)).alias("internal"),
        F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("external"),
    )
    return g.select("c_custkey", resolution.provenance(F.col("own"), F.col("internal"), F.col("n"), F.col("external")).alias("provenance"))


_LOOKUPS = "l AS (SELECT DISTINCT l_partkey AS site, l_suppkey AS target, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS priority FROM lineitem)"


@query(f"WITH {_LOOKUPS}, b AS (SELECT *, min(priority) OVER (PARTITION BY site) AS best FROM l) SELECT site, priority, count(*) AS n, CASE WHEN count(*) = 1 THEN max(target) END AS target FROM b WHERE priority = best GROUP BY ALL")
def res_prioritised(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    part = lambda flag: li.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("target"))
    return resolution.prioritised([part("A"), part("N"), part("R")], "site", "target").select("site", "priority", "n", "target")


@query("""WITH m AS (SELECT l_partkey AS site, l_suppkey AS target, CASE l_linenumber % 4 WHEN 0 THEN 'import_map' WHEN 1 THEN 'same_module' WHEN 2 THEN 'unique_name' ELSE 'suffix_match' END AS strategy, l_tax > 0.04 AS reachable FROM lineitem),
n AS (SELECT site, count(DISTINCT target) AS candidates FROM m GROUP BY 1), s AS (SELECT m.*, n.candidates, CASE strategy WHEN 'import_map' THEN 0.95 WHEN 'same_module' THEN 0.9 WHEN 'unique_name' THEN 0.75 ELSE 0.55 END * CASE WHEN candidates <= 3 THEN 1 ELSE least(1.0, 3.0 / candidates) END * CASE WHEN strategy = 'unique_name' AND NOT reachable THEN 0.5 ELSE 1 END AS score,
CASE strategy WHEN 'import_map' THEN 0 WHEN 'same_module' THEN 1 WHEN 'unique_name' THEN 4 ELSE 5 END AS o FROM m JOIN n USING (site)) SELECT site, strategy, target, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY o, score DESC, target) = 1""")
def res_scored(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 4
    m = li.select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("target"), F.when(k == 0, "import_map").when(k == 1, "same_module").when(k == 2, "unique_name").otherwise("suffix_match").alias("strategy"), (F.col("l_tax") > 0.04).alias("reachable"))
    n = m.groupBy("site").agg(F.count_distinct("target").alias("candidates"))
    return resolution.scored(m.join(n, "site"), "site").select("site", "strategy", "target", F.round("score", 6).alias("score"))


# ---- traversal


@query(ctes("latest", "g_files") + ", f AS (SELECT repo_id, string_split(path, '/') AS parts FROM g_files), x AS (SELECT repo_id, parts, unnest(generate_series(1, len(parts) - 1)) AS k FROM f WHERE len(parts) > 1) SELECT DISTINCT repo_id, array_to_string(parts[1:k], '/') AS folder, array_to_string(parts[1:k - 1], '/') AS parent, CAST(k AS INT) AS depth FROM x")
def gr_folders(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_prefixes(facts.latest_files(spark, d), "repo_id", "path").withColumnRenamed("g", "repo_id")


_ABOVE = """, u AS (SELECT repo_id, node_id, parent_id AS at FROM g_nodes WHERE parent_id IS NOT NULL UNION SELECT u.repo_id, u.node_id, n.parent_id FROM u JOIN g_nodes n ON n.repo_id = u.repo_id AND n.node_id = u.at WHERE n.kind NOT IN ('Class', 'Struct') AND n.parent_id IS NOT NULL),
d AS (SELECT u.repo_id, u.node_id, t.node_id AS declaring_type FROM u JOIN g_nodes t ON t.repo_id = u.repo_id AND t.node_id = u.at AND t.kind IN ('Class', 'Struct'))"""


def _declaring(n: DataFrame) -> DataFrame:
    """(repo_id, node_id, kind, declaring_type): the nearest type above each node at any depth; types are the roots of a forest cut at them."""
    is_type = F.col("kind").isin("Class", "Struct")
    cut = n.withColumn("parent_id", F.when(~is_type, F.col("parent_id")))
    top = hierarchy.roots_and_depths(hierarchy.forest(cut, group="repo_id", node="node_id", parent="parent_id", once=True)).filter("depth >= 0")
    top = materialise(top.select(F.col("g").alias("repo_id"), F.col("id").alias("node_id"), "root").join(n.filter(is_type).select("repo_id", F.col("node_id").alias("root")), ["repo_id", "root"]), "declaring")
    own = n.filter(~is_type).join(top, ["repo_id", "node_id"]).select("repo_id", "node_id", "kind", F.col("root").alias("declaring_type"))
    above = top.select("repo_id", F.col("node_id").alias("parent_id"), "root")
    return own.unionByName(n.filter(is_type).join(above, ["repo_id", "parent_id"]).select("repo_id", "node_id", "kind", F.col("root").alias("declaring_type")))


@query(ctes("latest", "g_nodes", recursive=True) + _ABOVE + " SELECT repo_id, node_id, declaring_type FROM d")
def gr_declaring_type(spark: SparkSession, d: str) -> DataFrame:
    """Each node's nearest enclosing type, however deep."""
    return _declaring(facts.latest_graph(spark, d, "kind", "parent_id")).select("repo_id", "node_id", "declaring_type")


@query(ctes("sym_edges", recursive=True) + ", s AS (SELECT p_partkey AS seed FROM part WHERE p_size = 1), r AS (SELECT seed, seed AS node, 0 AS distance FROM s UNION SELECT r.seed, e.dst, r.distance + 1 FROM r JOIN sym_edges e ON e.src = r.node WHERE r.distance < 3) SELECT seed, node, min(distance) AS distance FROM r GROUP BY ALL")
def gr_callees(spark: SparkSession, d: str) -> DataFrame:
    """Everything within three steps of the seeds."""
    seeds = table(spark, d, "part").filter("p_size = 1").select("p_partkey")
    return graph.reach(facts.sym_edges(spark, d), seeds, 3)


@query(ctes("sym_edges", recursive=True) + ", s AS (SELECT p_partkey AS at FROM part WHERE p_size = 1), w AS (SELECT e.src AS caller, e.dst AS callee, 1 AS depth, [e.dst, e.src] AS path FROM sym_edges e JOIN s ON e.dst = s.\"at\" UNION ALL SELECT e.src, e.dst, w.depth + 1, list_append(w.path, e.src) FROM w JOIN sym_edges e ON e.dst = w.caller WHERE w.depth < 3 AND NOT list_contains(w.path, e.src)) SELECT DISTINCT caller, callee, depth FROM w".replace("AS at FROM", "AS \"at\" FROM"))
def gr_call_chain(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the seeds, edge by edge, three levels up."""
    return graph.call_chain(facts.sym_edges(spark, d), table(spark, d, "part").filter("p_size = 1").select("p_partkey"), 3)


@query(ctes("sym_edges", recursive=True) + ", b AS (SELECT src, dst FROM sym_edges UNION ALL SELECT dst, src FROM sym_edges), s AS (SELECT p_partkey AS seed FROM part WHERE p_size = 2), r AS (SELECT seed, seed AS node, 0 AS distance FROM s UNION SELECT r.seed, b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.node WHERE r.distance < 2) SELECT seed, node, min(distance) AS distance FROM r GROUP BY ALL")
def gr_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(facts.sym_edges(spark, d), table(spark, d, "part").filter("p_size = 2").select("p_partkey"), 2)


@query(ctes("sym_edges", recursive=True) + ", o AS (SELECT min(src) AS a FROM sym_edges), q AS (SELECT a AS node, 0 AS distance FROM o UNION SELECT e.dst, q.distance + 1 FROM q JOIN sym_edges e ON e.src = q.node WHERE q.distance < 4), ends AS (SELECT (SELECT a FROM o) AS a, (SELECT max(node) FROM q) AS b), w AS (SELECT [src, dst] AS path, dst AS node, 1 AS length FROM sym_edges, ends WHERE src = a UNION ALL SELECT list_append(w.path, e.dst), e.dst, w.length + 1 FROM w JOIN sym_edges e ON e.src = w.node, ends WHERE w.length < 5 AND w.node <> ends.b AND NOT list_contains(w.path, e.dst)) SELECT length, array_to_string(path, '>') AS path FROM w, ends WHERE node = b ORDER BY length, w.path LIMIT 5")
def gr_traces(spark: SparkSession, d: str) -> DataFrame:
    """The five shortest paths from the graph's first symbol to the last one it reaches in four steps."""
    e = materialise(facts.sym_edges(spark, d), "edges")
    seed = e.agg(F.min("src").alias("src"))
    a, b = seed.first()[0], graph.reach(e, seed, 4).agg(F.max("node")).first()[0]
    return graph.traces(e, a, b, depth=5).select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_REACH = ctes("sym_edges", "cyclic_edges", recursive=True) + ", r AS (SELECT src AS origin, dst AS node FROM cyclic_edges UNION SELECT r.origin, e.dst FROM r JOIN cyclic_edges e ON e.src = r.node), n AS (SELECT src AS node FROM cyclic_edges UNION SELECT dst FROM cyclic_edges) "


@query(_REACH + "SELECT n.node, greatest(n.node, coalesce(max(a.node), n.node)) AS component FROM n LEFT JOIN (SELECT x.origin, x.node FROM r x JOIN r y ON x.origin = y.node AND x.node = y.origin) a ON a.origin = n.node GROUP BY n.node")
def gr_components(spark: SparkSession, d: str) -> DataFrame:
    """Strong components of the graph with cycles."""
    return graph.strong_components(facts.cyclic_edges(spark, d).select("src", "dst"))


@query(_REACH + "SELECT DISTINCT node FROM r WHERE origin = node")
def gr_recursive(spark: SparkSession, d: str) -> DataFrame:
    e = materialise(facts.cyclic_edges(spark, d).select("src", "dst"), "edges")
    return graph.recursive_nodes(e, graph.strong_components(e))


@query(ctes("cyclic_edges", recursive=True).replace("cyclic_edges AS", facts.SQL["sym_edges"] + ", cyclic_edges AS") + ", r AS (SELECT dst AS node, src AS origin FROM cyclic_edges UNION SELECT e.dst, r.origin FROM r JOIN cyclic_edges e ON e.src = r.node) SELECT p_partkey AS node, greatest(p_size, coalesce((SELECT max(q.p_size) FROM r JOIN part q ON q.p_partkey = r.node WHERE r.origin = part.p_partkey), 0)) AS value FROM part")
def gr_transitive_max(spark: SparkSession, d: str) -> DataFrame:
    """The greatest size reachable from each part: a maximum, never a sum."""
    values = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("value"))
    return graph.reachable_max(facts.cyclic_edges(spark, d), values)


@query()
def gr_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Edges to cut so that no cycle is left (greedy; the minimum is NP-hard)."""
    e = materialise(facts.cyclic_edges(spark, d), "edges")
    return graph.feedback_edges(e, graph.strong_components(e.select("src", "dst")))


@query()
def gr_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(facts.sym_edges(spark, d))


@query(ctes("call_edges", "band_rank") + ", v AS (SELECT s_suppkey AS node, s_nationkey AS shown FROM supplier), w AS (SELECT p_partkey AS node, p_size % 25 AS shown FROM part), l AS (SELECT v.shown AS src, w.shown AS dst, sum(weight) AS n, min(rank) AS r FROM call_edges JOIN v ON src = v.node JOIN w ON dst = w.node JOIN band_rank USING (band) WHERE v.shown <> w.shown GROUP BY ALL) SELECT src, dst, CAST(n AS BIGINT) AS n, band AS worst_band, least(1.0, n / 10) AS weight FROM l JOIN band_rank ON rank = r")
def gr_lift(spark: SparkSession, d: str) -> DataFrame:
    """Calls lifted to nations with the weakest band between them."""
    shown = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("shown")).unionByName(table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("node"), (F.col("p_size") % 25).alias("shown")))
    return graph.lift_edges(facts.call_edges(spark, d).withColumn("dst", -1 - F.col("dst")), shown).select("src", "dst", "n", "worst_band", "weight")


@query(ctes("latest", "g_nodes", recursive=True) + _ABOVE + " SELECT d.repo_id, declaring_type AS type_id, count(*) AS members FROM d JOIN g_nodes n ON n.repo_id = d.repo_id AND n.node_id = d.node_id WHERE n.kind NOT IN ('Class', 'Struct') GROUP BY ALL")
def gr_visible(spark: SparkSession, d: str) -> DataFrame:
    """Members under each type as their nearest visible ancestor, however deep."""
    members = _declaring(facts.latest_graph(spark, d, "kind", "parent_id")).filter(~F.col("kind").isin("Class", "Struct"))
    return members.groupBy("repo_id", F.col("declaring_type").alias("type_id")).agg(F.count("*").alias("members"))


_REV = "r AS (SELECT p_partkey AS node, 0 AS distance FROM part WHERE p_size = 3 UNION SELECT e.src, r.distance + 1 FROM r JOIN b ON b.dst = r.node JOIN sym_edges e ON e.src = b.src AND e.dst = b.dst WHERE r.distance < 2), t AS (SELECT DISTINCT node FROM r)"


@query(ctes("sym_edges", recursive=True) + ", b AS (SELECT src, dst, weight, CASE WHEN weight > 2 THEN 'typed' ELSE 'exact' END AS band FROM sym_edges), " + _REV + ", o AS (SELECT p_partkey AS node, 'brand' AS level, p_brand AS owner FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part) SELECT 'level:' || level AS measure, count(DISTINCT owner) AS n FROM o JOIN t USING (node) GROUP BY level UNION ALL SELECT 'band:' || band, count(*) FROM b WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t) GROUP BY band UNION ALL SELECT 'symbols', count(*) FROM t UNION ALL SELECT 'unresolved_touched', count(*) FROM (SELECT p_brand AS owner FROM part WHERE p_retailprice > 1500) c WHERE owner IN (SELECT owner FROM o JOIN t USING (node))")
def gr_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    e = facts.sym_edges(spark, d).withColumn("band", F.when(F.col("weight") > 2, "typed").otherwise("exact"))
    p = table(spark, d, "part")
    owners = p.select(F.col("p_partkey").alias("node"), F.lit("brand").alias("level"), F.col("p_brand").alias("owner")).unionByName(p.select(F.col("p_partkey").alias("node"), F.lit("type").alias("level"), F.col("p_type").alias("owner")))
    changed = p.filter("p_size = 3").select("p_partkey")
    return graph.blast_radius(e, changed, 2, owners, p.filter("p_retailprice > 1500").select(F.col("p_brand").alias("owner")))


# ---- set operations


@query("WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linestatus = 'F') SELECT 'same' AS side, count(*) AS pairs FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_old', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_new', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_graph_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    side = lambda s: li.filter(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    both = side("O").withColumn("a", F.lit(True)).join(side("F").withColumn("b", F.lit(True)), ["src", "dst"], "full_outer")
    counted = both.groupBy(F.when(F.col("b").isNull(), "only_old").when(F.col("a").isNull(), "only_new").otherwise("same").alias("side")).agg(F.count("*").alias("pairs"))
    every = spark.createDataFrame([("same",), ("only_old",), ("only_new",)], "side string")
    return every.join(counted, "side", "left").select("side", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("SELECT c_custkey, c_nationkey, 'remote' AS origin FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2) UNION ALL SELECT s_suppkey, s_nationkey, 'local' FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def set_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Local rows of some nations replace all remote rows of those nations."""
    n = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("repo_id"))
    local = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("repo_id")).join(n, "repo_id", "left_semi")
    remote = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("repo_id"))
    return segments.overlay(remote, local).select("c_custkey", F.col("repo_id").alias("c_nationkey"), "origin")


@query("WITH u AS (SELECT l_partkey AS site, l_suppkey AS candidate FROM lineitem WHERE l_discount > 0.05 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.05) SELECT site, count(*) AS candidates, sum(CAST(candidate IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS INT)) AS kept FROM u GROUP BY 1")
def set_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The universe is a union without repeats; a stage intersects and never adds."""
    li = table(spark, d, "lineitem")
    part = lambda c: li.filter(F.col(c) > 0.05).select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("candidate"))
    u = part("l_discount").union(part("l_tax")).distinct()
    ok = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("candidate"), F.lit(1).alias("k"))
    return u.join(ok, "candidate", "left").groupBy("site").agg(F.count("*").alias("candidates"), F.sum(F.coalesce("k", F.lit(0))).cast("bigint").alias("kept"))


@query("SELECT n_nationkey, s_suppkey, direction FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, 'out' AS direction, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 'in', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) FROM supplier) WHERE r <= 2")
def set_directional(spark: SparkSession, d: str) -> DataFrame:
    """Both directions merged, two rows of each per group."""
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    out = graph.first_by(s, ["n_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 2).withColumn("direction", F.lit("out"))
    into = graph.first_by(s, ["n_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")], 2).withColumn("direction", F.lit("in"))
    return out.unionByName(into).select("n_nationkey", "s_suppkey", "direction")


@query(ctes("latest", "g_nodes", recursive=True) + ", e AS (SELECT n.repo_id, n.node_id, n.name, p.node_id AS parent_id FROM g_nodes n LEFT JOIN g_nodes p ON p.repo_id = n.repo_id AND p.node_id = n.parent_id), t AS (SELECT repo_id, node_id, name AS trail, 0 AS depth FROM e WHERE parent_id IS NULL UNION ALL SELECT e.repo_id, e.node_id, t.trail || ' > ' || e.name, t.depth + 1 FROM t JOIN e ON e.repo_id = t.repo_id AND e.parent_id = t.node_id) SELECT repo_id, node_id, trail FROM t")
def gr_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Each node's chain of names from its root."""
    tree = hierarchy.forest(facts.latest_graph(spark, d, "parent_id", "name"), group="repo_id", node="node_id", parent="parent_id", name="name")
    return hierarchy.nested_sets(tree, " > ").filter("depth >= 0").select(F.col("g").alias("repo_id"), F.col("id").alias("node_id"), F.col("path").alias("trail"))
