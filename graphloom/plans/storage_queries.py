"""Identities, scans, sinks and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import identity as I
from graphloom.functions import vocab as V
from graphloom.operators import graph, segments, text
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query


def sql_crockford(h: str) -> str:
    out = []
    for g in range(7):
        v = f"CAST('0x' || substr({h}, {5 * g + 1}, 5) AS BIGINT)"
        out += [f"substr('{I.ALPHABET}', CAST((({v}) >> {s}) & 31 AS INT) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out[:26])


def sql_node_id(*fields: str) -> str:
    return "sha256(" + " || chr(0) || ".join(fields) + ")"


# ---- identities


@query(f"SELECT c_custkey, {sql_crockford('h')} AS node_id FROM (SELECT c_custkey, {sql_node_id(chr(39) + 'estate' + chr(39), chr(39) + 'Class' + chr(39), 'c_mktsegment', 'c_name', chr(39) * 2)} AS h FROM customer)")
def id_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", I.node_id("estate", "Class", F.col("c_mktsegment"), F.col("c_name")).alias("node_id"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {sql_crockford('h')} AS edge_id FROM (SELECT *, sha256(lpad(CAST(l_suppkey AS VARCHAR), 26, '0') || lpad(CAST(l_partkey AS VARCHAR), 26, '0') || 'CALLS' || lpad(CAST(l_orderkey AS VARCHAR), 26, '0')) AS h FROM lineitem)")
def id_edges(spark: SparkSession, d: str) -> DataFrame:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 26, "0")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", I.edge_id(pad("l_suppkey"), pad("l_partkey"), "CALLS", pad("l_orderkey")).alias("edge_id"))


@query(f"""SELECT o_orderkey, fingerprint, {sql_crockford('h')} AS site_id FROM (SELECT *, sha256(o_orderstatus || chr(0) || CAST(o_custkey AS VARCHAR) || chr(0) || 'call' || chr(0) || fingerprint) AS h
FROM (SELECT *, sha256('2' || chr(0) || o_orderstatus || chr(0) || o_orderpriority || chr(0) || 'callee' || chr(0) || '' || chr(0) || CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS VARCHAR)) AS fingerprint FROM orders))""")
def id_sites(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints with the ordinal of equal sites of one definition, and the site ids made of them."""
    o = table(spark, d, "orders")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    o = o.withColumn("fingerprint", I.ast_fingerprint(F.array("o_orderstatus", "o_orderpriority"), "callee", "", ordinal))
    return o.select("o_orderkey", "fingerprint", I.site_id(F.col("o_orderstatus"), F.col("o_custkey"), "call", F.col("fingerprint")).alias("site_id"))


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) = 1 THEN '' WHEN count(*) OVER (PARTITION BY p_brand, p_type, p_name) = 1 THEN substr(sha256(p_name), 1, 8)
ELSE substr(sha256(p_name), 1, 8) || '-' || CAST(row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) AS VARCHAR) END AS disambiguator FROM part""")
def id_overloads(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", I.disambiguator([F.col("p_brand"), F.col("p_type")], F.col("p_name"), [F.col("p_partkey")]).alias("disambiguator"))


@query("""SELECT DISTINCT repo_url, canonical, substr(sha256(canonical), 1, 16) AS derived_id FROM (SELECT repo_url, 'https://' || lower(split_part(rest, '/', 1)) || regexp_replace(regexp_replace(rest, '^[^/]*', ''), '\\.git$', '') AS canonical
FROM (SELECT repo_url, regexp_replace(repo_url, '^(?i:https)://([^/?#]*@)?', '') AS rest FROM snapshots WHERE regexp_matches(repo_url, '^(?i:https)://([^/?#\\s]*@)?[^/?#@\\s]+/[^?#\\s]+$')))
UNION SELECT DISTINCT repo_url, NULL, NULL FROM snapshots WHERE NOT regexp_matches(repo_url, '^(?i:https)://([^/?#\\s]*@)?[^/?#@\\s]+/[^?#\\s]+$')""")
def id_repositories(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshots").select("repo_url").distinct()
    return s.select("repo_url", I.canonical_clone_url(F.col("repo_url")).alias("canonical"), I.repo_id(F.col("repo_url")).alias("derived_id"))


@query("SELECT user_id, sha256(array_to_string(list_sort(list_distinct(list(event_type))), chr(10))) AS permission_hash FROM events GROUP BY 1")
def id_permission_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(I.permission_hash(F.collect_set("event_type")).alias("permission_hash"))


@query(f"SELECT event_id, {sql_crockford('h')} AS evidence_id FROM (SELECT event_id, sha256('edge' || chr(0) || CAST(event_id AS VARCHAR) || chr(0) || event_type || chr(0) || CAST(user_id AS VARCHAR)) AS h FROM events)")
def id_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", I.evidence_id("edge", F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("evidence_id"))


# ---- scans


@query("SELECT DISTINCT path, CASE WHEN regexp_matches(path, '(?i)(^|/)(\\.env(\\..*)?|[^/]*\\.(pem|key|p12|pfx|jks|keystore)|id_(rsa|dsa|ecdsa|ed25519)|\\.netrc|\\.npmrc|\\.pypirc)$') THEN 'redacted' WHEN size_bytes > 1048576 THEN 'skipped' WHEN language IS NULL OR language = '' THEN 'skipped' ELSE 'candidate' END AS outcome, size_bytes FROM files")
def src_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Secret paths first, then size, then unknown languages: the first test that holds decides."""
    return text.classified(table(spark, d, "files")).select("path", "outcome", "size_bytes").distinct()


@query("SELECT DISTINCT path, CASE WHEN basename IN ('dockerfile') THEN 'dockerfile' WHEN basename = 'makefile' THEN 'make' ELSE m.language END AS detected FROM (SELECT DISTINCT path, lower(regexp_extract(path, '[^/]*$')) AS basename, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files) f LEFT JOIN (VALUES " + ", ".join(f"('{e}', '{lang}')" for e, lang in text.EXTENSIONS.items()) + ") m(ext, language) ON m.ext = f.ext")
def src_languages(spark: SparkSession, d: str) -> DataFrame:
    return text.detected_language(table(spark, d, "files").select("path").distinct()).select("path", "detected")


@query("SELECT DISTINCT path, (position(chr(92) IN path) > 0 OR regexp_matches(path, '^[A-Za-z]:')) AS unportable FROM files")
def src_unportable_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path", text.unportable(F.col("path")).alias("unportable")).distinct()


@query("SELECT DISTINCT file_id, blob_sha, sha256(text) AS content_digest, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines FROM sources")
def src_digests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("file_id", "blob_sha", F.sha2("text", 256).alias("content_digest"), text.line_count(F.col("text")).alias("lines")).distinct()


@query("SELECT DISTINCT file_id, blob_sha, sha1('blob ' || strlen(text) || chr(0) || text) AS git_blob FROM sources")
def src_blob_ids(spark: SparkSession, d: str) -> DataFrame:
    """Git's own object id of each text."""
    return table(spark, d, "sources").select("file_id", "blob_sha", I.blob_sha(F.col("text")).alias("git_blob")).distinct()


@query(ctes("latest", "g_nodes") + " SELECT repo_id, node_id, kind, qualified_name, row_number() OVER (PARTITION BY repo_id ORDER BY node_id) AS position FROM g_nodes")
def src_nodes_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Full scan in identity order; positions are counted per repository from range-sorted runs, so none is held in one task."""
    n = facts.latest_graph(spark, d, "kind", "qualified_name")
    n = n.withColumn("run", F.substring("node_id", 1, 2))
    runs = n.groupBy("repo_id", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("repo_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("repo_id", "run", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("repo_id", "run").orderBy("node_id"))
    return n.withColumn("inside", inside).join(runs, ["repo_id", "run"]).select("repo_id", "node_id", "kind", "qualified_name", (F.col("inside") + F.col("before")).alias("position"))


@query("""WITH s AS (SELECT repo_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS before, max(snapshot_no) OVER (PARTITION BY repo_id) AS last FROM (SELECT DISTINCT repo_id, snapshot_no FROM snapshots)),
f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, snapshot_no, file_id ORDER BY ingested_at DESC) = 1),
l AS (SELECT * FROM s WHERE snapshot_no = last AND before IS NOT NULL),
a AS (SELECT f.repo_id, f.file_id, f.blob_sha FROM f JOIN l ON f.repo_id = l.repo_id AND f.snapshot_no = l.snapshot_no), b AS (SELECT f.repo_id, f.file_id, f.blob_sha FROM f JOIN l ON f.repo_id = l.repo_id AND f.snapshot_no = l.before)
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, CASE WHEN a.file_id IS NULL THEN 'deleted' WHEN b.file_id IS NULL THEN 'new' WHEN a.blob_sha IS NOT DISTINCT FROM b.blob_sha THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS files
FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.file_id = b.file_id GROUP BY ALL""")
def src_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The change feed of the last scan of each repository, counted."""
    from graphloom.functions.rows import valid_rows
    from graphloom.operators.snapshot_diff import snapshot_pairs

    pairs = snapshot_pairs(table(spark, d, "snapshots"), "repo_id", "snapshot_no").filter("after is null and before is not null")
    f = valid_rows(table(spark, d, "files"), ["repo_id", "snapshot_no", "file_id"], "ingested_at").select("repo_id", "snapshot_no", "blob_sha", F.concat_ws("/", "repo_id", "file_id").alias("key"))
    now = f.join(pairs.select(F.col("g").alias("repo_id"), F.col("n").alias("snapshot_no")), ["repo_id", "snapshot_no"], "left_semi")
    old = f.join(pairs.select(F.col("g").alias("repo_id"), F.col("before").alias("snapshot_no")), ["repo_id", "snapshot_no"], "left_semi")
    out = segments.incremental(old, now, "key", "blob_sha")
    return out.groupBy(F.substring_index("key", "/", 1).alias("repo_id"), "change").agg(F.count("*").alias("files"))


@query(r"SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b(?:[A-Z][A-Z0-9]+-|build |Stand )[0-9]+\b'))) AS ticket FROM documents")
def src_tickets(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:[A-Z][A-Z0-9]+-|build |Stand )[0-9]+\b"), F.lit(0)))).alias("ticket")).distinct()


# ---- sinks and their checks

_DUP = "SELECT '{t}' AS \"table\", count(*) AS keys, sum(n) AS rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)"


@query(" UNION ALL ".join(f"SELECT * FROM ({_DUP.format(t=t, k=k)}) WHERE keys > 0" for t, k in (("files", "repo_id, snapshot_no, file_id"), ("nodes", "repo_id, snapshot_no, node_id"), ("lineitem", "l_orderkey, l_linenumber"), ("customer", "c_custkey"))))
def snk_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, keys in (("files", ["repo_id", "snapshot_no", "file_id"]), ("nodes", ["repo_id", "snapshot_no", "node_id"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("customer", ["c_custkey"])):
        dup = segments.duplicate_keys(table(spark, d, t), t, keys).groupBy("table").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"))
        out = dup if out is None else out.unionByName(dup)
    return out


@query("""SELECT 'nodes' AS "table", 'parent' AS reference, count(*) AS rows FROM nodes n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.repo_id = n.repo_id AND p.snapshot_no = n.snapshot_no AND p.node_id = n.parent_id)
UNION ALL SELECT 'nodes', 'file', count(*) FROM nodes n WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = n.repo_id AND f.snapshot_no = n.snapshot_no AND f.file_id = n.file_id)
UNION ALL SELECT 'lineitem', 'order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def snk_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    nodes, files = table(spark, d, "nodes"), table(spark, d, "files")
    checks = {
        ("nodes", "parent"): (nodes, ["repo_id", "snapshot_no", "parent_id"], nodes, ["repo_id", "snapshot_no", "node_id"]),
        ("nodes", "file"): (nodes, ["repo_id", "snapshot_no", "file_id"], files, ["repo_id", "snapshot_no", "file_id"]),
        ("lineitem", "order"): (table(spark, d, "lineitem"), ["l_orderkey"], table(spark, d, "orders"), ["o_orderkey"]),
    }
    out = None
    for (t, name), (child, fk, parent, pk) in checks.items():
        n = segments.orphans(child, t, fk, parent, pk).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit(t).alias("table"), F.lit(name).alias("reference"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT rule, count(*) AS rows FROM (SELECT CASE WHEN NOT (status IN ('parsed', 'partial', 'failed', 'skipped', 'binary', 'redacted')) THEN 'status' END AS rule FROM files
UNION ALL SELECT CASE WHEN NOT (size_bytes >= 0) THEN 'size' END FROM files UNION ALL SELECT CASE WHEN NOT (line_count IS NULL OR blob_sha IS NOT NULL) THEN 'lines_need_blob' END FROM files
UNION ALL SELECT CASE WHEN NOT (regexp_matches(file_id, '^[0-9A-HJKMNP-TV-Z]{26}$')) THEN 'file_id' END FROM files UNION ALL SELECT CASE WHEN NOT (status <> 'parsed' OR blob_sha IS NOT NULL) THEN 'parsed_needs_blob' END FROM files UNION ALL SELECT CASE WHEN NOT (status IN ('parsed', 'binary') OR status_reason IS NOT NULL) THEN 'reason' END FROM files) WHERE rule IS NOT NULL GROUP BY 1""")
def snk_row_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "status": F.col("status").isin(*V.FILE_STATUS), "size": F.col("size_bytes") >= 0, "lines_need_blob": F.col("line_count").isNull() | F.col("blob_sha").isNotNull(),
        "file_id": F.col("file_id").rlike("^[0-9A-HJKMNP-TV-Z]{26}$"), "parsed_needs_blob": (F.col("status") != "parsed") | F.col("blob_sha").isNotNull(),
        "reason": F.col("status").isin("parsed", "binary") | F.col("status_reason").isNotNull(),
    }
    return segments.violations(table(spark, d, "files"), rules, "file_id").groupBy("rule").agg(F.count("*").alias("rows"))


@query("SELECT repo_id, max(snapshot_no) AS segment FROM snapshots GROUP BY 1")
def snk_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Publication after publication: each repository's last snapshot replaces the one before."""
    s = table(spark, d, "snapshots").select("repo_id", F.col("snapshot_no").alias("segment")).distinct()
    w = Window.partitionBy("repo_id").orderBy("segment")
    ranked = s.withColumn("r", F.row_number().over(w)).withColumn("last", F.max("segment").over(Window.partitionBy("repo_id")))
    return segments.publish_manifest(ranked.filter("r = 1"), ranked.filter("segment = last"))


@query("""WITH v AS (SELECT DISTINCT repo_id, snapshot_no AS version, taken_at FROM snapshots), n AS (SELECT max(taken_at) AS now FROM snapshots)
SELECT repo_id, version FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY version DESC) AS r FROM v), n WHERE r <= 3 OR taken_at >= now - INTERVAL 14 DAY GROUP BY ALL""")
def snk_retention(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "snapshots").select("repo_id", F.col("snapshot_no").alias("version"), F.col("taken_at").alias("created_at")).distinct()
    now = v.agg(F.max("created_at")).first()[0]
    return segments.retained(v, F.lit(now), group="repo_id", versions_kept=3).select("repo_id", "version").distinct()


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def snk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events table as upserts on (user, type): an early half already stored, the later half coming in."""
    e = table(spark, d, "events")
    newest = lambda x: graph.first_by(x, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "value")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return segments.upsert(newest(e.filter(early)), newest(e.filter(~early)), ["user_id", "event_type"])


@query("SELECT count(*) AS rows FROM customer")
def snk_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """The content hash must not depend on partitioning: computed two ways and compared."""
    c = table(spark, d, "customer")
    one, two = segments.content_hash(c), segments.content_hash(c.repartition(7, "c_nationkey").sortWithinPartitions(F.col("c_name").desc()))
    return one.join(two, ["rows", "checksum"]).select("rows")


# ---- filters and lookups


@query(ctes("latest", "g_nodes") + " SELECT repo_id, parent_id, node_id, kind, name, row_number() OVER (PARTITION BY repo_id, parent_id ORDER BY node_id) AS position FROM g_nodes WHERE parent_id IS NOT NULL")
def flt_children(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "kind", "name", "parent_id").filter("parent_id is not null")
    return n.select("repo_id", "parent_id", "node_id", "kind", "name", F.row_number().over(Window.partitionBy("repo_id", "parent_id").orderBy("node_id")).alias("position"))


@query(ctes("call_edges") + " SELECT src, dst, band, weight FROM call_edges WHERE band IN ('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped')")
def flt_drawn_edges(spark: SparkSession, d: str) -> DataFrame:
    return facts.call_edges(spark, d).filter(V.is_drawn(F.col("band")))


@query(ctes("call_edges") + " SELECT src, band, count(*) AS candidates FROM call_edges WHERE NOT band IN ('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped') GROUP BY ALL")
def flt_candidates(spark: SparkSession, d: str) -> DataFrame:
    return facts.call_edges(spark, d).filter(~V.is_drawn(F.col("band"))).groupBy("src", "band").agg(F.count("*").alias("candidates"))


@query("""SELECT corpus, strategy, CASE WHEN strategy = 'lsp_typed' AND confidence BETWEEN 0.85 AND 1 THEN 'typed' WHEN strategy IS NOT NULL AND confidence BETWEEN 0 AND 1 THEN 'hint' ELSE 'diagnostic' END AS verdict,
CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' WHEN confidence >= 0.25 THEN 'speculative' ELSE '' END AS label, count(*) AS answers FROM vendored WHERE category = 'typed' GROUP BY ALL""")
def flt_engine_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vendored").filter("category = 'typed'")
    v = v.select("corpus", "strategy", V.engine_verdict(F.col("strategy"), F.col("confidence"), F.lit(1)).alias("verdict"), V.confidence_label(F.col("confidence")).alias("label"))
    return v.groupBy("corpus", "strategy", "verdict", "label").agg(F.count("*").alias("answers"))


@query(ctes("latest", "g_nodes") + " SELECT repo_id, node_id, name FROM g_nodes WHERE kind IN ('Function', 'Method', 'Constructor') AND (name IN (" + ", ".join(f"'{x}'" for x in V.BLOCKED_NAMES) + ") OR (json_extract_string(props, '$.language') = 'python' AND name IN (" + ", ".join(f"'{x}'" for x in V.BLOCKED_PYTHON) + ")))")
def flt_blocked_names(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "kind", "name", "props").filter(F.col("kind").isin("Function", "Method", "Constructor"))
    return n.filter(V.is_blocked(F.get_json_object("props", "$.language"), F.col("name"))).select("repo_id", "node_id", "name")


@query("SELECT file_id, path, language FROM (SELECT DISTINCT file_id, path, language FROM files) WHERE path ILIKE '%harbor%' AND lower(regexp_extract(path, '[^/]*$')) GLOB '*_*.py'")
def flt_find_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("file_id", "path", "language").distinct()
    return f.filter(text.glob_match(F.regexp_extract("path", r"[^/]*$", 0), "*_*.py") & F.col("path").ilike("%harbor%"))


@query(r"SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE regexp_matches(line, '(?i)deadline|replica\s+lag')")
def flt_grep(spark: SparkSession, d: str) -> DataFrame:
    return text.grep(table(spark, d, "documents"), "doc_id", "text", r"deadline|replica\s+lag").select("doc_id", "line_no", "line")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), m AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '(?i)read replica'))
SELECT DISTINCT l.doc_id, l.line_no, l.line FROM l JOIN m ON l.doc_id = m.doc_id AND l.line_no BETWEEN m.line_no - 2 AND m.line_no + 2""")
def flt_grep_context(spark: SparkSession, d: str) -> DataFrame:
    return text.grep_context(table(spark, d, "documents"), "doc_id", "text", "read replica", 2).select("doc_id", "line_no", "line")


@query("SELECT DISTINCT file_id, blob_sha, array_to_string(string_split(text, chr(10))[3:7], chr(10)) AS excerpt, len(string_split(text, chr(10))) AS total FROM sources")
def flt_excerpts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("file_id", "blob_sha", text.excerpt(F.col("text"), 3, 7).alias("excerpt"), F.size(F.split("text", "\n")).alias("total")).distinct()


@query(ctes("latest", "g_nodes") + " SELECT repo_id, node_id, name, (position('harbor' IN lower(name)) > 0) AS in_name, row_number() OVER (PARTITION BY repo_id ORDER BY (position('harbor' IN lower(name)) > 0) DESC, length(name), node_id) AS rank FROM g_nodes WHERE position('harbor' IN lower(name)) > 0 OR position('harbor' IN lower(qualified_name)) > 0 QUALIFY rank <= 10")
def flt_node_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten best names per repository: hits in the name first, then shorter names."""
    n = facts.latest_graph(spark, d, "name", "qualified_name")
    hit = F.coalesce(F.instr(F.lower("name"), "harbor") > 0, F.lit(False))
    n = n.withColumn("in_name", hit).filter(hit | (F.instr(F.lower("qualified_name"), "harbor") > 0))
    w = Window.partitionBy("repo_id").orderBy(F.col("in_name").desc(), F.length("name"), "node_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("repo_id", "node_id", "name", "in_name", "rank")


@query(ctes("call_edges") + " SELECT src, dst, band, weight FROM call_edges WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND dst IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def flt_permitted(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends are permitted, restricted before anything is counted."""
    e = facts.call_edges(spark, d)
    s = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("src"))
    p = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("dst"))
    return e.join(s, "src", "left_semi").join(p, "dst", "left_semi").select("src", "dst", "band", "weight")


@query(ctes("latest", "g_files") + """, p AS (SELECT repo_id, split_part(path, '/', 1) AS top, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM g_files WHERE position('/' IN path) > 0),
e AS (SELECT repo_id, top, ext, count(*) AS n, row_number() OVER (PARTITION BY repo_id, top ORDER BY count(*) DESC, ext) AS r FROM p GROUP BY repo_id, top, ext)
SELECT repo_id, top, CAST(sum(n) AS BIGINT) AS files, array_to_string(list(ext ORDER BY r) FILTER (WHERE r <= 3), ',') AS extensions FROM e GROUP BY repo_id, top""")
def flt_tree(spark: SparkSession, d: str) -> DataFrame:
    """First directory level with file counts and the three commonest extensions."""
    p = facts.latest_files(spark, d).filter("instr(path, '/') > 0").select("repo_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("top"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    e = p.groupBy("repo_id", "top", "ext").agg(F.count("*").alias("n"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "top").orderBy(F.col("n").desc(), "ext")))
    first = F.filter(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "ext")))), lambda x: x.isNotNull())
    return e.groupBy("repo_id", "top").agg(F.sum("n").alias("files"), F.array_join(F.transform(first, lambda x: x["ext"]), ",").alias("extensions"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS permitted FROM customer")
def flt_permission_point(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("there", F.lit(True))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("there", F.lit(False)).alias("permitted"))
