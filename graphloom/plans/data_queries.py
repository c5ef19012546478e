"""Queries over the domain tables for the general data operators (p2, p4, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import copy_diff, hierarchy, snapshot_diff


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.repository_changes(table(spark, sf_dir, "files"), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "snapshots"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("record_kind", "repo_id", "snapshot_no", "change_kind").agg(F.count("*").alias("records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = copy_diff.engine_differences(table(spark, sf_dir, "vendored"), table(spark, sf_dir, "reference"))
    return d.select("corpus", "category", "file", "start_byte", "end_byte", "difference")


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_diff.engine_differences(table(spark, sf_dir, "vendored"), table(spark, sf_dir, "reference"))


def _forest(spark: SparkSession, sf_dir: str, name: str | None) -> DataFrame:
    nodes = hierarchy.latest_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "snapshots"), ["parent_id", *([name] if name else [])])
    return hierarchy.forest(nodes, group="repo_id", node="node_id", parent="parent_id", name=name, once=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nested_sets(_forest(spark, sf_dir, None), paths=False).select(F.col("g").alias("repo_id"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy.nested_sets(_forest(spark, sf_dir, "name"))
    return out.select(F.col("g").alias("repo_id"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), "path", "descendants")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node, by nested-set ranges."""
    ranges = hierarchy.nested_sets(_forest(spark, sf_dir, None), paths=False)
    out = hierarchy.descendants_of(ranges, ranges)
    return out.select(F.col("g").alias("repo_id"), F.col("id").alias("node_id"), F.col("descendant").alias("descendant_id"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_fields": p4_fields, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}

_VALID = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {v} DESC) = 1"
_CHANGES = f"""
WITH s AS (SELECT repo_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT repo_id, snapshot_no FROM snapshots)),
p AS (SELECT * FROM s WHERE before IS NOT NULL),
f AS ({_VALID.format(t="files", k="repo_id, snapshot_no, file_id", v="ingested_at")}),
n AS ({_VALID.format(t="nodes", k="repo_id, snapshot_no, node_id", v="ingested_at")}),
r AS (
  SELECT 'file' AS record_kind, repo_id, snapshot_no, file_id AS record_id, CAST(row(path, language, status, status_reason, blob_sha, size_bytes, line_count) AS VARCHAR) AS content FROM f
  UNION ALL
  SELECT 'node', repo_id, snapshot_no, node_id, CAST(row(kind, name, qualified_name, file_id, parent_id, start_line, end_line, layer_role, signature, doc,
    json_extract_string(props, '$.is_entry_point'), json_extract_string(props, '$.is_test'), json_extract_string(props, '$.language'), json_extract_string(props, '$.visibility')) AS VARCHAR) FROM n),
a AS (SELECT r.* FROM r JOIN p USING (repo_id, snapshot_no)),
b AS (SELECT r.record_kind, r.repo_id, p.snapshot_no, r.record_id, r.content FROM r JOIN p ON r.repo_id = p.repo_id AND r.snapshot_no = p.before),
d AS (SELECT coalesce(a.record_kind, b.record_kind) AS record_kind, coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no,
    coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN b.record_id IS NULL THEN 'added' WHEN a.record_id IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'changed' END AS change_kind
  FROM a FULL JOIN b ON a.record_kind = b.record_kind AND a.repo_id = b.repo_id AND a.snapshot_no = b.snapshot_no AND a.record_id = b.record_id)
"""
_SIDE = """SELECT corpus, category, file, start_byte, end_byte,
  coalesce(CASE WHEN starts_with(caller, project || '.') THEN substr(caller, length(project) + 2) ELSE caller END, '') AS caller,
  coalesce(CASE WHEN starts_with(callee, project || '.') THEN substr(callee, length(project) + 2) ELSE callee END, '') AS callee,
  coalesce(strategy, '') AS strategy, coalesce(printf('%.8e', confidence), '') AS confidence, coalesce(reason, '') AS reason, coalesce(label, '') AS label,
  coalesce(CASE WHEN starts_with(qn, project || '.') THEN substr(qn, length(project) + 2) ELSE qn END, '') AS qn, coalesce(def_file, '') AS def_file, coalesce(signature, '') AS signature
  FROM ({v})"""
_KEY = "corpus, category, file, start_byte, end_byte"
_FIELDS = ("caller", "callee", "strategy", "confidence", "reason", "label", "qn", "def_file", "signature")
_DIFF = (
    f"WITH v AS ({_SIDE.format(v=_VALID.format(t='vendored', k=_KEY, v='emitted_at'))}), r AS ({_SIDE.format(v=_VALID.format(t='reference', k=_KEY, v='emitted_at'))}), d AS ("
    f"SELECT {_KEY}, 'missing_in_vendored' AS difference, NULL AS left_value, NULL AS right_value FROM r ANTI JOIN v USING ({_KEY}) UNION ALL SELECT {_KEY}, 'missing_in_reference', NULL, NULL FROM v ANTI JOIN r USING ({_KEY})"
    + "".join(f" UNION ALL SELECT {_KEY}, '{f}', v.{f}, r.{f} FROM v JOIN r USING ({_KEY}) WHERE v.{f} <> r.{f}" for f in _FIELDS) + ")"
)
_TREE = """WITH RECURSIVE v AS (SELECT * FROM (SELECT n.* FROM nodes n JOIN (SELECT repo_id, max(snapshot_no) AS snapshot_no FROM snapshots GROUP BY repo_id) USING (repo_id, snapshot_no))
  QUALIFY row_number() OVER (PARTITION BY repo_id, node_id ORDER BY ingested_at DESC) = 1),
e AS (SELECT v.repo_id, v.node_id, v.name, w.node_id AS parent_id FROM v LEFT JOIN v w ON v.repo_id = w.repo_id AND v.parent_id = w.node_id),
t AS (SELECT repo_id, node_id, node_id AS root_id, 0 AS node_depth, name AS path FROM e WHERE parent_id IS NULL
  UNION ALL SELECT e.repo_id, e.node_id, t.root_id, t.node_depth + 1, t.path || '/' || e.name FROM t JOIN e ON e.repo_id = t.repo_id AND e.parent_id = t.node_id),
u AS (SELECT e.* FROM e ANTI JOIN t USING (repo_id, node_id)),
c AS (SELECT repo_id, node_id, parent_id AS hop, 1 AS steps FROM u UNION SELECT c.repo_id, c.node_id, u.parent_id, c.steps + 1 FROM c JOIN u ON u.repo_id = c.repo_id AND u.node_id = c.hop WHERE c.steps < 64),
o AS (SELECT DISTINCT repo_id, node_id FROM c WHERE hop = node_id),
k AS (SELECT c.repo_id, c.node_id, min(c.hop) AS root_id FROM c JOIN o ON o.repo_id = c.repo_id AND o.node_id = c.hop GROUP BY c.repo_id, c.node_id),
x AS (SELECT repo_id, node_id, parent_id AS ancestor FROM e WHERE parent_id IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE t.repo_id = e.repo_id AND t.node_id = e.node_id)
  UNION ALL SELECT x.repo_id, x.node_id, e.parent_id FROM x JOIN e ON e.repo_id = x.repo_id AND e.node_id = x.ancestor WHERE e.parent_id IS NOT NULL)
"""

ORACLE = {
    "p2_found": _CHANGES + "SELECT * FROM d WHERE change_kind IS NOT NULL",
    "p2_counts": _CHANGES + "SELECT record_kind, repo_id, snapshot_no, change_kind, count(*) AS records FROM d WHERE change_kind IS NOT NULL GROUP BY ALL",
    "p4_found": _DIFF + f" SELECT {_KEY}, difference FROM d",
    "p4_fields": _DIFF + f" SELECT {_KEY}, difference, left_value, right_value FROM d",
    "p5_found": _TREE + "SELECT repo_id, node_id, root_id, node_depth FROM t UNION ALL SELECT repo_id, node_id, root_id, -1 FROM k",
    "p5_hierarchy": _TREE + ", n AS (SELECT repo_id, ancestor, count(*) AS descendants FROM x GROUP BY ALL) SELECT t.*, coalesce(n.descendants, 0) AS descendants FROM t LEFT JOIN n ON n.repo_id = t.repo_id AND n.ancestor = t.node_id UNION ALL SELECT repo_id, node_id, root_id, -1, NULL, NULL FROM k",
    "p5_descendants": _TREE + "SELECT repo_id, ancestor AS node_id, node_id AS descendant_id FROM x",
}
