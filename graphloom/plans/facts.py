"""Views of the driver's tables as graph facts.

Orders play commits, parts files and symbols, suppliers authors and callers;
the domain tables (nodes, files, sources) are used as they are, latest valid
rows only.  Each view has its SQL twin in ``SQL``, to be put before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import valid_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, file_id, author_id, ts, lines): what each order touched."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("author_id"), F.sum("l_quantity").alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file_id"), "author_id", F.col("o_orderdate").alias("ts"), "lines")


def sym_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): part pairs a < b sharing at least two orders."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = p.select("l_orderkey", F.col("l_partkey").alias("src")), p.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).filter("weight >= 2")


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sym_edges`` with every fifth pair both ways."""
    e = sym_edges(spark, sf_dir)
    return e.unionByName(e.filter("(src + dst) % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def band_expr(flag: str = "l_returnflag", status: str = "l_linestatus"):
    k = F.concat(F.col(flag), F.col(status))
    return (
        F.when(k == "AF", "precise").when(k == "AO", "typed").when(k == "NF", "import-guided").when(k == "NO", "exact").when(k == "RF", "scoped").when(k == "RO", "candidate").otherwise("unresolved")
    )


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, band, weight): suppliers calling parts."""
    li = table(spark, sf_dir, "lineitem").withColumn("band", band_expr())
    return li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "band").agg(F.count("*").alias("weight"))


def latest_graph(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Valid node rows of latest snapshots."""
    from graphloom.operators.hierarchy import latest_nodes

    return latest_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "snapshots"), list(columns)).drop("snapshot_no", "ingested_at")


def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, snapshots = table(spark, sf_dir, "files"), table(spark, sf_dir, "snapshots")
    last = snapshots.groupBy("repo_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    f = files.join(last, ["repo_id", "snapshot_no"], "left_semi")
    return valid_rows(f, ["repo_id", "snapshot_no", "file_id"], "ingested_at").drop("ingested_at")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, principal, tool, result_rows): the log of tool calls."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("principal"), F.col("event_type").alias("tool"), F.floor("value").cast("bigint").alias("result_rows"))


def top_order(*by) -> Window:
    return Window.orderBy(*by)


_BAND_SQL = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'precise' WHEN 'AO' THEN 'typed' WHEN 'NF' THEN 'import-guided' WHEN 'NO' THEN 'exact' WHEN 'RF' THEN 'scoped' WHEN 'RO' THEN 'candidate' ELSE 'unresolved' END"
SQL = {
    "commit_files": "commit_files AS (SELECT l_orderkey AS commit_id, l_partkey AS file_id, min(l_suppkey) AS author_id, any_value(o_orderdate) AS ts, sum(l_quantity) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "sym_edges": "sym_edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2)",
    "cyclic_edges": "cyclic_edges AS (SELECT * FROM sym_edges UNION ALL SELECT dst, src, weight FROM sym_edges WHERE (src + dst) % 5 = 0)",
    "call_edges": f"call_edges AS (SELECT l_suppkey AS src, l_partkey AS dst, {_BAND_SQL} AS band, count(*) AS weight FROM lineitem GROUP BY ALL)",
    "latest": "latest AS (SELECT repo_id, max(snapshot_no) AS snapshot_no FROM snapshots GROUP BY 1)",
    "g_nodes": "g_nodes AS (SELECT n.* FROM nodes n JOIN latest USING (repo_id, snapshot_no) QUALIFY row_number() OVER (PARTITION BY n.repo_id, n.node_id ORDER BY n.ingested_at DESC) = 1)",
    "g_files": "g_files AS (SELECT f.* FROM files f JOIN latest USING (repo_id, snapshot_no) QUALIFY row_number() OVER (PARTITION BY f.repo_id, f.file_id ORDER BY f.ingested_at DESC) = 1)",
    "audit": "audit AS (SELECT event_id, ts, user_id AS principal, event_type AS tool, CAST(floor(value) AS BIGINT) AS result_rows FROM events)",
    "band_rank": "band_rank(band, rank) AS (VALUES ('precise', 10), ('typed', 9), ('import-guided', 8), ('inheritance-guided', 7), ('exact', 6), ('scoped', 5), ('candidate', 4), ('external', 3), ('blocked', 2), ('unresolved', 1), ('contradicted', 0))",
}


def ctes(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
