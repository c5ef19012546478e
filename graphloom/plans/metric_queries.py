"""Metrics, analytics, windows, top-k and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import contract_keys as K
from graphloom.functions import identity as I
from graphloom.functions import vocab as V
from graphloom.operators import analytics as A
from graphloom.operators import graph
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query
from graphloom.plans.storage_queries import sql_crockford

_DRAWN = "('precise', 'typed', 'import-guided', 'inheritance-guided', 'exact', 'scoped')"


@query(ctes("call_edges") + f", e AS (SELECT * FROM call_edges WHERE band IN {_DRAWN}), i AS (SELECT dst AS node, sum(weight) AS fan_in FROM e GROUP BY 1), o AS (SELECT src AS node, sum(weight) AS fan_out FROM e GROUP BY 1) SELECT p_partkey AS node, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM part LEFT JOIN i ON i.node = p_partkey LEFT JOIN o ON o.node = p_partkey")
def agg_fan(spark: SparkSession, d: str) -> DataFrame:
    e = facts.call_edges(spark, d).filter(V.is_drawn(F.col("band")))
    return graph.degree(e, table(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query(ctes("call_edges") + f", i AS (SELECT dst AS node, sum(weight) AS fan_in FROM call_edges WHERE band IN {_DRAWN} GROUP BY 1) SELECT p_partkey AS node, round(sqrt(coalesce(fan_in, 0)) * CASE WHEN p_size <= 25 THEN 1.0 ELSE 0.6 END * CASE WHEN p_brand LIKE '%1' THEN 0.3 ELSE 1.0 END, 6) AS importance FROM part LEFT JOIN i ON i.node = p_partkey")
def agg_importance(spark: SparkSession, d: str) -> DataFrame:
    e = facts.call_edges(spark, d).filter(V.is_drawn(F.col("band")))
    p = table(spark, d, "part")
    fan = graph.degree(e, p.select(F.col("p_partkey").alias("node")))
    fan = fan.join(p, fan.node == p.p_partkey)
    return fan.select("node", F.round(graph.importance(F.col("fan_in"), F.col("p_size") <= 25, F.col("p_brand").endswith("1")), 6).alias("importance"))


@query(ctes("latest", "g_nodes") + " SELECT repo_id, kind, count(*) AS nodes, count(CASE WHEN start_line >= 1 AND end_line >= start_line THEN 1 END) AS measured, CAST(sum(CASE WHEN start_line >= 1 AND end_line >= start_line THEN end_line - start_line + 1 END) AS BIGINT) AS loc FROM g_nodes GROUP BY ALL")
def agg_loc(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "kind", "start_line", "end_line").withColumn("loc", A.loc(F.col("start_line"), F.col("end_line")))
    return n.groupBy("repo_id", "kind").agg(F.count("*").alias("nodes"), F.count("loc").alias("measured"), F.sum("loc").alias("loc"))


@query("SELECT o_orderpriority AS language, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS {b.replace('-', '_')}" for b in V.BANDS) + f" FROM (SELECT o_orderpriority, {facts._BAND_SQL} AS band FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def agg_coverage_bands(spark: SparkSession, d: str) -> DataFrame:
    """Call sites per language and band, all eleven bands present."""
    li = table(spark, d, "lineitem").withColumn("band", facts.band_expr())
    o = table(spark, d, "orders")
    return A.zero_filled_bands(li.join(o, li.l_orderkey == o.o_orderkey).withColumnRenamed("o_orderpriority", "language"), ["language"], "band")


@query(ctes("latest", "g_files") + " SELECT language, count(*) AS files, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in V.FILE_STATUS) + " FROM g_files GROUP BY 1")
def agg_coverage_files(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_files(spark, d).groupBy("language").agg(F.count("*").alias("files"), *(F.count_if(F.col("status") == s).alias(s) for s in V.FILE_STATUS))


@query(ctes("latest", "g_files") + ", g AS (SELECT repo_id, count(*) AS files, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped' AND status_reason LIKE '%size%') AS skipped, bool_or(status = 'partial') AS cut FROM g_files GROUP BY 1) SELECT repo_id, files, ((failed + skipped) * 20 > files OR cut) AS degraded FROM g")
def agg_degraded(spark: SparkSession, d: str) -> DataFrame:
    g = facts.latest_files(spark, d).groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "skipped") & F.coalesce(F.col("status_reason").like("%size%"), F.lit(False))).alias("skipped"), F.bool_or(F.col("status") == "partial").alias("cut"))
    return g.select("repo_id", "files", A.degraded(F.col("files"), F.col("failed"), F.col("skipped"), F.col("cut")).alias("degraded"))


@query(f"SELECT o_orderpriority AS language, band, count(*) AS sites, count(*) FILTER (WHERE band IN {_DRAWN}) AS drawn, round(count(*) FILTER (WHERE l_quantity > 25) / count(*), 6) AS precision FROM (SELECT o_orderpriority, l_quantity, {facts._BAND_SQL} AS band FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ROLLUP (o_orderpriority, band)")
def agg_quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Precision per language and band, per language, and over all."""
    li, o = table(spark, d, "lineitem").withColumn("band", facts.band_expr()), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_orderpriority").alias("language"), "band", "l_quantity")
    return j.rollup("language", "band").agg(F.count("*").alias("sites"), F.count_if(V.is_drawn(F.col("band"))).alias("drawn"), F.round(F.count_if(F.col("l_quantity") > 25) / F.count("*"), 6).alias("precision"))


@query(ctes("call_edges") + ", g AS (SELECT src, dst, sum(weight) AS n FROM call_edges GROUP BY ALL) SELECT src, dst, CAST(n AS BIGINT) AS n, round(n / greatest(max(n) OVER (), 1), 4) AS weight FROM g")
def agg_collapsed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls collapsed to pairs, weighted by the busiest pair."""
    g = facts.call_edges(spark, d).groupBy("src", "dst").agg(F.sum("weight").alias("n"))
    most = max(g.agg(F.max("n")).first()[0] or 1, 1)
    return g.select("src", "dst", "n", F.round(F.col("n") / most, 4).alias("weight"))


_LAYERS = "l AS (SELECT s_suppkey, s_nationkey FROM supplier), p AS (SELECT p_partkey, p_size % 25 AS layer FROM part), e AS (SELECT l.s_nationkey AS a, p.layer AS b, band, weight FROM call_edges JOIN l ON s_suppkey = src JOIN p ON p_partkey = dst)"


def _layer_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("a"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") % 25).alias("b"))
    return facts.call_edges(spark, d).join(s, "src").join(p, "dst").select("a", "b", "band", "weight")


@query(ctes("call_edges") + f", {_LAYERS} SELECT least(a, b) AS layer_a, greatest(a, b) AS layer_b, CAST(sum(weight) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(band))), ',') AS bands FROM e WHERE a <> b GROUP BY 1, 2")
def agg_layer_edges(spark: SparkSession, d: str) -> DataFrame:
    """Undirected counts between layers with the set of bands."""
    e = _layer_edges(spark, d).filter("a <> b").groupBy(F.least("a", "b").alias("layer_a"), F.greatest("a", "b").alias("layer_b"))
    return e.agg(F.sum("weight").alias("n"), F.array_join(F.array_sort(F.collect_set("band")), ",").alias("bands"))


@query(ctes("call_edges") + f", {_LAYERS} SELECT layer, other, CAST(sum(weight) AS BIGINT) AS connections FROM (SELECT a AS layer, b AS other, weight FROM e WHERE a <> b UNION ALL SELECT b, a, weight FROM e WHERE a <> b) GROUP BY ALL")
def agg_portals(spark: SparkSession, d: str) -> DataFrame:
    e = _layer_edges(spark, d).filter("a <> b")
    return e.select(F.col("a").alias("layer"), F.col("b").alias("other"), "weight").union(e.select("b", "a", "weight")).groupBy("layer", "other").agg(F.sum("weight").alias("connections"))


@query(ctes("call_edges") + f", {_LAYERS} SELECT a AS src, b AS dst, a = b AS inner_edge, CAST(sum(weight) AS BIGINT) AS n, count(*) AS edges FROM e GROUP BY ALL")
def agg_container_edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed counts between containers; edges inside one are told apart."""
    return _layer_edges(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("a") == F.col("b")).alias("inner_edge")).agg(F.sum("weight").alias("n"), F.count("*").alias("edges"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS principals, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM events GROUP BY 1")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("principals"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


@query("SELECT event_type AS tool, count(*) AS calls, round(avg(CAST(value < 5 AS INT)), 6) AS empty_rate, round(median(value), 6) AS median_rows, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def usage_tools(spark: SparkSession, d: str) -> DataFrame:
    """Calls, empty-result rate, median and 95th percentile per tool."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("tool"))
    return e.agg(F.count("*").alias("calls"), F.round(F.avg((F.col("value") < 5).cast("int")), 6).alias("empty_rate"), F.round(F.percentile("value", 0.5), 6).alias("median_rows"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query(r"SELECT event_type, CAST(regexp_extract(props, '\d+') AS INT) // 10 AS bucket, count(*) AS calls FROM events GROUP BY ALL")
def usage_breakdown(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type", F.floor(k / 10).cast("int").alias("bucket")).agg(F.count("*").alias("calls"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS started, count(*) AS calls FROM s GROUP BY user_id, session")
def usage_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by a gap of ten minutes."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("calls")).select("user_id", "started", "calls")


@query("WITH l AS (SELECT o_orderpriority, CAST(epoch(m.last) - epoch(o_orderdate) AS DOUBLE) / 86400 AS lag FROM orders, (SELECT max(o_orderdate) AS last FROM orders) m) SELECT o_orderpriority, round(quantile_cont(lag, 0.5), 6) AS p50, round(quantile_cont(lag, 0.95), 6) AS p95 FROM l GROUP BY 1")
def fresh_lag(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    lag = (F.lit(o.agg(F.max(micros)).first()[0]) - micros) / 86400e6
    return o.withColumn("lag", lag).groupBy("o_orderpriority").agg(F.round(F.percentile("lag", 0.5), 6).alias("p50"), F.round(F.percentile("lag", 0.95), 6).alias("p95"))


@query("WITH s AS (SELECT DISTINCT repo_id, snapshot_no, taken_at FROM snapshots QUALIFY row_number() OVER (PARTITION BY repo_id, snapshot_no ORDER BY taken_at DESC) = 1) SELECT repo_id, snapshot_no, CAST(epoch(taken_at) - epoch(lag(taken_at) OVER (PARTITION BY repo_id ORDER BY snapshot_no)) AS BIGINT) AS seconds_since FROM s")
def win_trend(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between a snapshot and the one before it."""
    s = table(spark, d, "snapshots").groupBy("repo_id", "snapshot_no").agg(F.max("taken_at").alias("taken_at"))
    ts = F.unix_micros(F.col("taken_at").cast("timestamp"))
    before = F.lag(ts).over(Window.partitionBy("repo_id").orderBy("snapshot_no"))
    return s.select("repo_id", "snapshot_no", F.round((ts - before) / 1e6).cast("bigint").alias("seconds_since"))


@query(ctes("commit_files") + ", k AS (SELECT commit_id FROM commit_files GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), f AS (SELECT commit_id, file_id FROM commit_files SEMI JOIN k USING (commit_id)), n AS (SELECT file_id, count(*) AS c FROM f GROUP BY 1), p AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS shared FROM f x JOIN f y ON x.commit_id = y.commit_id AND x.file_id < y.file_id GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, shared, round(shared / least(m.c, n.c), 6) AS coupling FROM p JOIN n m ON m.file_id = a JOIN n ON n.file_id = b")
def an_co_change(spark: SparkSession, d: str) -> DataFrame:
    return A.co_change(facts.commit_files(spark, d), least_shared=2).withColumn("coupling", F.round("coupling", 6))


@query(ctes("commit_files") + ", c AS (SELECT file_id, CAST(sum(lines) AS BIGINT) AS churn FROM commit_files GROUP BY 1), j AS (SELECT file_id, churn, p_size AS complexity FROM c JOIN part ON p_partkey = file_id), r AS (SELECT *, round(percent_rank() OVER (ORDER BY churn) * percent_rank() OVER (ORDER BY complexity), 9) AS score FROM j) SELECT file_id, churn, complexity, round(score, 6) AS score, percent_rank() OVER (ORDER BY r.score) >= 0.9 AS hotspot FROM r")
def an_hotspots(spark: SparkSession, d: str) -> DataFrame:
    churn = facts.commit_files(spark, d).groupBy("file_id").agg(F.sum("lines").cast("bigint").alias("churn"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("complexity"))
    return A.hotspots(churn, p).withColumn("score", F.round("score", 6))


@query("WITH n AS (SELECT l_partkey AS file_id, l_suppkey AS author_id, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY n DESC, author_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY file_id) AS total, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, author_id) AS k FROM n) SELECT file_id, count(*) AS authors, count(*) FILTER (WHERE before * 2 < total) AS bus_factor, max(author_id) FILTER (WHERE k = 1) AS top_author FROM r GROUP BY 1")
def an_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("author_id"))
    return A.bus_factor(li)


@query(ctes("call_edges") + f" SELECT src, dst, band FROM call_edges JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst WHERE band IN {_DRAWN} AND s_nationkey % 4 = 1 AND p_size % 5 = 2")
def an_rule_forbid(spark: SparkSession, d: str) -> DataFrame:
    """Calls from the api role into the storage role."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_nationkey") % 4 == 1, "api").otherwise("other").alias("role"))
    p = table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("node"), F.when(F.col("p_size") % 5 == 2, "storage").otherwise("other").alias("role"))
    e = facts.call_edges(spark, d).withColumn("dst", -1 - F.col("dst"))
    return A.forbidden(e, s.unionByName(p), "api", "storage").select("src", (-1 - F.col("dst")).alias("dst"), "band")


@query(ctes("call_edges") + f" SELECT s_suppkey AS node FROM supplier WHERE s_nationkey % 4 = 1 AND s_suppkey NOT IN (SELECT src FROM call_edges JOIN part ON p_partkey = dst WHERE band IN {_DRAWN} AND p_brand = 'Brand#11' AND p_size < 5)")
def an_rule_require(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter("p_brand = 'Brand#11' and p_size < 5").select((-1 - F.col("p_partkey")).alias("node"), F.lit("gateway").alias("role"))
    s = table(spark, d, "supplier").filter("s_nationkey % 4 = 1").select(F.col("s_suppkey").alias("node"), F.lit("client").alias("role"))
    e = facts.call_edges(spark, d).withColumn("dst", -1 - F.col("dst"))
    return A.required(e, s.unionByName(p), "client", ["gateway"])


# ---- windows and top-k


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem")
def win_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of equal sites in source order."""
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).alias("ordinal"))


@query("SELECT p_partkey, p_name || CASE WHEN row_number() OVER w > 1 THEN '#' || CAST(row_number() OVER w AS VARCHAR) ELSE '' END AS id FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def win_duplicate_suffix(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(n > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise("")).alias("id"))


@query("SELECT o_custkey, o_orderkey, round(row_number() OVER w / (count(*) OVER (PARTITION BY o_custkey) + 1), 6) AS position FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_flow_position(spark: SparkSession, d: str) -> DataFrame:
    """Step i of n at i / (n + 1)."""
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) / (F.count(F.lit(1)).over(w) + 1), 6).alias("position"))


@query("SELECT l_partkey, l_returnflag FROM (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag) AS r FROM lineitem) WHERE r = 1")
def win_first_layer(spark: SparkSession, d: str) -> DataFrame:
    """The first layer in order wins; only its name is needed, so no row is ranked."""
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_returnflag").alias("l_returnflag"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, sum(length(c_name) + 8) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS used FROM customer) WHERE used <= 400")
def top_budget(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows from the front of each list until 400 bytes are spent."""
    c = table(spark, d, "customer")
    return A.byte_budget(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], F.length("c_name") + 8, 400).select("c_nationkey", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def top_page(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = A.page(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, 40)
    return rows


@query("SELECT CASE WHEN r <= 29 THEN p_name ELSE 'Other' END AS layer, CAST(sum(n) AS BIGINT) AS members FROM (SELECT p_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY p_name) GROUP BY 1")
def top_layers(spark: SparkSession, d: str) -> DataFrame:
    """The 29 largest layers, the rest folded; ranks are over names, of which there are few."""
    n = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.orderBy(F.col("n").desc(), "p_name"))
    return n.withColumn("r", r).groupBy(F.when(F.col("r") <= 29, F.col("p_name")).otherwise("Other").alias("layer")).agg(F.sum("n").alias("members"))


@query(ctes("call_edges") + ", g AS (SELECT dst AS node, sum(weight) AS n FROM call_edges GROUP BY 1) SELECT node, CAST(n AS BIGINT) AS n FROM g ORDER BY n DESC, node LIMIT 30")
def top_degree(spark: SparkSession, d: str) -> DataFrame:
    return facts.call_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("n")).orderBy(F.col("n").desc(), "node").limit(30)


# ---- contracts


@query(r"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s)>"'',]+')) AS url FROM documents UNION ALL SELECT o_orderkey, 'https://User@Shop' || (o_custkey % 7) || '.Example:443/v1/orders/{id}/' || o_orderstatus || '/?x=' || o_custkey FROM orders),
p AS (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*', ''), '[?#].*$', '') AS path, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '') AS a FROM u)
SELECT url, 'GET ' || regexp_replace(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, '(.)/+$', '\1') AS api_key, regexp_replace(lower(a), ':443$', '') AS authority FROM p""".replace("regexp_replace(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, '(.)/+$', '\\1')", "regexp_replace(regexp_replace(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, '\\{[^{}]*\\}|<[^<>]*>', '{}', 'g'), '(.)/+$', '\\1')"))
def con_api_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys and authorities of URLs in documents and of made-up order URLs."""
    doc = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"https?://[^\s)>\"',]+"), F.lit(0))).alias("url"))
    o = table(spark, d, "orders").select(F.concat(F.lit("https://User@Shop"), (F.col("o_custkey") % 7).cast("string"), F.lit(".Example:443/v1/orders/{id}/"), "o_orderstatus", F.lit("/?x="), F.col("o_custkey").cast("string")).alias("url"))
    u = doc.union(o).distinct()
    return u.select("url", K.api_key(F.lit("get"), F.col("url")).alias("api_key"), K.authority(F.col("url")).alias("authority"))


@query("SELECT DISTINCT p_brand, p_type, lower(p_type) || ':' || p_brand || ':' || p_name || '@' || p_size AS artifact, lower(replace(p_brand, '#', '_')) AS table_key FROM part")
def con_coordinates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    quoted = F.concat(F.lit('public."'), F.regexp_replace("p_brand", "#", "_"), F.lit('"'))
    return p.select("p_brand", "p_type", K.artifact_key(F.lower("p_type"), F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string")).alias("artifact"), K.table_key(quoted).alias("table_key")).distinct()


@query(f"WITH k AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN '{{\"identity\":\"host' || s_nationkey || '\",\"key\":\"' || s_name || '\"}}' ELSE 'unresolved:repo' || s_nationkey || ':' || s_name END AS namespace_key FROM supplier) SELECT s_suppkey, namespace_key, {sql_crockford('h')} AS contract_id FROM (SELECT *, sha256('estate' || chr(0) || 'Channel' || chr(0) || '' || chr(0) || namespace_key || chr(0) || '') AS h FROM k)")
def con_identities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = F.col("s_nationkey").cast("string")
    key = K.namespace_key(F.concat(F.lit("host"), n), F.col("s_name"), F.when(F.col("s_acctbal") > 0, "exact").otherwise("unresolved"), F.concat(F.lit("repo"), n))
    return s.select("s_suppkey", key.alias("namespace_key")).withColumn("contract_id", I.contract_id("Channel", F.col("namespace_key")))


_SIGHT = "s AS (SELECT 'Channel' AS kind, CAST(s_nationkey AS VARCHAR) AS namespace_key, 'provides' AS direction, CASE WHEN s_acctbal > 5000 THEN 'exact' WHEN s_acctbal > 0 THEN 'declared' ELSE 'unresolved' END AS strength, 'S' || CAST(s_suppkey % 3 AS VARCHAR) AS owner, s_name AS source FROM supplier UNION ALL SELECT 'Channel', CAST(c_nationkey + 5 AS VARCHAR), 'consumes', CASE WHEN c_acctbal > 9000 THEN 'exact' ELSE 'declared' END, c_name, c_mktsegment FROM customer)"


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = s.select(F.lit("Channel").alias("kind"), F.col("s_nationkey").cast("string").alias("namespace_key"), F.lit("provides").alias("direction"), F.when(F.col("s_acctbal") > 5000, "exact").when(F.col("s_acctbal") > 0, "declared").otherwise("unresolved").alias("strength"), F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")).alias("owner"), F.col("s_name").alias("source"))
    b = c.select(F.lit("Channel").alias("kind"), (F.col("c_nationkey") + 5).cast("string").alias("namespace_key"), F.lit("consumes").alias("direction"), F.when(F.col("c_acctbal") > 9000, "exact").otherwise("declared").alias("strength"), F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("source"))
    return a.unionByName(b)


@query(f"WITH {_SIGHT} SELECT kind, namespace_key, CASE WHEN bool_or(direction = 'provides') AND bool_or(direction = 'consumes') THEN 'both' WHEN bool_or(direction = 'provides') THEN 'provides' ELSE 'consumes' END AS direction, CASE max(CASE strength WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'declared' ELSE 'unresolved' END AS strength, CASE WHEN count(DISTINCT CASE WHEN direction = 'provides' THEN owner END) = 1 THEN min(CASE WHEN direction = 'provides' THEN owner END) END AS owner, count(DISTINCT CASE WHEN direction = 'provides' THEN owner END) > 1 AS owner_ambiguous, len(list_distinct(list(source))) AS sources FROM s GROUP BY ALL")
def con_merge(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_contracts(_sightings(spark, d)).withColumn("sources", F.size("sources").cast("bigint"))


_MERGED = "m AS (SELECT namespace_key, direction, owner AS repo, CASE max(CASE strength WHEN 'exact' THEN 2 WHEN 'declared' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'declared' ELSE 'unresolved' END AS strength FROM (SELECT namespace_key, direction, strength, CASE WHEN direction = 'provides' THEN owner ELSE source END AS owner FROM s) GROUP BY ALL)"


def _repo_contracts(spark: SparkSession, d: str) -> DataFrame:
    s = _sightings(spark, d)
    s = s.withColumn("repo", F.when(F.col("direction") == "provides", F.col("owner")).otherwise(F.col("source")))
    rank = F.max(F.when(F.col("strength") == "exact", 2).when(F.col("strength") == "declared", 1).otherwise(0))
    return s.groupBy("kind", "namespace_key", "direction", "repo").agg(rank.alias("r")).select("kind", "namespace_key", "direction", "repo", F.when(F.col("r") == 2, "exact").when(F.col("r") == 1, "declared").otherwise("unresolved").alias("strength"))


@query(f"WITH {_SIGHT}, {_MERGED} SELECT p.namespace_key, c.repo AS consumer, p.repo AS provider, CASE WHEN p.strength = 'exact' AND c.strength = 'exact' THEN 'typed' ELSE 'import-guided' END AS band FROM m p JOIN m c ON p.namespace_key = c.namespace_key WHERE p.direction = 'provides' AND c.direction = 'consumes' AND p.strength <> 'unresolved' AND c.strength <> 'unresolved' AND p.repo <> c.repo")
def con_links(spark: SparkSession, d: str) -> DataFrame:
    links, _ = A.link_contracts(_repo_contracts(spark, d))
    return links.select("namespace_key", "consumer", "provider", "band")


@query(f"WITH {_SIGHT}, {_MERGED} SELECT 'provider' AS side, count(*) AS n FROM m WHERE direction = 'provides' AND namespace_key NOT IN (SELECT namespace_key FROM m WHERE direction = 'consumes' AND strength <> 'unresolved') HAVING count(*) > 0 UNION ALL SELECT 'consumer', count(*) FROM m WHERE direction = 'consumes' AND namespace_key NOT IN (SELECT namespace_key FROM m WHERE direction = 'provides' AND strength <> 'unresolved') HAVING count(*) > 0")
def con_unmatched(spark: SparkSession, d: str) -> DataFrame:
    _, lone = A.link_contracts(_repo_contracts(spark, d))
    return lone.select("side", "n")


@query("WITH s AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size <= 40), i AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < '1998-01-01'), c AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= '2000-01-01'), v AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_tax > 0.07 THEN l_linenumber END) > 1) SELECT 'contract.undocumented' AS kind, k AS key FROM i WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'contract.unimplemented', k FROM s WHERE k NOT IN (SELECT k FROM i) UNION ALL SELECT 'contract.orphan_consumer', k FROM c WHERE k NOT IN (SELECT k FROM i) UNION ALL SELECT 'contract.version_skew', k FROM v")
def con_drift(spark: SparkSession, d: str) -> DataFrame:
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    key = F.col("l_partkey").alias("key")
    return A.contract_drift(
        p.filter("p_size <= 40").select(F.col("p_partkey").alias("key")), li.filter("l_shipdate < '1998-01-01'").select(key), li.filter("l_shipdate >= '2000-01-01'").select(key),
        li.filter("l_tax > 0.07").select(key, F.col("l_linenumber").alias("version")),
    )
