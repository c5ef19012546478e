"""Search, vectors, chunking, masking, extraction and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import extractors as X
from graphloom.operators import search, vectors
from graphloom.plans import facts
from graphloom.plans.facts import ctes, table
from graphloom.plans.registry import query
from graphloom.plans.shared import materialise
from graphloom.streaming import jobs

_TERMS = ["deadline", "replica", "replay", "quota"]


def _bm25_sql(source: str, key: str, text: str, terms: list[str]) -> str:
    f = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) AS f{i}" for i, t in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    return (
        f"w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM {source}), c AS (SELECT {key}, len(words) AS len, {f} FROM w), "
        f"t AS (SELECT count(*) AS n, avg(len) AS avg, {d} FROM c) SELECT {key}, round({score}, 6) AS score FROM c, t WHERE {' + '.join(f'f{i}' for i in range(len(terms)))} > 0"
    )


@query("WITH " + _bm25_sql("documents", "doc_id", "text", sorted(_TERMS)))
def txt_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", _TERMS).withColumn("score", F.round("score", 6))


@query(ctes("latest", "g_nodes") + ", x AS (SELECT repo_id || '/' || node_id AS node, concat_ws(' ', name, qualified_name, doc) AS body FROM g_nodes), " + _bm25_sql("x", "node", "body", ["anchor", "harbor"]) + " ORDER BY 2 DESC, 1 LIMIT 50")
def txt_node_search(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best nodes for two words over names and documentation."""
    n = facts.latest_graph(spark, d, "name", "qualified_name", "doc")
    x = n.select(F.concat_ws("/", "repo_id", "node_id").alias("node"), F.concat_ws(" ", "name", "qualified_name", "doc").alias("body"))
    return search.bm25(x, "node", "body", ["harbor", "anchor"]).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "node").limit(50)


@query(ctes("latest", "g_nodes") + ", t AS (SELECT repo_id, node_id, name, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM g_nodes), s AS (SELECT repo_id, node_id, list_min(list_transform(words, lambda w: levenshtein(w, 'harbr') / greatest(length(w), 5))) AS score FROM t) SELECT repo_id, node_id, round(score, 6) AS score FROM s WHERE score <= 0.4")
def txt_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    n = facts.latest_graph(spark, d, "name").withColumn("key", F.struct("repo_id", "node_id"))
    return search.fuzzy(n, "key", {"name": 0.4}, "harbr").select("key.repo_id", "key.node_id", F.round("score", 6).alias("score"))


_SIM = """w AS (SELECT DISTINCT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ws, md5(coalesce(text, '')) AS m FROM documents), c AS (SELECT m, min(id) AS class_id FROM w GROUP BY 1),
s AS (SELECT DISTINCT id, array_to_string(ws[k:k + 4], ' ') AS h FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - 4)) AS k FROM w JOIN c ON class_id = id)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL), l AS (SELECT a, b, common / (x.n + y.n - common) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.85 * (x.n + y.n - common))"""


@query(f"WITH {_SIM}, k AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY 1) SELECT w.id AS doc_id, c.class_id, coalesce(k.links, 0) AS links FROM w JOIN c ON c.m = w.m LEFT JOIN k ON k.id = c.class_id")
def txt_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of equal texts and the number of classes at least 0.85 alike."""
    members, links = search.similar_classes(table(spark, d, "documents"), "doc_id", "text")
    n = links.select(F.col("a").alias("class_id")).union(links.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(n, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"WITH {_SIM} SELECT a, b, round(jaccard, 6) AS jaccard FROM l")
def txt_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, links = search.similar_classes(table(spark, d, "documents"), "doc_id", "text")
    return links.withColumn("jaccard", F.round("jaccard", 6))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_cosine_similarity(q.v, r.v) AS sim FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) SELECT query, neighbour, round(sim, 5) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, neighbour) AS rank FROM s QUALIFY rank <= 10")
def vec_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest rows of every twentieth vector, against all rows."""
    e = table(spark, d, "embeddings")
    return vectors.top_k_exact(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 10).select("query", "neighbour", F.round("similarity", 5).alias("similarity"), "rank")


@query("WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, r.label, list_cosine_similarity(q.v, r.v) AS sim FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY round(sim, 9) DESC, neighbour) <= 3) SELECT query, neighbour, label, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, neighbour) AS rank FROM t QUALIFY rank <= 10")
def vec_top_k_union(spark: SparkSession, d: str) -> DataFrame:
    """Three best per label, united, then the ten best of all."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    out = None
    for label in sorted(r[0] for r in e.select("label").distinct().collect()):  # labels are a closed set of ten
        part = vectors.top_k_exact(e.filter(F.col("label") == label), "vec_id", "embedding", q, 3).withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "neighbour")
    return out.select("query", "neighbour", "label", F.row_number().over(w).alias("rank")).filter("rank <= 10")


@query()
def vec_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """(queries, probes, recall): the inverted file against the exact search, with ten probes and as often twice as many as 0.9 takes."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    centres = vectors.fit_cells(e, "embedding", max(1, min(1000, e.count() // 50)))
    exact = materialise(vectors.top_k_exact(e, "vec_id", "embedding", q, 10), "exact")
    probes = 10
    while True:
        found = vectors.recall(vectors.top_k_cells(e, "vec_id", "embedding", q, 10, centres=centres, probes=probes), exact)
        found = materialise(found.select("queries", F.lit(probes).alias("probes"), F.round("recall", 3).alias("recall")), "recall")
        if probes >= len(centres) or (found.first()["recall"] or 1.0) >= 0.9:
            return found
        probes *= 2


@query()
def txt_masked(spark: SparkSession, d: str) -> DataFrame:
    """Sources with credential bytes overwritten at equal length."""
    s = table(spark, d, "sources").select(F.concat_ws("/", "file_id", "blob_sha").alias("version"), "text").dropDuplicates(["version"])
    return X.masked(s, "version", "text").filter("ranges > 0")


@query()
def ext_config_values(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(F.col("language").isin("json", "toml", "yaml", "xml", "properties"))
    return X.table_function(s, ["file_id", "blob_sha", "language", "text"], lambda f, b, lang, t: ((f, b, k, v) for k, v in X.config_values(lang, t)), "file_id string, blob_sha string, key string, value string").distinct()


# ---- streaming: each must give what its batch twin gives


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def str_daily(spark: SparkSession, d: str) -> DataFrame:
    feed = jobs.Feed(spark, d, "events")
    return jobs.run_available(jobs.daily_usage(feed.rows), "daily", feed)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS started, count(*) AS calls FROM s GROUP BY user_id, session")
def str_sessions(spark: SparkSession, d: str) -> DataFrame:
    feed = jobs.Feed(spark, d, "events")
    return jobs.run_available(jobs.sessions(feed.rows), "sessions", feed)


@query("SELECT user_id, start AS started, count(*) AS calls FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL HAVING count(*) > 2")
def str_rate(spark: SparkSession, d: str) -> DataFrame:
    feed = jobs.Feed(spark, d, "events")
    return jobs.run_available(jobs.rate(feed.rows), "rate", feed)


@query("SELECT a.event_id, b.event_id AS follow_up FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1800 SECOND WHERE a.event_type = 'error'")
def str_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_available(jobs.follow_ups(jobs.stream_of(spark, d, "events")), "follow-ups")


@query("SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def str_observed(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_available(jobs.observed(jobs.stream_of(spark, d, "events")), "observed")


@query("SELECT user_id, max(event_id) AS head, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def str_heads(spark: SparkSession, d: str) -> DataFrame:
    moved = jobs.run_available(jobs.heads(jobs.stream_of(spark, d, "events")), "heads")
    return moved.groupBy("user_id").agg(F.max("head").alias("head"), F.max_by("event_type", "head").alias("event_type"))
