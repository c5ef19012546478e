"""Queries over the text tables; added to the registry only where this subpackage exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks, mixing, pairs, provenance, secrets, spans, syntax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.parsed(table(spark, sf_dir, "sources")).filter("not valid").select("file_id", "blob_sha")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(syntax.parsed(table(spark, sf_dir, "sources")))


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.against_status(syntax.parsed(table(spark, sf_dir, "sources")), table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_lines(table(spark, sf_dir, "sources")).select("file_id", "blob_sha", "line_no").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.masked_texts(table(spark, sf_dir, "sources"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs(*(table(spark, sf_dir, t) for t in ("nodes", "files", "snapshots", "sources")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).filter("origin in ('doc', 'comment')").select("repo_id", "node_id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.judged(table(spark, sf_dir, "sources"), table(spark, sf_dir, "upstream"), only_verdicts=True).select("repo_id", "file_id").distinct()


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = provenance.judged(table(spark, sf_dir, "sources"), table(spark, sf_dir, "upstream"))
    return out.select("repo_id", "file_id", "blob_sha", "path", "language", "reason", F.round("containment", 6).alias("containment"), "origin")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout")).select("item_id", "doc_id").distinct()


def p8_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.removal_spans(leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout")))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares ``p9_mixture`` reaches, beside the targets they drift from where sources end."""
    targets = table(spark, sf_dir, "mix_target")
    return mixing.shares(p9_mixture(spark, sf_dir), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"))


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_stretches(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_status, p3_found, p3_masked, p6_found, p6_pairs, p7_found, p7_reasons, p8_found, p8_removals, p9_mixture, p9_shares, p10_found, p10_shared, p10_stretches)}
_PHRASES = """WITH w AS (SELECT item_id, string_split(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ' ') AS words FROM heldout),
d AS (SELECT DISTINCT doc_id, string_split(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ' ') AS words FROM documents),
i AS (SELECT item_id, array_to_string(words[k:k + 14], ' ') AS phrase FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - 14)) AS k FROM w)),
p AS (SELECT doc_id, array_to_string(words[k:k + 14], ' ') AS phrase FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 14)) AS k FROM d))
"""
_GRAMS = """WITH g AS (SELECT doc_id, k, hash(substr(text, k, 200)) AS h FROM (SELECT DISTINCT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS k FROM documents WHERE length(text) >= 200)),
d AS (SELECT DISTINCT h, doc_id FROM g), m AS (SELECT h FROM d GROUP BY 1 HAVING count(*) > 1)
"""
ORACLE: dict[str, str] = {
    "p8_found": _PHRASES + "SELECT DISTINCT item_id, doc_id FROM i JOIN p USING (phrase)",
    "p8_removals": _PHRASES + """, h AS (SELECT DISTINCT i.item_id, q.doc_id, q.k FROM i JOIN (SELECT doc_id, k, array_to_string(words[k:k + 14], ' ') AS phrase FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 14)) AS k FROM d)) q USING (phrase)),
o AS (SELECT *, max(k + 13) OVER (PARTITION BY doc_id ORDER BY k, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR k - 1 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k, item_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT doc_id, min(k) - 1 AS first_word, max(k) + 13 AS last_word, count(DISTINCT item_id) AS items FROM g GROUP BY doc_id, run""",
    "p10_found": _GRAMS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_stretches": _GRAMS + """, w AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200, true) AS begins FROM g SEMI JOIN m USING (h)),
r AS (SELECT doc_id, k, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM w) SELECT doc_id, min(k) - 1 AS start, max(k) + 200 - min(k) AS chars FROM r GROUP BY doc_id, run""",
    "p10_shared": _GRAMS + """, w AS (SELECT doc_id, least(200, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 200)) AS gained FROM g SEMI JOIN m USING (h)), c AS (SELECT doc_id, sum(gained) AS shared FROM w GROUP BY 1),
t AS (SELECT doc_id, max(coalesce(length(text), 0)) AS chars FROM documents GROUP BY 1) SELECT t.doc_id, chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN chars = 0 THEN 0.0 ELSE round(coalesce(shared, 0) / chars, 6) END AS share FROM t LEFT JOIN c ON c.doc_id = t.doc_id""",
}
