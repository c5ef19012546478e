"""Cosine search over float vectors: exact in blocks, or by an inverted file of k-means cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
FIT_ROWS = 20_000
FIT_ROUNDS = 12


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _dims(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector; null and empty ones have no direction and take no part."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))


def top_k_exact(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, *, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, neighbour, similarity, rank): the k nearest other rows of each query row.

    Queries go out in blocks of bounded size; each task scores its batches of rows
    against a block and keeps its k best so far, and only those meet in the final ranking.
    """
    rows = _dims(df, vector).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = _dims(queries, vector).select(F.col(key).alias("id"), F.col(vector).alias("v")).dropDuplicates(["id"])
    n = asked.count()
    out = None
    for i in range(max(1, -(-n // block))):
        part = asked if n <= block else asked.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == i)
        shared = df.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids = np.array([q for q, _ in shared.value])
            q = _unit([v for _, v in shared.value]) if len(ids) else None
            near, value = None, None
            for b in batches:
                if q is None or not len(b):
                    continue
                sims = q @ _unit(list(b["v"])).T
                own = b["id"].to_numpy()
                sims[ids[:, None] == own[None, :]] = -np.inf
                owners = np.broadcast_to(own, sims.shape)
                if near is not None:
                    sims, owners = np.hstack((value, sims)), np.hstack((near, owners))
                m = min(k + 1, sims.shape[1])
                if m < sims.shape[1]:
                    by = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    border = np.take_along_axis(sims, by, axis=1).min(axis=1)
                    # Equal similarities up to rounding are ranked by id, so the least ids of those at the border stay.
                    for i in np.flatnonzero((sims >= border[:, None] - 1e-9).sum(axis=1) > m):
                        by[i] = np.lexsort((owners[i], -np.round(sims[i], 9)))[:m]
                    owners, sims = np.take_along_axis(owners, by, axis=1), np.take_along_axis(sims, by, axis=1)
                near, value = owners, sims
            if near is not None:
                keep = np.isfinite(value).ravel()
                yield pd.DataFrame({"query": np.repeat(ids, near.shape[1])[keep], "neighbour": near.ravel()[keep], "similarity": value.ravel()[keep]})

        kind = rows.schema["id"].dataType.simpleString()
        found = rows.mapInPandas(score, f"query {kind}, neighbour {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "neighbour")
    return out.dropDuplicates(["query", "neighbour"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fit_cells(df: DataFrame, vector: str, cells: int, *, fit_rows: int = FIT_ROWS, seed: int = 7) -> np.ndarray:
    """k-means centres on the unit sphere, fitted on at most ``fit_rows`` rows (the smallest hashes of their vectors)."""
    sample = _dims(df, vector).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(fit_rows).collect()
    x = _unit([r[0] for r in sample])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def top_k_cells(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, *, centres: np.ndarray, probes: int = 10) -> DataFrame:
    """(query, neighbour, similarity, rank) among the ``probes`` nearest cells; every row is indexed."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema[key].dataType.simpleString()

    def assign(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    sims = _unit(list(b["v"])) @ shared.value.T
                    m = min(n, sims.shape[1])
                    yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": list(np.argpartition(-sims, m - 1, axis=1)[:, :m].astype("int32"))})

        return run

    rows = _dims(df, vector).select(F.col(key).alias("id"), F.col(vector).alias("v")).dropDuplicates(["id"])
    asked = _dims(queries, vector).select(F.col(key).alias("id"), F.col(vector).alias("v")).dropDuplicates(["id"])
    schema = f"id {kind}, v array<float>, cell array<int>"
    indexed = rows.mapInPandas(assign(1), schema).select(F.col("id").alias("neighbour"), F.col("v").alias("nv"), F.explode("cell").alias("cell"))
    probing = asked.mapInPandas(assign(probes), schema).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.explode("cell").alias("cell"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sim = F.try_divide(dot("qv", "nv"), F.sqrt(dot("qv", "qv")) * F.sqrt(dot("nv", "nv")))
    pairs = probing.join(indexed, "cell").filter("query <> neighbour").select("query", "neighbour", sim.alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of exact neighbours that were found."""
    hit = exact.select("query", "neighbour").join(found.select("query", "neighbour").withColumn("hit", F.lit(1)), ["query", "neighbour"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
