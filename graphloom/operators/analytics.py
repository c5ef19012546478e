"""Metrics and estate analytics: aggregates and windows over fact tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vocab import BANDS, DRAWN, STRENGTHS
from graphloom.plans.shared import materialise


def loc(start: Column, end: Column) -> Column:
    """Lines of a span; null without a valid span."""
    return F.when((start >= 1) & (end >= start), end - start + 1)


def zero_filled_bands(df: DataFrame, keys: list[str], band: str, weight: Column | None = None) -> DataFrame:
    """(keys, one column per band): counts for all eleven bands, zeros present."""
    counts = [F.coalesce(F.sum(F.when(F.col(band) == b, weight if weight is not None else F.lit(1))), F.lit(0)).cast("bigint").alias(b.replace("-", "_")) for b in BANDS]
    return df.groupBy(*keys).agg(*counts)


def degraded(files: Column, failed: Column, skipped: Column, truncated: Column) -> Column:
    """More than a twentieth failed or skipped for size, in integers; or anything truncated."""
    return ((failed + skipped) * 20 > files) | truncated


def co_change(commit_files: DataFrame, *, most_files: int = 20, least_shared: int = 3) -> DataFrame:
    """(a, b, shared, coupling): files changed together; wide commits are no evidence and are left out, as the rule has it."""
    cf = commit_files.select("commit_id", "file_id").distinct()
    narrow = cf.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most_files)).select("commit_id")
    cf = cf.join(narrow, "commit_id", "left_semi")
    per_file = cf.groupBy("file_id").agg(F.count("*").alias("commits"))
    a, b = cf.select("commit_id", F.col("file_id").alias("a")), cf.select("commit_id", F.col("file_id").alias("b"))
    pairs = a.join(b, "commit_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)
    na, nb = per_file.select(F.col("file_id").alias("a"), F.col("commits").alias("ca")), per_file.select(F.col("file_id").alias("b"), F.col("commits").alias("cb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "shared", (F.col("shared") / F.least("ca", "cb")).alias("coupling"))


def percent_rank(df: DataFrame, value: str, alias: str) -> DataFrame:
    """(rank - 1) / (n - 1) over all rows; null values rank first.

    Distinct values are sorted into ranges, one for each shuffle partition; only
    the ranges' totals meet in one task, and each range is summed on its own.
    """
    df = materialise(df, "ranked")
    counts = df.groupBy(F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    counts = materialise(counts.repartitionByRange("__value").withColumn("__part", F.spark_partition_id()), "ranks")
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("__part").agg(F.sum("__n").alias("__n"))
    totals = totals.select("__part", ahead(Window.orderBy("__part")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    ranked = counts.withColumn("__inside", ahead(Window.partitionBy("__part").orderBy("__value"))).join(F.broadcast(totals), "__part")
    ranked = ranked.select("__value", (F.col("__before") + F.col("__inside")).alias("__below"), "__all")
    share = F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(0.0)
    return df.join(ranked, F.col(value).eqNullSafe(F.col("__value"))).withColumn(alias, share).drop("__value", "__below", "__all")


def hotspots(churn: DataFrame, complexity: DataFrame) -> DataFrame:
    """(file_id, score, hotspot): percentile of churn x percentile of the greatest complexity; the top decile of scores are hotspots."""
    c = percent_rank(churn.join(complexity, "file_id"), "churn", "pc")
    c = percent_rank(c, "complexity", "px").withColumn("score", F.round(F.col("pc") * F.col("px"), 9))
    return percent_rank(c, "score", "ps").select("file_id", "churn", "complexity", "score", (F.col("ps") >= 0.9).alias("hotspot"))


def bus_factor(changes: DataFrame) -> DataFrame:
    """(file_id, authors, bus_factor, top_author): the fewest authors, greatest first, that cover half of a file's changes."""
    w = Window.partitionBy("file_id").orderBy(F.col("n").desc(), "author_id")
    per = changes.groupBy("file_id", "author_id").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("file_id")))
    return per.groupBy("file_id").agg(F.count("*").alias("authors"), F.count_if(F.col("before") * 2 < F.col("total")).alias("bus_factor"), F.min_by("author_id", F.struct((-F.col("n")).alias("n"), "author_id")).alias("top_author"))


def merge_contracts(sightings: DataFrame) -> DataFrame:
    """(kind, namespace_key, direction, strength, owner, owner_ambiguous, sources): sightings of one contract as one row.

    Directions join to ``both``; the strongest identity wins; only providers own, and several owners leave none.
    """
    rank = F.lit(0)
    for i, s in enumerate(STRENGTHS):
        rank = F.when(F.col("strength") == s, i).otherwise(rank)
    provides = F.col("direction").isin("provides", "both")
    g = sightings.groupBy("kind", "namespace_key").agg(
        F.bool_or(provides).alias("p"), F.bool_or(F.col("direction").isin("consumes", "both")).alias("c"), F.max(rank).alias("r"),
        F.count_distinct(F.when(provides, F.col("owner"))).alias("owners"), F.min(F.when(provides, F.col("owner"))).alias("one"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return g.select(
        "kind", "namespace_key", F.when(F.col("p") & F.col("c"), "both").when(F.col("p"), "provides").otherwise("consumes").alias("direction"),
        F.element_at(F.array(*(F.lit(s) for s in STRENGTHS)), F.col("r") + 1).alias("strength"), F.when(F.col("owners") == 1, F.col("one")).alias("owner"), (F.col("owners") > 1).alias("owner_ambiguous"), "sources",
    )


def link_contracts(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unmatched): providers x consumers of one contract between owners; drawn only where both identities are known.

    Provider-consumer pairs of one key are the result itself; keys are the unit of distribution and AQE splits skewed ones.
    """
    p = contracts.filter(F.col("direction").isin("provides", "both")).select("kind", "namespace_key", F.col("repo").alias("provider"), F.col("strength").alias("ps"))
    c = contracts.filter(F.col("direction").isin("consumes", "both")).select("kind", "namespace_key", F.col("repo").alias("consumer"), F.col("strength").alias("cs"))
    known = lambda x: F.col(x) != "unresolved"
    band = F.when((F.col("ps") == "exact") & (F.col("cs") == "exact"), "typed").otherwise("import-guided")
    links = p.filter(known("ps")).join(c.filter(known("cs")), ["kind", "namespace_key"]).filter("provider <> consumer").select("kind", "namespace_key", "consumer", "provider", band.alias("band"))
    lone_p = p.join(c.filter(known("cs")).select("kind", "namespace_key"), ["kind", "namespace_key"], "left_anti").groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit("provider").alias("side"), "n")
    lone_c = c.join(p.filter(known("ps")).select("kind", "namespace_key"), ["kind", "namespace_key"], "left_anti").groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit("consumer").alias("side"), "n")
    return links, lone_p.unionByName(lone_c)


def contract_drift(specified: DataFrame, implemented: DataFrame, consumed: DataFrame, versions: DataFrame) -> DataFrame:
    """(kind, key): undocumented, unimplemented, orphan consumers and version skew."""
    s, i, c = (x.select("key").distinct() for x in (specified, implemented, consumed))
    skew = versions.groupBy("key").agg(F.count_distinct("version").alias("n")).filter("n > 1").select("key")
    parts = {"contract.undocumented": i.join(s, "key", "left_anti"), "contract.unimplemented": s.join(i, "key", "left_anti"), "contract.orphan_consumer": c.join(i, "key", "left_anti"), "contract.version_skew": skew}
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "key")
        out = df if out is None else out.unionByName(df)
    return out


def forbidden(edges: DataFrame, roles: DataFrame, from_role: str, to_role: str) -> DataFrame:
    """Drawn edges from one role to another."""
    a, b = roles.select(F.col("node").alias("src"), F.col("role").alias("ra")), roles.select(F.col("node").alias("dst"), F.col("role").alias("rb"))
    return edges.filter(F.col("band").isin(*DRAWN)).join(a, "src").join(b, "dst").filter((F.col("ra") == from_role) & (F.col("rb") == to_role)).select("src", "dst", "band")


def required(edges: DataFrame, roles: DataFrame, from_role: str, to_roles: list[str]) -> DataFrame:
    """Nodes of a role without a drawn edge to any of the roles they must use."""
    b = roles.filter(F.col("role").isin(*to_roles)).select(F.col("node").alias("dst"))
    served = edges.filter(F.col("band").isin(*DRAWN)).join(b, "dst", "left_semi").select(F.col("src").alias("node"))
    return roles.filter(F.col("role") == from_role).select("node").join(served, "node", "left_anti")


def byte_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Whole rows from the front of each group while their sizes fit the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__used", F.sum(size).over(w)).filter(F.col("__used") <= budget).drop("__used")


def forbidden_contexts(edges: DataFrame, members: DataFrame, pairs: list[tuple]) -> DataFrame:
    """(src, dst, band, from_context, to_context): drawn edges between contexts of which a rule forbids it; members (node, context)."""
    a, b = members.select(F.col("node").alias("src"), F.col("context").alias("from_context")), members.select(F.col("node").alias("dst"), F.col("context").alias("to_context"))
    met = edges.filter(F.col("band").isin(*DRAWN)).join(a, "src").join(b, "dst")
    wrong = F.lit(False)
    for x, y in pairs:
        wrong = wrong | ((F.col("from_context") == x) & (F.col("to_context") == y))
    return met.filter(wrong).select("src", "dst", "band", "from_context", "to_context")


def forbidden_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): members of cycles of two nodes or more; a cycle is named by its greatest member."""
    from graphloom.operators.graph import strong_components

    c = strong_components(edges)
    several = c.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return c.join(several, "component", "left_semi").select("node", F.col("component").alias("cycle"))


def paged(df: DataFrame, order: list[Column], limit: int, view: str, asked: str, *, cursor: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """A page, its (total, has_more) and the next page's cursor: view, digest of the question, offset.

    A cursor of another view or question is stale and raises an error.
    """
    digest = hashlib.md5(asked.encode()).hexdigest()
    offset = 0
    if cursor is not None:
        known, was, offset_text = cursor.rsplit(":", 2)
        if (known, was) != (view, digest):
            raise ValueError("stale cursor")
        offset = int(offset_text)
    rows, total = page(df, order, limit, offset)
    return rows, total, f"{view}:{digest}:{offset + limit}"


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of an ordered listing, and (total, has_more)."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows, df.agg(F.count("*").alias("total")).select("total", (F.col("total") > offset + limit).alias("has_more"))
