"""Stored segments: validation, canonical order and hash, manifests, retention, overlays.

Validators return their violations as rows and never stop at the first; a
table without violations gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import col, row_hash
from graphloom.plans.shared import shared_dir

# The keys a segment's meta table holds, no more and no fewer.
META_KEYS = ("commit_sha", "engine_version", "language_matrix_version", "tool_version", "precise_sources", "profile", "repo_id", "repo_id_source", "repo_url", "schema_version")


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """(table, key, rows) of keys that stand in more than one row; null is a key value."""
    key = F.to_json(F.struct(*(col(k).alias(k) for k in keys)))
    return df.groupBy(*map(col, keys)).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.lit(table).alias("table"), key.alias("key"), "rows")


def orphans(df: DataFrame, table: str, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """(table, key, rows): foreign keys, not null, without a parent."""
    p = parent.select(*(col(k).alias(f"__{i}") for i, k in enumerate(pk))).distinct()
    there = F.lit(True)
    have = F.lit(True)
    for i, k in enumerate(fk):
        there = there & (col(k) == F.col(f"__{i}"))
        have = have & col(k).isNotNull()
    key = F.concat_ws("|", *(col(k).cast("string") for k in fk))
    return df.filter(have).join(p, there, "left_anti").groupBy(key.alias("key")).agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "key", "rows")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, key): rows for which a rule is not true."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), col(key).cast("string").alias("key"))


def meta_defects(meta: DataFrame) -> DataFrame:
    """(defect, key) of a meta table (key, value): missing, unknown, blank and repeated keys."""
    counted = meta.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce(F.length(F.trim("value")), F.lit(0))).alias("chars"))
    wanted = meta.sparkSession.createDataFrame([(k,) for k in META_KEYS], "key string")
    both = counted.join(wanted.withColumn("wanted", F.lit(True)), "key", "full_outer")
    defect = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "repeated").when((F.col("chars") == 0) & (F.col("key") != "precise_sources"), "blank")
    return both.select(defect.alias("defect"), "key").filter("defect is not null")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, checksum): of the rows as a multiset, whatever their order, partitioning and file layout."""
    h = row_hash(df, df.columns)
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod("h", F.lit(2**40))), F.lit(0)).alias("low"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("xor")).select("rows", F.sha2(F.concat_ws(":", "rows", "low", "xor"), 256).alias("checksum"))


def write_segment(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Refuse duplicate keys, write in identity order without overwriting, return the content hash."""
    if not duplicate_keys(df, path, keys).isEmpty():
        raise ValueError(f"duplicate keys in {path}")
    df.repartitionByRange(*map(col, keys)).sortWithinPartitions(*map(col, keys)).write.mode("errorifexists").parquet(path)
    return content_hash(df.sparkSession.read.parquet(path))


def open_segment(spark: SparkSession, path: str, schema: str, keys: Sequence[str], checksum: str, meta: DataFrame) -> DataFrame:
    """A stored segment, read with a fixed schema; refused if its meta, its keys or its content is not what it must be."""
    defects = [f"{r.defect} {r.key}" for r in meta_defects(meta).limit(10).collect()]
    if defects:
        raise ValueError(f"{path}: meta table: {', '.join(defects)}")
    df = spark.read.schema(schema).parquet(path)
    if not duplicate_keys(df, path, keys).isEmpty():
        raise ValueError(f"{path}: duplicate keys")
    if content_hash(df).first()["checksum"] != checksum:
        raise ValueError(f"{path}: content is not what was written")
    return df


def replace_document(spark: SparkSession, path: str, text: str) -> None:
    """Put a text in a file's place as a whole: readers see the old one or the new one, never a part."""
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, to, options)


def export_range(df: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """Rows of the days from first to last, written as JSON lines in the shared folder; the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    df.filter(col(day).between(first, last)).write.json(path)
    return spark.read.schema(df.schema).json(path)


def publish_manifest(previous: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(repo_id, segment): the previous rows, those of rebuilt repositories replaced."""
    return previous.join(rebuilt.select("repo_id"), "repo_id", "left_anti").select("repo_id", "segment").unionByName(rebuilt.select("repo_id", "segment"))


def retained(versions: DataFrame, now: Column, *, group: str | None = None, versions_kept: int = 30, days: int = 14) -> DataFrame:
    """Versions (version, created_at) that stay: the newest ``versions_kept`` or the last ``days`` days, whichever is more."""
    w = Window.partitionBy(*([col(group)] if group else [])).orderBy(F.col("version").desc())
    return versions.withColumn("__r", F.row_number().over(w)).filter((F.col("__r") <= versions_kept) | (F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))).drop("__r")


def unreferenced(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """Segments no kept manifest names."""
    return segments.join(manifests.select("segment"), "segment", "left_anti")


def overlay(remote: DataFrame, local: DataFrame, repo: Column | str = "repo_id") -> DataFrame:
    """Local rows replace every remote row of their repositories; ``origin`` says which is which."""
    key = repo if isinstance(repo, str) else "repo_id"
    kept = remote.join(local.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("remote"))
    return kept.unionByName(local.withColumn("origin", F.lit("local")))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], *, update: bool = True) -> DataFrame:
    """Insert or update on a natural key; with ``update`` off, rows already there stay."""
    if update:
        return current.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)
    return current.unionByName(incoming.join(current.select(*keys).distinct(), list(keys), "left_anti"))


def incremental(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): deleted, new, changed or unchanged, by digest."""
    a, b = before.select(col(key).alias("k0"), col(digest).alias("d0")), after.select(col(key).alias("k1"), col(digest).alias("d1"))
    both = a.join(b, F.col("k0") == F.col("k1"), "full_outer")
    change = F.when(F.col("k1").isNull(), "deleted").when(F.col("k0").isNull(), "new").when(F.col("d0").eqNullSafe(F.col("d1")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k0", "k1").alias("key"), change.alias("change"))


def cached(facts: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): facts found in a cache table under the whole key, and those to be made."""
    hits = facts.join(cache, list(keys), "inner")
    return hits, facts.join(cache.select(*keys).distinct(), list(keys), "left_anti")
