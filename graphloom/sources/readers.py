"""Readers of what lies outside tables: directory trees, git logs, graph documents, traces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.text import classified, detected_language, unportable
from graphloom.plans.shared import materialise


EXCLUDED = r"(^|/)(\.git|\.hg|\.svn|\.venv|node_modules|__pycache__|target)$"


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, language, outcome, content) of the files under ``root``.

    Folders are listed level by level on the executors, through Arrow's file
    systems: Spark's own file index hides names that begin with a dot or an
    underscore, which in a source tree are files like others.  Symbolic links
    are not followed; contents of secret, large, binary and unportable files
    are withheld.
    """
    base = root.rstrip("/")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            rows = []
            for folder in b["path"]:
                fs, inside = pyarrow.fs.FileSystem.from_uri(base) if "://" in base else (pyarrow.fs.LocalFileSystem(), base)
                for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{inside}/{folder}".rstrip("/"))):
                    if isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.islink(info.path):
                        continue
                    path = f"{folder}/{info.base_name}".lstrip("/")
                    rows.append((path, info.type == pyarrow.fs.FileType.Directory, info.size or 0))
            yield pd.DataFrame(rows, columns=["path", "folder", "size_bytes"])

    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        here = materialise(level.mapInPandas(listed, "path string, folder boolean, size_bytes long"), "listing")
        files = here.filter("not folder").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        level = here.filter("folder").filter(~F.col("path").rlike(EXCLUDED)).select("path").repartition("path")
        if level.isEmpty():
            break
    f = classified(detected_language(found).withColumnRenamed("detected", "language"))
    f = f.withColumn("outcome", F.when(F.col("outcome") == "redacted", "redacted").when(unportable(F.col("path")), "unportable").otherwise(F.col("outcome")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content, outcome = [], []
            for path, was in zip(b["path"], b["outcome"]):
                raw = None
                if was == "candidate":
                    fs, inside = pyarrow.fs.FileSystem.from_uri(base) if "://" in base else (pyarrow.fs.LocalFileSystem(), base)
                    with fs.open_input_stream(f"{inside}/{path}") as stream:
                        raw = stream.read()
                    if b"\x00" in raw[:8192]:
                        raw, was = None, "binary"
                content.append(raw.decode("utf-8", "replace") if raw is not None else None)
                outcome.append(was)
            yield b.assign(content=content, outcome=outcome)

    return f.select("path", "size_bytes", "language", "outcome").mapInPandas(read, "path string, size_bytes long, language string, outcome string, content string")


def numstat(log: DataFrame, column: str = "value") -> DataFrame:
    """(commit, author, ts, path, added, removed) of rows that each hold one commit of ``git log --numstat``.

    A commit's text starts with ``commit<TAB>author<TAB>seconds``; binary files count no lines.
    """
    lines = F.split(F.col(column), "\n")
    head = F.split(F.element_at(lines, 1), "\t")
    body = log.select(F.element_at(head, 1).alias("commit"), F.element_at(head, 2).alias("author"), F.timestamp_seconds(F.element_at(head, 3).cast("bigint")).alias("ts"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))
    n = F.split("line", "\t")
    return body.filter(F.size(n) == 3).select("commit", "author", "ts", F.element_at(n, 3).alias("path"), F.element_at(n, 1).try_cast("int").alias("added"), F.element_at(n, 2).try_cast("int").alias("removed"))


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, layers) of a graph JSON document; a node belongs to the first layer that lists it."""
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    each = doc.select(F.posexplode("layers").alias("position", "l")).select("position", F.col("l.id").alias("layer_id"), F.explode("l.nodeIds").alias("node_id"))
    return nodes, edges, each.groupBy("node_id").agg(F.min_by("layer_id", "position").alias("layer_id"))


def compiler_index(documents: DataFrame, column: str = "value") -> DataFrame:
    """(path, start_line, start_column, end_line, end_column, symbol, role) of a compiler index's documents in JSON rows; lines count from 1.

    A range of three numbers ends on its own line; the first bit of the roles marks a definition.  Local symbols are left out.
    """
    schema = "relative_path string, occurrences array<struct<range: array<int>, symbol: string, symbol_roles: int>>"
    rows = documents.select(F.from_json(column, schema).alias("d")).select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    at = lambda k: F.try_element_at("o.range", F.lit(k))
    short = F.size("o.range") == 3
    rows = rows.filter("path is not null and o.symbol is not null and size(o.range) in (3, 4)").filter(~F.col("o.symbol").startswith("local "))
    role = F.when(F.coalesce("o.symbol_roles", F.lit(0)) % 2 == 1, "definition").otherwise("reference")
    return rows.select("path", (at(1) + 1).alias("start_line"), at(2).alias("start_column"), (F.when(short, at(1)).otherwise(at(3)) + 1).alias("end_line"), F.when(short, at(3)).otherwise(at(4)).alias("end_column"), F.col("o.symbol").alias("symbol"), role.alias("role"))


def warehouse(spark: SparkSession, url: str, table: str, columns: list[str], *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """Columns of a database table over JDBC; with a numeric ``key`` the ranges from low to high are read side by side."""
    query = f"(SELECT {', '.join(columns)} FROM {table}) AS t"
    r = spark.read.format("jdbc").option("url", url).option("dbtable", query).option("fetchsize", 10_000)
    if key is not None and parts > 1:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def spans(traces: DataFrame, column: str = "value") -> DataFrame:
    """(trace, service, peer, ts) of server-to-server spans in OTLP/JSON rows."""
    schema = "resourceSpans array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>, scopeSpans: array<struct<spans: array<struct<traceId: string, startTimeUnixNano: string, attributes: array<struct<key: string, value: struct<stringValue: string>>>>>>>>>"
    parsed = traces.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r"))
    attr = lambda attrs, keys: F.try_element_at(F.transform(F.filter(attrs, lambda a: a["key"].isin(*keys)), lambda a: a["value"]["stringValue"]), F.lit(1))
    flat = parsed.select(attr(F.col("r.resource.attributes"), ["service.name"]).alias("service"), F.explode(F.flatten(F.col("r.scopeSpans.spans"))).alias("s"))
    out = flat.select(F.col("s.traceId").alias("trace"), "service", attr(F.col("s.attributes"), ["peer.service", "server.address"]).alias("peer"), F.timestamp_micros((F.col("s.startTimeUnixNano").cast("bigint") / 1000).cast("bigint")).alias("ts"))
    return out.filter("service is not null and peer is not null")
