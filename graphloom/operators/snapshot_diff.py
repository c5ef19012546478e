"""What changed between consecutive full snapshots of a keyed table.

A full outer join on the primary key compares canonical row hashes: a missing
side is an addition or a removal, unequal hashes are a change.  Only the key
and a 64-bit hash travel through the shuffles.

Defined results: copies and outdated corrections are dropped first (latest
version wins, see ``valid_rows``); null is a value, also in the key's record
id; empty tables give no rows; the first snapshot of a group gives no rows;
JSON columns compare by value, and text that is not JSON compares as text;
extra columns take part in the comparison, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.rows import col, row_hash


def snapshot_pairs(snapshots: DataFrame, group: str, number: str) -> DataFrame:
    """(g, n, before, after): each snapshot number with its neighbours."""
    w = Window.partitionBy("g").orderBy("n")
    return (
        snapshots.select(col(group).alias("g"), col(number).alias("n")).filter("g is not null and n is not null").distinct()
        .select("g", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
    )


def snapshot_changes(
    table: DataFrame,
    snapshots: DataFrame,
    *,
    group: str,
    number: str,
    record: str,
    version: str,
    json_columns: Iterable[str] = (),
    ignore: Sequence[str] = (),
) -> DataFrame:
    """(g, n, id, change): records added, removed or changed against the snapshot before."""
    skipped = {group, number, record, version, *ignore}
    rows = table.select(
        col(group).alias("g"), col(number).alias("n"), col(record).alias("id"), col(version).alias("v"),
        row_hash(table, [c for c in table.columns if c not in skipped], json_columns).alias("h"),
    )
    w = Window.partitionBy("g", "n", "id").orderBy(F.col("v").desc_nulls_last(), F.col("h").desc())
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("g", "n", "id", "h")
    pairs = snapshot_pairs(snapshots, group, number)
    later = rows.join(pairs.filter("before is not null").select("g", "n"), ["g", "n"]).select("g", "n", "id", F.col("h").alias("h1"))
    earlier = (
        rows.join(pairs.filter("after is not null").select("g", "n", "after"), ["g", "n"])
        .select(F.col("g").alias("g0"), F.col("after").alias("n0"), F.col("id").alias("id0"), F.col("h").alias("h0"))
    )
    both = later.join(earlier, (F.col("g") == F.col("g0")) & (F.col("n") == F.col("n0")) & F.col("id").eqNullSafe(F.col("id0")), "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return (
        both.withColumn("change", change).filter("change is not null")
        .select(F.coalesce("g", "g0").alias("g"), F.coalesce("n", "n0").alias("n"), F.when(F.col("h1").isNull(), F.col("id0")).otherwise(F.col("id")).alias("id"), "change")
    )


def repository_changes(files: DataFrame, nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes of files and nodes, one row per record and later snapshot."""
    out = []
    for kind, table, record, json_columns in (("file", files, "file_id", ()), ("node", nodes, "node_id", ("props",))):
        d = snapshot_changes(table, snapshots, group="repo_id", number="snapshot_no", record=record, version="ingested_at", json_columns=json_columns)
        out.append(d.select(F.lit(kind).alias("record_kind"), F.col("g").alias("repo_id"), F.col("n").alias("snapshot_no"), F.col("id").alias("record_id"), F.col("change").alias("change_kind")))
    return out[0].unionByName(out[1])
