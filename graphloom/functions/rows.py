"""Row-level helpers shared by the operators: canonical hashes, valid rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no layout; other text is kept as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _hashable(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def row_hash(df: DataFrame, columns: Sequence[str], json_columns: Iterable[str] = ()) -> Column:
    """64-bit hash of the named columns, null being a value of its own.

    ``xxhash64`` skips nulls, so each column is hashed with its null flag;
    columns are taken in sorted order of their names.
    """
    parts: list[Column] = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    json_columns = set(json_columns)
    for name in sorted(columns):
        c = canonical_json(col(name)) if name in json_columns else _hashable(col(name), kinds[name])
        parts += [c, col(name).isNull()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def valid_rows(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of each key, the row with the latest ``version``.

    Null keys group together and a null version comes last.  Rows of equal key
    and version are copies of one another; should they differ, the one with the
    greatest row hash is taken, so the result never depends on input order.
    """
    tie = row_hash(df, [c for c in df.columns if c not in keys])
    w = Window.partitionBy(*map(col, keys)).orderBy(col(version).desc_nulls_last(), tie.desc())
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
