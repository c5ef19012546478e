"""Joins on overlapping ranges and on nearness in time, made equi-joins by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_width: int) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans [start, end) overlap; each pair once, by the first bin they share."""
    ls, le, rs, re_ = *left_span, *right_span
    cut = lambda s, e: F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bin_width))
    a = left.filter(F.col(ls) < F.col(le)).withColumn("__bin", F.explode(cut(ls, le)))
    b = right.filter(F.col(rs) < F.col(re_)).withColumn("__bin", F.explode(cut(rs, re_)))
    hit = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("__bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_width))
    return a.join(b, [*keys, "__bin"]).filter(hit).drop("__bin")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs with right_ts in [left_ts, left_ts + seconds]; time is cut into bins of that width, so a row meets two bins."""
    micros: Column = F.unix_micros(F.col(left_ts).cast("timestamp"))
    other: Column = F.unix_micros(F.col(right_ts).cast("timestamp"))
    width = seconds * 1_000_000
    a = left.withColumn("__bin", F.explode(F.array(F.floor(micros / width), F.floor(micros / width) + 1)))
    b = right.withColumn("__bin", F.floor(other / width))
    return a.join(b, [*keys, "__bin"]).filter((other >= micros) & (other <= micros + width)).drop("__bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """For each left row the latest right row not after it, by one sort per key: no pair is ever formed."""
    from pyspark.sql import Window

    side = lambda df, ts, s: df.select(*keys, F.col(ts).alias("__ts"), F.lit(s).alias("__side"), *(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in dict.fromkeys([*left.columns, *values])if c not in keys))
    both = side(right, right_ts, 0).unionByName(side(left, left_ts, 1))
    w = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    for c in values:
        both = both.withColumn(c, F.last(F.when(F.col("__side") == 0, F.struct(F.col(c))), ignorenulls=True).over(w)[c])
    return both.filter("__side = 1").drop("__side", "__ts")
