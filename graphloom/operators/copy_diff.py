"""Differences between two copies of one dataset, field by field.

Both copies are laid over one key space: a key's position is its 64-bit hash,
so that skewed key columns spread evenly.  First only hashes travel: a key's
128 bits and the row hash of its valid version on either side.  A checksum tree
over the key space (row count, xor and sum of row hashes per range) is built
bottom-up from leaf ranges of ``LEAF_ROWS`` keys on average; starting at the
root, only ranges whose checksums differ are divided further.  Fields are read
and compared only for the keys of differing leaves whose row hashes differ.

Defined results: latest version of a key wins; null and empty text are equal;
null key columns compare as values; two empty copies give no rows; a key in
one copy only gives one ``missing_in_<other>`` row; columns outside keys and
fields are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rows import col
from graphloom.plans.shared import materialise

LEAF_ROWS = 8
FAN_BITS = 8


def canonical_copy(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], version: str, side: int) -> DataFrame:
    """side, k*, f*, version v, row hash h and the key's two hashes q0 and q1, whose leading bits are its place."""
    ks = [f"k{i}" for i in range(len(keys))]
    fs = [f"f{i}" for i in range(len(fields))]
    out = df.select(
        *(col(k).alias(a) for a, k in zip(ks, keys)),
        *(F.coalesce(c.cast("string"), F.lit("")).alias(a) for a, c in zip(fs, fields.values())),
        col(version).alias("v"),
    )
    flagged = [x for k in ks for x in (F.col(k), F.col(k).isNull())]
    return out.select(F.lit(side).alias("side"), *ks, *fs, "v", F.xxhash64(*flagged, *fs).alias("h"), F.xxhash64(*flagged).alias("q0"), F.xxhash64(F.lit(1), *flagged).alias("q1"))


def _latest(side: int, *columns: str) -> Column:
    """The greatest (v, h, ...) of one side; null where the side lacks the key."""
    return F.max(F.when(F.col("side") == side, F.struct("v", "h", *columns))).alias(f"s{side}")


def differing_leaves(hashed: DataFrame, bits: int) -> DataFrame:
    """Leaf ranges of ``hashed`` (q0, h0, h1) whose checksums differ, found by descending from the root."""
    sums = [x for s in (0, 1) for x in (
        F.count(f"h{s}").alias(f"n{s}"), F.expr(f"coalesce(bit_xor(h{s}), 0)").alias(f"x{s}"), F.coalesce(F.sum(F.shiftrightunsigned(f"h{s}", 32)), F.lit(0)).alias(f"s{s}"),
    )]
    level = materialise(hashed.groupBy(F.shiftrightunsigned("q0", 64 - bits).alias("range")).agg(*sums), "checksums")
    again = [*(F.sum(c).alias(c) for c in ("n0", "n1", "s0", "s1")), *(F.expr(f"bit_xor({c})").alias(c) for c in ("x0", "x1"))]
    levels = [level]
    while bits > 0:
        bits -= FAN_BITS
        level = level.groupBy(F.shiftrightunsigned("range", FAN_BITS).alias("range")).agg(*again)
        levels.append(level)
    unequal = "n0 <> n1 OR x0 <> x1 OR s0 <> s1"
    found = levels[-1].filter(unequal).select("range")
    for level in reversed(levels[:-1]):
        child = level.filter(unequal).select("range", F.shiftrightunsigned("range", FAN_BITS).alias("parent"))
        found = child.join(found.withColumnRenamed("range", "parent"), "parent", "left_semi").select("range")
    return found


def copy_differences(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_fields: Mapping[str, Column], right_fields: Mapping[str, Column],
    version: str, names: tuple[str, str], leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """keys + difference, left_value, right_value: one row per missing row or differing field."""
    if list(left_fields) != list(right_fields):
        raise ValueError("both copies need the same fields")
    bits = min(48, max(1, math.ceil(math.log2(max(2, max(left.count(), right.count()) / leaf_rows)))))
    both = canonical_copy(left, keys, left_fields, version, 0).unionByName(canonical_copy(right, keys, right_fields, version, 1))
    hashed = both.groupBy("q0", "q1").agg(_latest(0), _latest(1)).select("q0", "q1", F.col("s0.h").alias("h0"), F.col("s1.h").alias("h1"))
    hashed = materialise(hashed, "hashes")
    found = differing_leaves(hashed, bits)
    asked = hashed.filter(~F.col("h0").eqNullSafe(F.col("h1"))).withColumn("range", F.shiftrightunsigned("q0", 64 - bits)).join(found, "range", "left_semi")
    asked = materialise(asked.select("q0", "q1"), "asked")
    ks = [f"k{i}" for i in range(len(keys))]
    fs = [f"f{i}" for i in range(len(left_fields))]
    pair = both.join(asked, ["q0", "q1"], "left_semi").groupBy(*ks).agg(_latest(0, *fs), _latest(1, *fs))
    text = "struct<difference:string,left_value:string,right_value:string>"
    differing = F.filter(
        F.array(*(
            F.when(F.col("s0." + f) != F.col("s1." + f), F.struct(F.lit(name).alias("difference"), F.col("s0." + f).alias("left_value"), F.col("s1." + f).alias("right_value"))).cast(text)
            for f, name in zip(fs, left_fields)
        )),
        lambda x: x.isNotNull(),
    )
    missing = lambda side: F.array(F.struct(F.lit(f"missing_in_{side}").alias("difference"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")).cast(text))
    what = F.when(F.col("s0").isNull(), missing(names[0])).when(F.col("s1").isNull(), missing(names[1])).otherwise(differing)
    return pair.select(*(F.col(k).alias(name) for k, name in zip(ks, keys)), F.explode(what).alias("d")).select(*map(col, keys), "d.*")


def _own(name: str) -> Column:
    """A name without its own project and the dot after it."""
    prefix = F.concat("project", F.lit("."))
    return F.when(F.startswith(name, prefix), F.substring(F.col(name), F.length(prefix) + 1, F.length(name))).otherwise(F.col(name))


def engine_answers(df: DataFrame) -> dict[str, Column]:
    return {
        "caller": _own("caller"), "callee": _own("callee"), "strategy": F.col("strategy"),
        "confidence": F.when(F.col("confidence").isNotNull(), F.format_string("%.8e", F.col("confidence"))),
        "reason": F.col("reason"), "label": F.col("label"), "qn": _own("qn"), "def_file": F.col("def_file"), "signature": F.col("signature"),
    }


def engine_differences(vendored: DataFrame, reference: DataFrame) -> DataFrame:
    """Where two engines' answers about the same code differ."""
    return copy_differences(
        vendored, reference, keys=["corpus", "category", "file", "start_byte", "end_byte"],
        left_fields=engine_answers(vendored), right_fields=engine_answers(reference), version="emitted_at", names=("vendored", "reference"),
    )
