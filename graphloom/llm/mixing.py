"""Mixing sources to target shares by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queued; a document's
virtual finish time is its source's cumulative tokens divided by the source's
weight, repeats of a source following its first pass.  Documents of all
sources are then range-sorted by finish time and the queue is cut where the
total budget is spent, so the shares at the cut are the target shares except
for sources that ran out of documents and repeats.

Prefix sums have three levels (blocks of buckets, buckets, rows), so no source,
however large, meets one task.  Before the sort the finish time of the cut is
bounded from the sources' sums, and copies that finish later are never made.

Defined results: source names compare in lower case without outer blanks;
documents of other or null sources, without a doc_id, and null or empty texts, take no part;
repeated doc_ids are one document; targets of null, zero or negative weight
and targets without documents get nothing, the others keep their proportions;
null max_repeats counts as 1; equal finish times are ordered by source,
repeat and doc_id.  The budget defaults to the tokens of one pass over all
sources with a target: a source that runs dry leaves its part to the others, in
proportion to their weights, and ``shares`` says how much it is short.
``UNTIL_DRY`` stops at the largest total at which no source has run dry.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import map_rows
from graphloom.plans.shared import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public split pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET_ROWS = 20_000
# Buckets whose totals one task adds up, at each level of a running total.
FAN = 1024
UNTIL_DRY = -1


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): whole texts in tokens of a public tokenizer."""

    def emit(doc_id, source, text):
        yield doc_id, source, len(tokenizer(path).encode_ordinary(text)) if text else 0

    return map_rows(documents, ["doc_id", "source", "text"], emit, "doc_id bigint, source string, tokens bigint")


def clean_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def running_totals(df: DataFrame, group: list[str], bucket: str, order: list[str], size: str, alias: str) -> DataFrame:
    """Inclusive running total of ``size`` in (bucket, order), per group, by three levels.

    Rows are summed inside their bucket, buckets inside blocks of ``FAN``, and
    only the blocks' totals of a group, a millionth of the rows, meet in one task.
    """
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = df.groupBy(*group, bucket).agg(F.sum(size).alias("__t")).withColumn("__block", F.floor(F.col(bucket) / FAN))
    blocks = totals.groupBy(*group, "__block").agg(F.sum("__t").alias("__t")).select(*group, "__block", ahead("__t", before(group, "__block")).alias("__blocks"))
    totals = totals.select(*group, bucket, "__block", ahead("__t", before([*group, "__block"], bucket)).alias("__buckets")).join(blocks, [*group, "__block"])
    totals = totals.select(*group, bucket, (F.col("__blocks") + F.col("__buckets")).alias("__before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(totals, [*group, bucket]).withColumn(alias, F.col("__before") + F.sum(size).over(inside)).drop("__before")


def last_finish(queues: list[tuple[float, int, int]], budget: int) -> float:
    """A finish time past which nothing fits the budget, for queues of (weight, tokens in all, longest document).

    A queue has sent at least its weight's part up to its current document, or all it holds.
    """

    def sent(t: float) -> float:
        return sum(held if t * w >= held else max(0.0, t * w - longest) for w, held, longest in queues)

    low, high = 0.0, max((held / w for w, held, _ in queues), default=0.0) * 1.000001 + 1.0
    if sent(high) <= budget:
        return high
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (low, middle) if sent(middle) > budget else (middle, high)
    return high


def mixture(documents: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 17, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, copy, tokens, finish, total): the documents chosen, in order of ``finish``."""
    wanted = targets.select(clean_source(F.col("source")).alias("source"), "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))
    wanted = wanted.filter("source is not null and weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("repeats").alias("repeats"))
    docs = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").filter("doc_id is not null and text <> ''")
    docs = docs.join(wanted.select("source"), "source", "left_semi").select("doc_id", "source", "text")
    sized = materialise(token_counts(docs, tokenizer_path).filter("tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")), "tokens")
    sums = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("pass_tokens"), F.max("tokens").alias("longest"))
    live = wanted.join(sums, "source")
    # One row per source with a target, as the table of targets has.
    queues = [(float(r["weight"]), r["pass_tokens"], int(r["repeats"]), r["longest"], r["documents"]) for r in live.collect()]
    if budget is None:
        budget = sum(q[1] for q in queues)
    elif budget == UNTIL_DRY:
        budget = int(min((n * k / w for w, n, k, _, _ in queues), default=0) * sum(q[0] for q in queues))
    end = last_finish([(w, n * k, longest) for w, n, k, longest, _ in queues], budget)
    parts = max(256, sum(q[4] for q in queues) // BUCKET_ROWS)
    shuffled = sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    shuffled = shuffled.withColumn("order", F.shiftrightunsigned("order", 1)).withColumn("bucket", F.floor(F.col("order") / (2**63 / parts)).cast("long"))
    queued = running_totals(shuffled, ["source"], "bucket", ["order", "doc_id"], "tokens", "sent").join(live.drop("longest", "documents"), "source")
    # Only the copies that finish before the end; what finishes later cannot fit.
    passes = F.floor((F.lit(end) * F.col("weight") - F.col("sent")) / F.col("pass_tokens"))
    queued = queued.withColumn("passes", F.least(F.col("repeats").cast("bigint") - 1, passes).cast("int")).filter("passes >= 0")
    queued = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    queued = queued.withColumn("finish", (F.col("copy") * F.col("pass_tokens") + F.col("sent")) / F.col("weight"))
    queued = queued.withColumn("slot", F.least(F.floor(F.col("finish") / end * (parts * 16)), F.lit(parts * 16)).cast("long"))
    ordered = running_totals(queued.select("source", "doc_id", "copy", "tokens", "finish", "slot"), [], "slot", ["finish", "source", "copy", "doc_id"], "tokens", "total")
    return ordered.filter(F.col("total") <= budget).select("source", "doc_id", "copy", "tokens", "finish", "total")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, records, tokens, most_copies, share, short_share): what each target got, and what it lacks."""
    t = targets.select(clean_source(F.col("source")).alias("source"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).alias("weight")).filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"))
    everything = Window.partitionBy()
    got = chosen.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("most_copies"))
    out = t.join(got, "source", "left").na.fill(0, ["records", "tokens", "most_copies"])
    target, share = F.col("weight") / F.sum("weight").over(everything), F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(everything)), F.lit(0.0))
    return out.select(
        "source", F.round(target, 6).alias("target_share"), "records", "tokens", F.col("most_copies").cast("int").alias("most_copies"),
        F.round(share, 6).alias("share"), F.round(F.greatest(target - share, F.lit(0.0)), 6).alias("short_share"),
    )
