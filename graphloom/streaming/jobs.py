"""Structured Streaming jobs over event streams, and their batch twins' contract.

Each job takes a streaming DataFrame and returns one; ``run_available`` drains
what there is into a written table, so a job's result can be compared with the
batch query it stands for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import shared_dir


class Feed:
    """The table as a file stream, and a second source that says when no more will come.

    ``close`` adds one row of nulls, stamped long after all others, which moves
    the watermark past every window but its own, which therefore never comes out.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, stamp: str = "ts"):
        self.rows = stream_of(spark, sf_dir, name)
        self.stamp, self.folder = stamp, f"{shared_dir(spark)}/closing-{uuid.uuid4().hex}"
        self._row().limit(0).write.parquet(self.folder)
        self.rows = self.rows.unionByName(spark.readStream.schema(self.rows.schema).parquet(self.folder))

    def _row(self) -> DataFrame:
        from pyspark.sql import SparkSession as session

        spark = session.active()
        return spark.range(1).select(*(F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == self.stamp else F.lit(None).cast(f.dataType).alias(f.name) for f in self.rows.schema.fields))

    def close(self) -> None:
        self._row().write.mode("append").parquet(self.folder)


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parquet*")
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})  # watermarks need instants


def run_available(df: DataFrame, tag: str, feed: Feed | None = None) -> DataFrame:
    """Run in append mode until the input is drained, and until a ``feed`` is closed; the rows written.

    Each batch has a folder of its own, which a retry of the batch overwrites.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    def drain() -> None:
        df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()

    drain()
    for _ in range(2 if feed is not None else 0):  # the batch after the closing row's sees the watermark it moved
        feed.close()
        drain()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{base}/out").drop("batch")


def daily_usage(events: DataFrame) -> DataFrame:
    """Calls and errors per day; late events count within a day."""
    w = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"))
    return w.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("window.start").cast("date").cast("string").alias("day"), "calls", "errors")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap))
    return s.agg(F.min("ts").cast("timestamp_ntz").alias("started"), F.count("*").alias("calls")).select("user_id", "started", "calls")


def rate(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", limit: int = 2) -> DataFrame:
    """Principals over ``limit`` calls in a sliding window."""
    w = events.withWatermark("ts", width).groupBy("user_id", F.window("ts", width, step)).agg(F.count("*").alias("calls"))
    return w.filter(F.col("calls") > limit).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("started"), "calls")


def follow_ups(events: DataFrame, seconds: int = 1800) -> DataFrame:
    """Stream-stream interval join: calls of a principal soon after a failed one."""
    failed = events.filter("event_type = 'error'").select("event_id", F.col("ts").alias("t0"), F.col("user_id").alias("u0")).withWatermark("t0", "1 hour")
    later = events.select(F.col("event_id").alias("follow_up"), F.col("ts").alias("t1"), F.col("user_id").alias("u1")).withWatermark("t1", "1 hour")
    on = F.expr(f"u0 = u1 AND event_id <> follow_up AND t1 >= t0 AND t1 <= t0 + INTERVAL {seconds} SECONDS")
    return failed.join(later, on).select("event_id", "follow_up")


def observed(events: DataFrame) -> DataFrame:
    """Repeated sightings within the watermark dropped: one row per principal, tool and day."""
    e = events.withWatermark("ts", "2 days").withColumn("day", F.to_date("ts").cast("string"))
    return e.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def heads(events: DataFrame) -> DataFrame:
    """Custom state: the latest head per principal, one row whenever a batch moves it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        moved = False
        for b in batches:
            i = b["event_id"].idxmax()
            now = (int(b.loc[i, "event_id"]), str(b.loc[i, "event_type"]))
            if best is None or now[0] > best[0]:
                best, moved = now, True
        if moved:
            state.update(best)
            yield pd.DataFrame({"user_id": [key[0]], "head": [best[0]], "event_type": [best[1]]})

    out = "user_id bigint, head bigint, event_type string"
    return events.groupBy("user_id").applyInPandasWithState(keep, out, "head bigint, event_type string", "append", GroupStateTimeout.NoTimeout)


def change_feed(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Each arriving batch of (path, digest) rows is handed on once, its newest row per path only."""

    def latest(batch: DataFrame, number: int) -> None:
        apply(batch.groupBy("path").agg(F.max_by("digest", "seen_at").alias("digest")), number)

    files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(latest).trigger(availableNow=True).start().awaitTermination()
