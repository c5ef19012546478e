"""Tables written in the cluster's shared folder, to cut lineage.

``materialise`` writes a DataFrame once and reads it back, so that a loop's
plan stays short and a lost executor costs no recomputation of earlier rounds.
Tables are deleted by ``release``, or else when the application ends.
The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
is another chosen: a temporary folder on ``local[...]`` masters, the SQL
warehouse folder (shared by definition) elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        if not _LOCAL_DIR:
            _LOCAL_DIR.append(tempfile.mkdtemp(prefix="graphloom-"))
        return "file://" + _LOCAL_DIR[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)  # what nothing releases goes with the application
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``materialise`` that no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
