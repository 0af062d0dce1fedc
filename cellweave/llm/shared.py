"""Where shared files go, how input size is measured, and small plan helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Unset, it is a temporary folder in local mode (tests) and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), "cellweave-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Memory settings of Python workers (glibc's and Arrow's), by which what a task has freed goes back to the system: idle workers stay small.
_LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def lean_workers(spark: SparkSession) -> None:
    """Python workers of functions that are made from now on give back what they free; settings that the session has stay."""
    for name, value in _LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


#: Spark's setting by which the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for the rows that a Parquet scan decodes at once, and how many of them where rows hold long arrays.
_SCANNED, LONG_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 128
#: Spark's setting for the rows of an Arrow batch, and how many scans go into one where rows hold long arrays.
_BATCH, SCANS = "spark.sql.execution.arrow.maxRecordsPerBatch", 8


def cut(df: DataFrame, name: str = "cut", scanned: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors; shuffle files go once it is written.

    scanned: rows that Parquet scans of df decode at once, which bounds what they hold of long arrays; Arrow batches have SCANS times as many."""
    spark = df.sparkSession
    path, wanted = shared_dir(spark, name), {_CLEANUP: "true"} | ({_SCANNED: str(scanned), _BATCH: str(SCANS * scanned)} if scanned else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut has written, once all that was made of them is written too."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path is not None:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows, by one distributed sum."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts_for(total: int, each: int, least: int) -> int:
    return max(least, math.ceil(total / each))


def utf8(column: str | Column) -> Column:
    """Text as UTF-8 bytes; null is the empty string."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("binary"), F.lit(b"").cast("binary"))


def blob_groups(spark: SparkSession) -> int:
    """Buckets for blob exchanges: a few for each shuffle partition, so that hashing evens out."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
