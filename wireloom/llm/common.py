"""Helpers that the operators share: tables, the shared folder, ordered buckets."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of an ordered key are at most this many, whatever the input.
MAX_BUCKETS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and all runs in this machine's JVM."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="wireloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with an eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table written in the shared folder, whose size is known to the plans that read it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``written`` that no plan reads any more."""
    remove(df.sparkSession, df.written_at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that was written in the shared folder, on whatever store that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch at a few MB even where texts are very long: a batch ends at 512 rows or at 8 MB.

    Plans read these settings when they run, so they stay set in the session; smaller ones of the caller's are kept.
    """
    for name, most in (("maxRecordsPerBatch", 512), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def order_key(column: str) -> Column:
    """An integer key as a sort key; null comes before every number."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def bucket_bounds(df: DataFrame, key: Column, rows_per_bucket: int) -> list[int]:
    """Ascending lower bounds of buckets of about rows_per_bucket rows each, the first the smallest key.

    All bounds are keys that occur. Their number is at most MAX_BUCKETS, so they may go to the driver.
    """
    at_least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, low = df.agg(F.count("*"), F.min(key)).first()
    if not n:
        return []
    buckets = min(MAX_BUCKETS, max(at_least, n // rows_per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 4 * buckets)).alias("b")).first().b
    return sorted({low, *found})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that is not above key, by binary search."""
    if len(bounds) < 2:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    edges = F.lit(bounds)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: F.when(
            (low + step < len(bounds)) & (F.get(edges, low + step) <= key), low + step
        ).otherwise(low),
    )
