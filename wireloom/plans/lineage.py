"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder serves only where that is unset and all runs in one JVM."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="wireloom-"))
    return f"{context.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


#: Tables of the open ``passing`` blocks, the innermost last.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that ``cut`` writes in the block are removed at its end; what it gives writes one that stays."""
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = cut(df.select("*"))
        made.pop()
        return out

    _passing.append(made)
    try:
        yield keep
    finally:
        _passing.remove(made)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark removes a job's shuffle files when it ends (else when the driver's garbage collector meets them). It stays set, as plans read it when they run.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the folder of spark.checkpoint.dir.

    A written table's size is known. A checkpoint keeps the estimate of the plan that it cuts, and as a join is
    estimated at the product of its sides, the digits of the estimates double from round to round. What is cut already stays.
    """
    if getattr(df, "is_cut", False):
        return df
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    # What a written table's job has shuffled isn't read again.
    spark.conf.set(CLEAN_SHUFFLES, "true")
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_cut = True
    return out


#: Tables written at a time: a small table's job leaves most of a cluster idle.
AT_ONCE = 4


def cut_all(*tables: DataFrame) -> list[DataFrame]:
    """``cut`` of tables that don't depend on each other, by jobs that run side by side."""
    shared_path(tables[0].sparkSession, "any")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(tables[0].sparkSession)(cut), tables))
