"""Graphs that arrive as a stream of JSON documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import derive, refine
from ..sources import json_graphs


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files that appear under path, a document a line."""
    found = spark.readStream.schema(json_graphs.DOCUMENT).json(path)
    return found.withColumn("graph_id", F.xxhash64(F.to_json(F.struct("graph_name", "nodes", "hyperedges", "Inputs", "Outputs"))))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def equality_classes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For each batch, (batch, graph_id, class_id) by equality inside the batch; a batch that is run again overwrites its part."""

    def work(batch: DataFrame, number: int) -> None:
        graphs = json_graphs.to_tables(batch.dropDuplicates(["graph_id"]))
        refine.equality_classes(graphs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream, work, checkpoint)


def node_facts(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For each batch, the facts of its nodes."""

    def work(batch: DataFrame, number: int) -> None:
        derive.node_facts(json_graphs.to_tables(batch.dropDuplicates(["graph_id"]))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(stream, work, checkpoint)
