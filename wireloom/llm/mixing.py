"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue (by a hash of seed and id), for as many epochs as ``most`` allows. An
entry's virtual finish time is its source's words up to its end over the source's weight. All entries are range-sorted by
it, and the stream is truncated where its running total reaches the total budget. A source that is spent has no more
entries, so the others go on and share its excess by weight; nothing but the truncation decides what is taken.

``whole=True`` takes whole documents; the one that the budget ends in stays if at least half of it fits.
``whole=False`` queues words: a document is a run of entries of one word. Only words near the cut need an order of their own:
the truncated stream of documents gives a virtual time by which the budget is spent, the service up to it gives a time
before which it can't be, and the words between these two are sorted, by the virtual times of their middles, and truncated
one by one. A source's words are then within one word of its fair share.

The ``target`` column is the fair share: sources share the budget by weight; a target stops at ``most`` times its source's
size and the excess is shared again by weight until none is above.

Running sums come from range-partitioned sorts and the sums of their partitions, so neither a source nor the whole stands
in one task; a row number in the cut table parts rows that are equal.

A null text has size 0, a null source is a source (last); ties in the hash go by id, repeated rows stand in the queue
as often as they come; documents without words take nothing and stay once (``times`` 1); an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240607

def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_order(df: DataFrame, order: list, add: str, label: str) -> DataFrame:
    """df with ``label``_rank (from 1) and ``label``_sum (running sum of add) in the global order.

    A range-partitioned sort, cut in the shared folder so that partition numbers hold; sums of partitions, a row
    each, give every partition's start.
    """
    ranged = common.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.sum(add).alias("__s"))
    starts = starts.select("__p", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__s0"))
    inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({"__r": F.row_number().over(inside), "__t": F.sum(add).over(inside)}).join(starts, "__p")
    return out.withColumns({f"{label}_rank": F.col("__r") + F.col("__n0"), f"{label}_sum": F.col("__t") + F.col("__s0")}).drop("__p", "__i", "__r", "__t", "__n0", "__s0")


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """sources(source, weight, source_size) with target; each round is one distributed aggregate."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        new = (budget - row["full"]) / row["weight"] if row["weight"] else level or 0.0
        if level is not None and new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.lit(float(level)) * F.col("weight")))


def weighted(rows: DataFrame, weights: list[float]) -> DataFrame:
    """(source, source_size, weight, start): start is the words of all sources before; weights repeat in code-point order, null last."""
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = global_order(each, [F.col("source").asc_nulls_last()], "source_size", "source")
    number = F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int")
    weight = F.get(F.lit([float(w) for w in weights]), number)
    return common.cut(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_sum") - F.col("source_size")).alias("start")))


def queue(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(id, source, size, h, u) with row (its number), before (words of its source that stand before it), source_size and weight."""
    c = F.col
    placed = global_order(rows, [c("source").asc_nulls_last(), "h", "id", "size", "u"], "size", "queue")
    s = sources.withColumnRenamed("source", "source2")
    joined = placed.join(s, c("source").eqNullSafe(c("source2")))
    return common.cut(joined.select(c("queue_rank").alias("row"), "id", "source", "size", (c("queue_sum") - c("size") - c("start")).alias("before"), "source_size", "weight"))


def _words(stream: DataFrame, budget: int) -> DataFrame:
    """(row, epoch, served): of entries that may be cut inside, the words that the truncation at the budget leaves."""
    c = F.col
    high = stream.where(c("stream_sum") >= budget).agg(F.min("finish")).first()[0]
    if high is None:
        return stream.select("row", "epoch", c("words").alias("served"))
    spent = F.least(c("words"), F.greatest(F.lit(0.0), F.lit(high) * c("weight") - c("begin")))
    # One entry of a source is in service at a time.
    inside = (c("begin") < F.lit(high) * c("weight")) & (F.lit(high) <= c("finish"))
    service, rate, n = stream.agg(F.sum(spent), F.sum(F.when(inside, c("weight"))), F.count(F.when(inside, 1))).first()
    # A queue may be half a word ahead of its service.
    low = max(0.0, high - (max(0.0, service - budget) + n / 2) / rate) if rate else 0.0
    upto = lambda v, more: F.least(c("words"), F.greatest(F.lit(0), F.floor(F.lit(v) * c("weight") - c("begin")) + more)).cast("long")
    entries = stream.select("row", "epoch", "source", "weight", "begin", "words", upto(low, -1).alias("sure"), upto(high, 2).alias("reach"))
    base = entries.agg(F.sum("sure")).first()[0] or 0
    near = entries.where("reach > sure").select("row", "epoch", "source", "begin", "weight", F.explode(F.expr("sequence(sure + 1, reach)")).alias("word"))
    near = near.select("row", "epoch", "source", "word", ((c("begin") + c("word") - 0.5) / c("weight")).alias("middle"), F.lit(1).alias("one"))
    line = global_order(near, ["middle", c("source").asc_nulls_last(), "row", "epoch", "word"], "one", "word")
    kept = line.where(c("word_sum") + base <= budget).groupBy("row", "epoch").agg(F.count("*").alias("served"))
    sure = entries.where("sure > 0").select("row", "epoch", c("sure").alias("served"))
    return sure.unionAll(kept).groupBy("row", "epoch").agg(F.sum("served").alias("served"))


def mix(documents: DataFrame, weights: list[float] | None = None, share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, stream).

    rows: id, source, size, source_size, target, taken (words), times (epochs in which the row has a place). stream: the
    same ids in the global order of virtual finish times, with position, words served and the running total of words.
    """
    c = F.col
    h = F.xxhash64(F.lit(seed), "id")
    slim = documents.select(c(key).cast("long").alias("id"), c(source).cast("string").alias("source"), sizes(c(text)).alias("size"))
    slim = common.cut(slim.withColumns({"h": h, "u": F.monotonically_increasing_id()}))
    sources = weighted(slim, weights or [3.0, 1.0, 2.0])
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    budget = math.floor(total)
    aimed = targets(sources, total, most).select(c("source").alias("source2"), "target")
    queued = queue(slim, sources)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))).alias("epoch")
    begin = c("before") + c("epoch") * c("source_size")
    entries = queued.select("row", "id", "source", "size", "weight", "before", "source_size", epochs).withColumn("begin", begin)
    entries = entries.withColumn("words", F.least(c("size"), F.floor(c("source_size") * F.lit(float(most))) - c("begin")).cast("long")).where("words > 0")
    entries = entries.select("row", "id", "source", "weight", "epoch", "begin", "words", ((c("begin") + c("words")) / c("weight")).alias("finish"))
    stream = common.cut(global_order(entries, ["finish", c("source").asc_nulls_last(), "row", "epoch"], "words", "stream"))
    if whole:
        fits = 2 * (F.lit(budget) - (c("stream_sum") - c("words"))) >= c("words")
        served = stream.where(fits).select("row", "epoch", c("words").alias("served"))
    else:
        served = _words(stream, budget)
    served = common.cut(served.where("served > 0"))
    got = served.groupBy("row").agg(F.sum("served").alias("taken"), F.count("*").alias("times"))
    rows = queued.join(got, "row", "left").join(aimed, c("source").eqNullSafe(c("source2")))
    times = F.when(c("size") == 0, 1).otherwise(F.coalesce("times", F.lit(0)))
    rows = rows.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), times.cast("int").alias("times"))
    stream = stream.join(served, ["row", "epoch"]).select("id", "source", "epoch", "finish", "served", c("stream_rank").alias("position"), c("stream_sum").alias("running_total"))
    return rows, stream


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
