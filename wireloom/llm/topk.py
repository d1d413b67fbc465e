"""Exact top-k search with vector-approximation files.

Vectors of integers are written twice: exactly, and as an approximation file of one byte a component. A vector has 256 cells of
its own between its least and its largest component, so its approximation is its least component, the cells' width and
the cells. One matrix product of queries and cells bounds every inner product from both sides; where a vector's
components span less than 256 the cells are single integers and the bounds meet.

The approximations are scanned in stripes of STRIPE vectors against groups of QUERIES queries, in waves of 16 stripes, then
16 times as many, and so on. In a stripe a vector is out if its upper bound is below the k-th largest lower bound of that
stripe or of all waves before; each wave so leaves about 16 k candidates a query, whatever the input. After the last wave the
k-th lower bound of all candidates cuts them once more. Exact vectors are then read by the pairs that are left, in the order of
their bounds: first k for each query, then those whose bound reaches the k-th exact score so found; no other can be among the k.

Of equal vectors only the k + 1 smallest ids can matter, so only these go on, and copies don't multiply pairs. The
query set is stated, and every vector is met in stripes.

Vectors that are null or hold null or non-finite components (also after scaling) take no part, on either side. Ties go to the
smaller id, equal rows are answered and found once, vectors of another length are not compared; null ids take no part.
Scores are exact integers of any size in ranking; one beyond a long is reported as the long nearest to it. Empty tables
give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CELLS = 256
STRIPE, QUERIES, WAVE = 8192, 1024, 16
#: Queries whose bounds are held at once.
STEP = 128
#: Sums of integers below this are exact in doubles.
EXACT = 2.0**52

ROW = ["id", "h"]
PAIR = "query_id long, query_h long, vec_id long, vec_h long, lower double, upper double"


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) != float("inf")))
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    return F.when(vector.isNotNull() & F.coalesce(ok, F.lit(False)), F.transform(vector, lambda x: whole(x.cast("double") * scale) + 0.0))


def approximate(v: np.ndarray) -> tuple[float, float, bytes]:
    """(least component, width of a cell, cells): component i is in [least + width * cell, least + width * (cell + 1) - 1]."""
    if not len(v):
        return 0.0, 1.0, b""
    least = v.min()
    width = np.floor((v.max() - least) / CELLS) + 1
    return least, width, np.clip(np.floor((v - least) / width), 0, CELLS - 1).astype(np.uint8).tobytes()


def approximations(rows: DataFrame) -> DataFrame:
    """rows(id, h, d, v) as (id, h, d, least, width, cells)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [approximate(v) for v in b.v]
            yield pd.DataFrame({"id": b["id"], "h": b.h, "d": b.d, "least": [x[0] for x in got], "width": [x[1] for x in got], "cells": [x[2] for x in got]})

    return rows.select(*ROW, "d", "v").mapInPandas(run, "id long, h long, d int, least double, width double, cells binary")


def bounds(queries: np.ndarray, least: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of every inner product. Beyond exact doubles the bounds are widened by what rounding may take."""
    base = least * queries.sum(1)[:, None] + width * (queries @ cells.T)
    size = np.abs(queries).sum(1)[:, None] * (np.abs(least) + CELLS * width)
    err = np.where(size < EXACT, 0.0, size * 2.0**-40)
    lower = base + (width - 1) * np.minimum(queries, 0).sum(1)[:, None] - err
    return lower, base + (width - 1) * np.maximum(queries, 0).sum(1)[:, None] + err


def survivors(lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, own: int, k: int, t_lower: float, t_id: int) -> np.ndarray:
    """Positions that may be among one query's k best. Ids ascend; (t_lower, t_id) is the k-th best lower bound known."""
    other = ids != own
    if np.count_nonzero(other) >= k:
        low = np.where(other, lower, -np.inf)
        at = np.flatnonzero(low >= np.partition(low, len(low) - k)[len(low) - k])
        at = at[np.argsort(-low[at], kind="stable")[k - 1]]
        if (low[at], -ids[at]) > (t_lower, -t_id):
            t_lower, t_id = low[at], ids[at]
    return np.flatnonzero(other & ((upper > t_lower) | (upper == t_lower) & (ids <= t_id)))


def score_exactly(q: np.ndarray, v: np.ndarray) -> int:
    if np.abs(q).sum() * np.abs(v).max(initial=0.0) < EXACT:
        return int(q @ v)
    return sum(int(a) * int(b) for a, b in zip(q, v, strict=True))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(query_id, query_h, t_lower, t_id): each query's k-th best lower bound, where it has k candidates."""
    best = Window.partitionBy("query_id", "query_h").orderBy(F.desc("lower"), "vec_id", "vec_h")
    ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return ranked.where(F.col("n") == k).select("query_id", "query_h", F.col("lower").alias("t_lower"), F.col("vec_id").alias("t_id"))


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, its own id apart."""
    common.bound_arrow_batches(vectors.sparkSession)
    c, q = F.col, ["query_id", "query_h"]

    def ready(df: DataFrame) -> DataFrame:
        slim = df.select(c(key).cast("long").alias("id"), scaled(c(vector), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        return slim.select("id", "v", F.xxhash64("v").alias("h"), F.size("v").alias("d")).dropDuplicates(["id", "h", "v"])

    same = Window.partitionBy("h", "v").orderBy("id")
    rows = common.written(ready(vectors).withColumn("n", F.row_number().over(same)).where(c("n") <= k + 1).drop("n"), "vectors")
    asked = common.written(ready(queries).withColumnsRenamed({"id": "query_id", "h": "query_h"}), "queries")
    stripes = max(1, -(-rows.count() // STRIPE))
    groups = max(1, -(-asked.count() // QUERIES))
    dealt = lambda n, by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    cells = common.written(approximations(rows).withColumn("s", dealt(stripes, ROW)), "approximations")

    def run(asked: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(file):
            file = file.sort_values(ROW, kind="stable")
            ids, h = file["id"].to_numpy(), file.h.to_numpy()
            least, width = file.least.to_numpy(), file.width.to_numpy()
            of = np.frombuffer(b"".join(file.cells), np.uint8).reshape(len(file), -1).astype(float)
            for i in range(0, len(asked), STEP):
                some = asked.iloc[i : i + STEP]
                lower, upper = bounds(np.stack(some.v.to_numpy()), least, width, of)
                for j, x in enumerate(some.itertuples()):
                    at = survivors(lower[j], upper[j], ids, x.query_id, k, x.t_lower, x.t_id)
                    out.append(pd.DataFrame({"query_id": x.query_id, "query_h": x.query_h, "vec_id": ids[at], "vec_h": h[at], "lower": lower[j][at], "upper": upper[j][at]}))
        return pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in PAIR.split(", ")})

    found, first, size = None, 0, WAVE
    while first < stripes:
        last = min(stripes, first + size)
        spread = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        known = asked.join(_kth(found, k), q, "left") if found is not None else asked.withColumns({"t_lower": F.lit(None).cast("double"), "t_id": F.lit(None).cast("long")})
        known = known.withColumns({"t_lower": F.coalesce("t_lower", F.lit(float("-inf"))), "t_id": F.coalesce("t_id", F.lit(2**63 - 1))})
        left = known.select(*q, "v", "d", "t_lower", "t_id", dealt(groups, q).alias("g"), spread(first, last).alias("s"))
        right = cells.where((c("s") >= first) & (c("s") < last)).withColumn("g", spread(0, groups))
        wave = common.written(left.groupBy("g", "s", "d").cogroup(right.groupBy("g", "s", "d")).applyInPandas(run, PAIR), "candidates")
        found, first, size = wave if found is None else found.unionAll(wave), last, size * WAVE

    cut = found.join(_kth(found, k), q, "left")
    cut = cut.where("t_lower IS NULL OR upper > t_lower OR upper = t_lower AND vec_id <= t_id")
    order = Window.partitionBy(*q).orderBy(F.desc("upper"), "vec_id", "vec_h")
    cut = common.written(cut.withColumn("n", F.row_number().over(order)).select(*q, "vec_id", "vec_h", "upper", "n"), "pairs")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [score_exactly(x, y) for x, y in zip(b.q, b.v, strict=True)]
            near = [min(max(s, -(2**63)), 2**63 - 1) for s in scores]
            # Hexadecimal numbers of one length, for scores that a long doesn't tell apart.
            far = [f"{s + (1 << 4200):x}" if not -(2**63) < s < 2**63 - 1 else "" for s in scores]
            yield b[["query_id", "query_h", "vec_id"]].assign(size=[float(s) for s in scores], score=near, far=far)

    def read(pairs: DataFrame) -> DataFrame:
        met = pairs.join(rows.select(c("id").alias("vec_id"), c("h").alias("vec_h"), "v"), ["vec_id", "vec_h"]).join(asked.select(*q, c("v").alias("q")), q)
        # Rows whose ids and hashes are equal, of other lengths, are not compared.
        met = met.where("size(q) = size(v)").select(*q, "vec_id", "q", "v")
        return common.written(met.mapInPandas(exact, "query_id long, query_h long, vec_id long, size double, score long, far string"), "scores")

    done = read(cut.where(c("n") <= k))
    sure = done.groupBy(*q).agg(F.min("size").alias("least"), F.count("*").alias("m")).where(c("m") >= k)
    rest = cut.where(c("n") > k).join(sure, q, "left").where("least IS NULL OR upper >= least")
    done = done.unionAll(read(rest.select(*q, "vec_id", "vec_h")))
    best = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), F.desc("far"), "vec_id")
    return done.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
