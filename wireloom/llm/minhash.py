"""Near copies by exact Jaccard similarity of shingle sets, with SimHash components and MinHash bands as candidates.

SimHash fingerprints of the same shingles are linked by ``simhash.links`` (byte-position inverted index, count filtering, at most
three bits); each component is a bucket of candidates. Three bits seldom reach a similarity of 0.8, so MinHash bands add buckets:
bands of ROWS minima each, in which a pair of similarity s meets in one of BANDS bands with probability 1 - (1 - s^ROWS)^BANDS, which is
0.99993 at 0.8 and more above it. Equal sets meet before the bands, so copies never make pairs. In each bucket all members
are compared with its least one; buckets that are not yet of one component then compare all members of different components.
Every link has been verified: shingles are 64-bit hashes, intersections are counted in full.

Nulls and texts without words have the empty set, and are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Words in a shingle, least similarity that links, minima in a band, and bands.
WORDS, SIMILARITY, ROWS, BANDS = 5, 0.8, 5, 24
#: Keys that go to all executors at once; more are shuffled.
FEW = 1_000_000
_RANDOM = np.random.default_rng(42)
MULTIPLY = _RANDOM.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' XXH64, ascending."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A hash for each band of the minima of a set that is not empty."""
    import xxhash

    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):  # bounded, however long the text is
        x = found[i : i + 4096] * MULTIPLY + ADD
        x ^= x >> np.uint64(32)
        low = np.minimum(low, (x * np.uint64(0x9E3779B97F4A7C15)).min(1))
    return [xxhash.xxh64_intdigest(b.tobytes(), 42) - (1 << 63) for b in low.reshape(BANDS, ROWS)]


def signatures(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rows(r1, r2, id, text) as (r1, r2, id, fp, n, sim, bands): fp names the set, n is its size, sim is the SimHash of all shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            sets, sims = [], []
            for t in b.text:
                hashes = simhash.shingle_hashes(t, words)
                sets.append(np.unique(np.array(hashes, np.uint64)))
                sims.append(simhash.majority(hashes))
            fp = [xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63) for s in sets]
            out = b[["r1", "r2"]].assign(id=b["id"].astype("Int64"), fp=fp, n=[len(s) for s in sets], sim=np.array(sims, np.uint64).view(np.int64))
            yield out.assign(bands=[bands(s) if len(s) else [] for s in sets])

    common.bound_arrow_batches(rows.sparkSession)
    return rows.mapInPandas(run, "r1 long, r2 long, id long, fp long, n int, sim long, bands array<long>")


def simhash_groups(signed: DataFrame) -> DataFrame:
    """(fp, n, band, value): the sets by SimHash component, as a band after the others. A set whose texts repeat shingles
    unlike often may be in several."""
    sims = common.written(signed.where("n > 0").select("fp", "n", "sim").distinct(), "simhashes")
    roots = simhash.components(simhash.links(sims.select(F.col("sim").alias("fp")).distinct()))
    of = sims.join(roots.withColumnRenamed("node", "sim"), "sim", "left").select("fp", "n", F.lit(BANDS).alias("band"), F.coalesce("root", "sim").alias("value"))
    return common.written(of.distinct(), "simhash-groups")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """rows(fp, text) as (fp, hashes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fp": b.fp, "hashes": [shingles(t, words).view(np.int64) for t in b.text]})

    return rows.mapInPandas(run, "fp long, hashes array<long>")


def link_bucket(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join all members at similarity ``least`` or more, given components known before."""
    roots = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    found = []
    for i in range(len(fps)):
        far = roots != roots[i]
        if not far.any():
            if (roots == roots[0]).all():
                break
            continue
        far &= (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])) & (np.arange(len(fps)) > i)
        if not far.any():
            continue
        own = np.sort(sets[i])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        total = np.concatenate([[0], np.cumsum(own[at] == flat)])
        shared = total[ends] - total[ends - sizes]
        for j in np.flatnonzero(far & (shared >= least * (sizes + sizes[i] - shared))):
            if roots[j] != roots[i]:
                found.append((int(fps[i]), int(fps[j])))
                roots[roots == roots[j]] = roots[i]
    return found


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def components(rows: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """rows(r1, r2, id, text), where rows of equal (r1, r2) are equal, as (r1, r2, id, root): root names the component of near copies."""
    signed = common.written(signatures(rows, words), "minhash")
    nodes = signed.groupBy("fp").agg(F.min(F.struct("r1", "r2")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = common.written(nodes, "shingle-sets")
    postings = nodes.select("fp", "n", F.posexplode("bands").alias("band", "value")).unionByName(simhash_groups(signed))
    buckets = postings.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("fp").alias("low"), F.bit_xor(F.xxhash64("fp")).alias("mix")).where("size > 1")
    # Bands that hold the same members are looked at once.
    buckets = common.written(buckets.groupBy("size", "low", "mix").agg(F.min(F.struct("band", "value")).alias("x")).select("size", "low", "x.*"), "buckets")
    members = common.written(postings.join(buckets, ["band", "value"]).select("band", "value", "size", "low", "fp", "n"), "members")
    met = members.select("fp").distinct()
    rows_met = nodes.join(_few(met), "fp", "left_semi").select("fp", F.col("row.r1").alias("r1"), F.col("row.r2").alias("r2"))
    rows_met = common.written(rows_met, "rows-met")
    texts = rows.join(_few(rows_met), ["r1", "r2"]).select("fp", "text")
    sets = common.written(_sets(texts, words).dropDuplicates(["fp"]), "sets")
    near = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    low = nodes.select(F.col("fp").alias("low"), F.col("n").alias("m"))
    pairs = members.where("fp != low").select("fp", "low", "n").distinct().join(low, "low").where(near(F.col("n"), F.col("m"))).select("low", "fp")
    sized = pairs.join(sets.select(F.col("fp").alias("low"), F.col("hashes").alias("x")), "low").join(sets.withColumnRenamed("hashes", "y"), "fp")
    shared = F.size(F.array_intersect("x", "y"))
    links = sized.where(shared >= least * (F.size("x") + F.size("y") - shared)).select(F.col("low").alias("a"), F.col("fp").alias("b"))
    links = common.written(links, "links")
    roots = simhash.components(links)
    rooted = members.where("size > 2").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = common.written(rooted.select("band", "value", "fp", "root"), "rooted")
    split = rooted.groupBy("band", "value").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("band", "value")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp")
        found = link_bucket(group.fp.to_numpy(), group.root.to_numpy(), list(group.hashes), least)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = rooted.join(split, ["band", "value"]).join(sets, "fp").groupBy("band", "value").applyInPandas(run, "a long, b long")
    more = common.written(more, "links")
    if not more.isEmpty():
        roots = simhash.components(links.unionAll(more))
    return signed.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("r1", "r2", "id", F.coalesce("root", "fp").alias("root"))
