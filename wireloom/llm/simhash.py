"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints have eight bytes. Two that differ in at most three bits share at least five of their eight positional
bytes. The index's terms are triples of positional bytes: the eight triples inside positions 0-3 or inside 4-7, of which
any five shared positions hold at least one whole, so no link is lost. (Terms of one byte would have N/256 entries each,
whatever N, and tally N^2 pairs.) In each term's postings the shared positional bytes of a pair are tallied, pairs with
fewer than five go, and the differing bits of the rest are counted.

Equal fingerprints meet before the index, so copies never make pairs. A term with more than SMALL postings gets, as
its postings, terms of two more positional bytes (the other two shared positions that the count guarantees); a term of five bytes
leaves 24 bits, so it has at most 2^24 postings, and large ones are linked in one bounded array without making pairs.
Components come from label propagation with pointer jumping over checkpointed links.

Nulls and texts without words have fingerprint zero and link like any other; ties and repeated rows share a fingerprint;
a row with null id takes part, and its component is the smallest id that is not null, null if there is none. An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in a shingle unless a contract says otherwise, and differing bits that still link.
WORDS, BITS = 5, 3
#: Postings of a term that are compared pair by pair on the JVM.
SMALL = 32
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """The shingles' XXH64 (seed 42) in the order of the text, repeats included; none without words."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is 09-0D and 20
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), 42)] if tokens else []
    body = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(tokens) - words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(body[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def simhash(text: str | None, words: int) -> int:
    """Bits that are set in over half of the shingles' hashes; zero without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded, however long the text is
        part = np.array(hashes[i : i + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp holds the fingerprint's bits in a signed long."""
    slim = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(t, words) for t in b.body], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "fp": fp})

    common.bound_arrow_batches(df.sparkSession)
    return slim.mapInPandas(run, "id long, fp long")


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    """The positional bytes, packed."""
    mask = 0
    for p in positions:
        mask |= 255 << (8 * p)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def _terms(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("kind"), _bytes(fp, s).alias("value")) for i, s in enumerate(sets)])


def tally(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(_bytes(x, (p,)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _pairs(postings: DataFrame, bits: int) -> DataFrame:
    """Links inside terms of SMALL postings at most."""
    lists = postings.groupBy("kind", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    later = lambda a, i: F.slice("fps", i + 2, SMALL)
    keep = lambda a: lambda b: (tally(a, b) >= 8 - bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    links = F.flatten(F.transform("fps", lambda a, i: F.transform(F.filter(later(a, i), keep(a)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(links).alias("l")).select("l.a", "l.b")


def link_array(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each component of distinct fingerprints, where at most ``bits`` bits differ.

    Up to 8192 members every pair is compared; more, which agree on all but 24 bits, look up all flips of those bits.
    """
    fps = np.unique(fps.astype(np.uint64))
    n = len(fps)
    label = np.arange(n)
    if n <= 8192:
        near = [np.flatnonzero(np.bitwise_count(fps ^ x) <= bits) for x in fps]

        def rounds(label: np.ndarray) -> np.ndarray:
            for row in near:
                label[row] = label[row].min()
            return label
    else:
        free = np.bitwise_or.reduce(fps ^ fps[0])
        places = [1 << i for i in range(64) if int(free) >> i & 1]
        flips = [np.uint64(sum(c)) for k in range(1, bits + 1) for c in combinations(places, k)]

        def rounds(label: np.ndarray) -> np.ndarray:
            for m in flips:
                at = np.minimum(np.searchsorted(fps, fps ^ m), n - 1)
                hit = fps[at] == fps ^ m
                np.minimum.at(label, np.flatnonzero(hit), label[at[hit]])
            return label

    while True:
        before = label.copy()
        label = rounds(label)
        label = label[label]
        if (label == before).all():
            return fps.view(np.int64), fps[label].view(np.int64)


def _dense(postings: DataFrame, bits: int) -> DataFrame:
    """Links from each posting of a term of five bytes to the smallest of its component there."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = link_array(group.fp.to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"a": a, "b": b})[a != b]

    return postings.groupBy("kind", "value").applyInPandas(run, "a long, b long")


def _by_size(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of terms of 2 to SMALL, and of more."""
    sizes = index.groupBy("kind", "value").count().where("count > 1")
    sized = index.join(sizes, ["kind", "value"])
    return sized.where(F.col("count") <= SMALL).drop("count"), sized.where(F.col("count") > SMALL).drop("count")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that at most three differing bits connect."""
    if bits > 3:
        raise ValueError("the index guarantees links of at most three bits")
    index = fps.select("fp", F.inline(_terms(F.col("fp"), TRIPLES)))
    small, large = _by_size(index)
    # Two more of the other five positions for each term of too many postings.
    fives = sorted({tuple(sorted((*t, *more))) for t in TRIPLES for more in combinations([p for p in range(8) if p not in t], 2)})
    number = {f: i for i, f in enumerate(fives)}
    of_kind = F.array(*[F.array(*[F.lit(number[tuple(sorted((*t, *m)))]) for m in combinations([p for p in range(8) if p not in t], 2)]) for t in TRIPLES])
    value = F.get(F.array(*[_bytes(F.col("fp"), f) for f in fives]), F.col("kind"))
    deeper = large.select("fp", F.explode(F.get(of_kind, F.col("kind"))).alias("kind")).distinct().select("fp", "kind", value.alias("value"))
    few, many = _by_size(deeper)
    return _pairs(small, bits).unionAll(_pairs(few, bits)).unionAll(_dense(many, bits)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: the smallest node reachable.

    Each round a node and its root take the least root that the node hears from its neighbours, and then that root's own
    root, so whole trees move at once and rounds grow with the logarithm of a chain's length. Roots and edges stay
    distributed. Roots are written tables, of known size: a checkpoint keeps the estimate of the plan that it cuts, a
    join is estimated at the product of its sides, and the estimates' digits would multiply from round to round.
    """
    both = common.cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a")).distinct())
    held = label = common.written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "roots")
    while True:
        heard = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        low = F.least("root", "heard")
        own, hook = F.struct("node", F.col("root").alias("was"), low.alias("root")), F.struct(F.col("root").alias("node"), F.lit(None).cast("long").alias("was"), low.alias("root"))
        best = label.join(heard, "node").select(F.inline(F.array(own, hook))).groupBy("node").agg(F.max("was").alias("was"), F.min("root").alias("root"))
        best = common.written(best, "roots")
        jump = best.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = common.written(best.join(jump, "root").select("node", "was", F.col("far").alias("root")), "roots")
        common.discard(best)
        common.discard(held)
        held, label = after, after.select("node", "root")
        if after.where("root != was").isEmpty():
            return label


def classes(df: DataFrame, words: int = WORDS, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id that links reach."""
    rows = common.cut(fingerprints(df, words, key, text))
    fps = common.cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(fps, bits))
    # A component's id is its smallest row id; nodes without links are their own.
    member = common.cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = member.groupBy("root").agg(F.min("low").alias("component"))
    # Written, so that adaptive execution splits the join below where many rows share a fingerprint.
    of_fp = common.written(member.join(least, "root").select("fp", "component"), "components")
    return rows.join(of_fp, "fp").select("id", "fp", "component")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"), words=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
