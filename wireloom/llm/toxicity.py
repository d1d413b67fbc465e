"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by logistic regressions over the presence of words and of their beginnings
(``PREFIXES`` bytes, which inflected forms share); each later model also gets the
probabilities of the categories before it. In training those come from models that did not see the row (folds),
so a later model learns from predictions as uncertain as those it will meet.

The chain is fitted on at most ``MAX_LABELLED`` labelled rows, taken in the order of a hash of their ids; of an id that comes
more than once the row of the smallest labels and text digest counts. Their words are written to the shared folder and
stay there. The driver gets minhashes of each row, by which rows whose word sets are copies of an earlier row's are
left out, lest a group of copies make its words look telling; then the vocabulary, counted by an aggregate: at most
``FEATURES`` words that rows of some category hold clearly (``LEAST_GAIN`` standard deviations) more often than chance; then one bit a
row and word. All of these are bounded, however long the texts are. Scoring covers every row and whole texts, with a model of bounded size.

Nulls and empty texts have no words: their probability is what the intercepts give. Ties in a word's score go by
the word, repeated rows get equal scores, extra columns stay, but for one of the name that ``classify`` adds, which is
replaced. Without labelled rows, or for a category that no row has, the probability is 0. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the chain is fitted on at most, and words in its vocabulary.
MAX_LABELLED, FEATURES = 5000, 512
FOLDS, ROUNDS, PENALTY, LEAST_GAIN, LEAST_ROWS = 3, 30, 0.05, 4.0, 3
PREFIXES = (4, 5, 6)
#: Decision thresholds are chosen among these, by F1 of the out-of-fold predictions where their precision is this at least.
PRECISION = 0.95
THRESHOLDS = tuple(i / 20 for i in range(1, 11))
#: In the chain's order: category and its condition on the labels.
CATEGORIES = (
    ("low_quality", "quality = 0"),
    ("toxic", "toxic = 1"),
    ("toxic_low_quality", "toxic = 1 AND quality = 0"),
)
#: ASCII other than digits and letters parts words; capitals become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_TABLE).split())


def features(found: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words with a mark that no word has."""
    out = set(found)
    for n in PREFIXES:
        out |= {w[:n] + b"*" for w in found if len(w) > n}
    return out


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    vocabulary: tuple[bytes, ...]
    #: One row a category: weights of the words, of earlier categories' probabilities, then the intercept.
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for c, w in enumerate(self.weights):
            if len(w):
                out[:, c] = _sigmoid(np.hstack([x, out[:, :c]]) @ w[:-1] + w[-1])
        return out

    def presence(self, texts: list[str | None]) -> np.ndarray:
        at = {w: i for i, w in enumerate(self.vocabulary)}
        starts = [(n, {w[:-1] for w in at if w.endswith(b"*") and len(w) == n + 1}) for n in PREFIXES]
        x = np.zeros((len(texts), len(at)))
        for row, t in enumerate(texts):
            found = words(t)
            x[row, [at[w] for w in at.keys() & found]] = 1
            for n, known in starts:
                if known:
                    x[row, [at[w + b"*"] for w in known & {w[:n] for w in found if len(w) > n}]] = 1
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method on the penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], PENALTY)
    pull[-1] = 1e-6
    for _ in range(ROUNDS):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


_ODD = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: set[bytes]) -> np.ndarray:
    """Sixteen minhashes of a row's words."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found)) if found else np.zeros(1, np.uint64)
    low = np.full(16, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 14):  # bounded, however long the text is
        low = np.minimum(low, (h[i : i + (1 << 14), None] * _ODD).min(0))
    return low


def distinct_rows(signatures: list[np.ndarray]) -> list[int]:
    """Positions of rows that share no band of four minhashes of their words with an earlier row."""
    seen: set[tuple] = set()
    kept = []
    for i, low in enumerate(signatures):
        bands = {(b, *x) for b, x in enumerate(low.reshape(4, 4).tolist())}
        if not bands & seen:
            kept.append(i)
        seen |= bands
    return kept


def gain(k: float, hits: float, total: float, n: int) -> float:
    """By how many standard deviations a word of k rows stands in more rows of a category than chance has it."""
    return (hits - k * total / n) / math.sqrt(k * total / n + 1)


def select_words(rows: list[set[bytes]], y: np.ndarray) -> list[bytes]:
    """Words of at least three rows with the largest information about any category."""
    n, df = len(rows), Counter()
    by = [Counter() for _ in range(y.shape[1])]
    for r, target in zip(rows, y, strict=True):
        df.update(r)
        for c in np.flatnonzero(target):
            by[c].update(r)
    score = {}
    totals = y.sum(0)
    for w, k in df.items():
        if k >= LEAST_ROWS:
            best = max(gain(k, by[c][w], totals[c], n) for c in range(y.shape[1]))
            if best >= LEAST_GAIN:
                score[w] = best
    return sorted(score, key=lambda w: (-score[w], w))[:FEATURES]


def _select_words(rows: DataFrame, y: np.ndarray) -> list[bytes]:
    """``select_words`` of rows(y0.., words), by an aggregate."""
    n, totals = len(y), y.sum(0).tolist()
    names = [f"y{i}" for i in range(y.shape[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[names].assign(word=[sorted(features(set(map(bytes, w)))) for w in b["words"]])

    each = rows.select(*names, "words").mapInPandas(run, ", ".join([*[f"{x} int" for x in names], "word array<binary>"]))
    counted = each.select(*names, F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("k"), *[F.sum(x).alias(x) for x in names])
    expected = [F.col("k") * F.lit(float(t)) / F.lit(n) for t in totals]
    best = F.greatest(F.lit(float("-inf")), *[(F.col(x) - e) / F.sqrt(e + 1) for x, e in zip(names, expected, strict=True)])
    told = counted.where(F.col("k") >= LEAST_ROWS).select("word", best.alias("best")).where(F.col("best") >= LEAST_GAIN)
    return [bytes(r.word) for r in told.orderBy(F.desc("best"), "word").limit(FEATURES).collect()]


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds of best F1 among those with PRECISION; the largest where there is none."""
    hits = [(t, y[p > t].sum(), (p > t).sum()) for t in THRESHOLDS]
    sure = [(t, 2 * h / (y.sum() + n)) for t, h, n in hits if n and h >= PRECISION * n]
    best = [t for t, f1 in sure if f1 >= max(f for _, f in sure) - 1e-12]
    return best[len(best) // 2] if best else THRESHOLDS[-1]


def fit_rows(rows: list[set[bytes]], y: np.ndarray, names: tuple[str, ...]) -> Chain:
    """Fit on rows in memory. y: a row for each text, a column of 0 and 1 for each category."""
    kept = distinct_rows([signature(r) for r in rows])
    y = y.astype(float).reshape(len(rows), len(names))[kept]
    rows = [features(rows[i]) for i in kept]
    vocabulary = select_words(rows, y) if len(rows) else []
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, [at[w] for w in at.keys() & r]] = 1
    return fit_matrix(x, y, vocabulary, names)


def fit_matrix(x: np.ndarray, y: np.ndarray, vocabulary: list[bytes], names: tuple[str, ...]) -> Chain:
    """The chain of a presence matrix: a row for each text, a column for each word."""
    fold = np.arange(len(x)) % FOLDS
    unseen = np.zeros_like(y)
    weights = []
    for c in range(len(names)):
        seen = np.hstack([x, unseen[:, :c]])
        if not len(x) or not y[:, c].any():
            weights.append(np.zeros(0))
            continue
        weights.append(logistic(seen, y[:, c]))
        for k in range(FOLDS):
            rest = fold != k
            if rest.any():
                w = logistic(seen[rest], y[rest, c])
                unseen[~rest, c] = _sigmoid(seen[~rest] @ w[:-1] + w[-1])
    return Chain(tuple(names), tuple(vocabulary), tuple(weights), tuple(threshold(unseen[:, c], y[:, c]) for c in range(len(names))))


def labelled(documents: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, limit: int = MAX_LABELLED) -> DataFrame:
    """(id, y0.., signature, words) of at most ``limit`` labelled documents."""
    names = [f"y{i}" for i in range(len(categories))]
    targets = [F.coalesce(F.expr(cond).cast("int"), F.lit(0)).alias(n) for n, (_, cond) in zip(names, categories, strict=True)]
    chosen = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), *targets)
    # Of bounded size: the limit is small and documented, so it may be sent to every task.
    chosen = chosen.orderBy(F.xxhash64("id"), "id", *names).limit(limit)
    pairs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body")).join(F.broadcast(chosen), "id")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [words(t) for t in b.body]
            yield b[["id", *names]].assign(signature=[signature(f).view(np.int64) for f in found], words=[sorted(f) for f in found])

    common.bound_arrow_batches(documents.sparkSession)
    got = pairs.mapInPandas(distinct, ", ".join(["id long", *[f"{n} int" for n in names], "signature array<long>", "words array<binary>"]))
    one = got.groupBy("id").agg(F.min(F.struct(*names, "signature", "words")).alias("x")).select("id", "x.*")
    return common.written(one, "labelled")


def fit(documents: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, limit: int = MAX_LABELLED) -> Chain:
    """Fit on at most ``limit`` labelled documents."""
    rows = labelled(documents, labels, categories, limit)
    names, columns = tuple(n for n, _ in categories), [f"y{i}" for i in range(len(categories))]
    seen = rows.select("id", *columns, "signature").toPandas().sort_values("id", kind="stable")
    seen = seen.iloc[distinct_rows([np.asarray(x, np.int64).view(np.uint64) for x in seen.signature])]
    y = seen[columns].to_numpy(float)
    if not len(seen):
        return fit_rows([], np.zeros((0, len(names))), names)
    ids = rows.sparkSession.createDataFrame(seen[["id"]], "id long")
    kept = rows.join(F.broadcast(ids), "id")
    vocabulary = _select_words(kept, y)
    at = {w: i for i, w in enumerate(vocabulary)}

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), len(at)), bool)
            for i, w in enumerate(b["words"]):
                x[i, [at[f] for f in at.keys() & features(set(map(bytes, w)))]] = True
            yield pd.DataFrame({"id": b["id"], "bits": [r.tobytes() for r in np.packbits(x, axis=1)]})

    got = kept.select("id", "words").mapInPandas(bits, "id long, bits binary").toPandas().sort_values("id", kind="stable")
    packed = np.frombuffer(b"".join(map(bytes, got.bits)), np.uint8).reshape(len(got), -1)
    chain = fit_matrix(np.unpackbits(packed, axis=1, count=len(at)).astype(float) if at else np.zeros((len(got), 0)), y, vocabulary, names)
    common.discard(rows)
    return chain


def score(text: Column, chain: Chain) -> Column:
    """Struct of the chain's probabilities for a text column."""

    @F.pandas_udf(", ".join(f"{n} double" for n in chain.names))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame(chain.probabilities(chain.presence(t.tolist())), columns=list(chain.names))

    return run(text)


def classify(documents: DataFrame, chain: Chain, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: the probabilities by category."""
    common.bound_arrow_batches(documents.sparkSession)
    return documents.withColumn(out, score(F.col(text), chain))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    chain = fit(documents, common.table(spark, sf_dir, "labels"))
    scored = classify(documents.select("doc_id", "text"), chain)
    limit = chain.thresholds[chain.names.index("toxic")]
    shown = [F.round(F.col(f"toxicity.{n}"), 6).alias(f"p_{n}") for n in chain.names]
    return scored.select("doc_id", *shown, (F.col("toxicity.toxic") > limit).cast("int").alias("toxic"))
