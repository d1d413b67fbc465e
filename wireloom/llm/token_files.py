"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format. A file is a block: a run of documents in ascending id order. ``control`` has two bits for each id, four ids to
a byte, lowest bits first: the number of bytes of the id's code less one. ``data`` has the codes one after the other,
little-endian. A code is the id's rank: 0 for the most frequent id of the whole corpus (ties: the smaller id), so frequent
ids take one byte. ``doc_ids`` and ``lengths`` tell the documents apart; ``bucket`` and ``seq`` order the blocks. The
rank table is written beside the blocks. Blocks are rows of an uncompressed Parquet dataset: Spark's commit protocol then
keeps exactly one copy of each, whatever executors are lost, on any store that Spark writes to.

Decoding looks up each control byte in a 256 x 4 table of code lengths and gathers the bytes of all ids at once.

Ids come from the tokenizers library. Texts of Latin-1 are cut into the pieces that the tokenizer's pattern gives, and
pieces go to the library's model; so are the Latin-1 words of other texts, split at ASCII white space (which the tokenizer
drops), but their other words go through the whole library. Answers are cached in two generations: entries that are met
again move from the old one to the young one, and when the young one is full it becomes the old one, whose rest goes.

Another tokenizer, whose normalizer or pre-tokenizer isn't the one spelt out here, gets whole texts.

Nulls count as empty texts; an empty text has only the end id. Rows of equal (or null, which come first) doc_id follow
by their ids. An empty table gives no blocks. Extra columns are not read.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Appended to every document.
END = 1
#: Entries of a generation of a worker's cache.
CACHE = 200_000
#: Ids in a block, but for longer documents.
BLOCK = 1 << 19
ROWS_PER_BUCKET = 8192
#: The vocabulary's size is the bound of the rank table: it goes to the driver and to all tasks.
MAX_VOCABULARY = 1 << 20
#: The normalizer and pre-tokenizer that PIECE stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same pattern for lower-case Latin-1, spelt out.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

#: UTF-8 lead bytes of code points from U+0100 on.
BEYOND = re.compile(rb"[\xc4-\xff]")


def _visible() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def id_type(vocabulary: int) -> str:
    """The narrowest unsigned integers for ids on their way to the files."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def vocabulary_type(path: str) -> str:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path).get_vocab_size())


class Generations:
    """A bounded cache that keeps what is met often."""

    def __init__(self, make: Callable):
        self.make, self.young, self.old = make, {}, {}

    def __getitem__(self, key):
        if (got := self.young.get(key)) is None:
            if (got := self.old.get(key)) is None:
                got = self.make(key)
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        form = json.loads(self.whole.to_str())
        self.spelt = form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == PRE_TOKENIZER
        visible = _visible()
        self.alphabet = [visible[b] for b in range(256)]
        self.special = tuple(t.content.encode() for t in self.whole.get_added_tokens_decoder().values())
        self.kind = id_type(self.whole.get_vocab_size())
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.known = Generations(self.ids)

    def ids(self, key: str | bytes) -> bytes:
        """Of a lower-case piece of Latin-1, or of the bytes of any word."""
        if isinstance(key, bytes):
            found = self.whole.encode(key.decode(), add_special_tokens=False).ids
        else:
            shown = key if key.isascii() and key.isprintable() else "".join(map(self.alphabet.__getitem__, key.encode()))
            found = [t.id for t in self.model.tokenize(shown)]
        return array.array(self.code, found).tobytes()

    def other(self, body: bytes) -> bool:
        """Whether a text is more than Latin-1 without special tokens: whether a lead byte above that of U+00FF occurs."""
        return any(s in body for s in self.special) or not body.isascii() and bool(BEYOND.search(body))

    def keys(self, text: str) -> list[str | bytes]:
        body = text.encode()
        if not self.other(body):
            return PIECE.findall(text.lower())
        words = body.split()
        others = {w for w in set(words) if self.other(w)}
        out: list[str | bytes] = []
        for apart, run in itertools.groupby(words, others.__contains__):
            out += run if apart else PIECE.findall(b" ".join(run).decode().lower())
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of ``kind``."""
        if not self.spelt:
            return array.array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        keys = self.keys(text)
        young = self.known.young
        for k in set(keys).difference(young):
            self.known[k]
        if young is not self.known.young:  # a generation ended inside this text
            return b"".join(map(self.known.__getitem__, keys))
        return b"".join(map(young.__getitem__, keys))


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(id, k, ids): ids as unsigned integers of ``vocabulary_type``, with the end id."""
    slim = df.select(F.col(key).cast("long").alias("id"), common.order_key(key).alias("k"), F.col(text).alias("body"))
    tail = np.array([end], vocabulary_type(path)).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path)
        for b in batches:
            ids = [encoder.encode(t or "") + tail for t in b.body]
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "k": b.k, "ids": ids})

    common.bound_arrow_batches(df.sparkSession)
    return slim.mapInPandas(run, "id long, k long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(token, count) over all documents; each task sends its non-zero counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.ids), kind))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at, "count": total[at]})

    return tokens.select("ids").mapInPandas(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by rank, the most frequent first. Bounded by the vocabulary."""
    rows = counts.orderBy(F.desc("count"), "token").limit(MAX_VOCABULARY + 1).toPandas()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is larger than its bound")
    return rows.token.to_numpy(np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


#: Lengths of the four codes of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    keep = np.arange(4) < size[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[keep] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


BLOCKS = "bucket int, seq int, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary"


def write(tokens: DataFrame, path: str, by_rank: np.ndarray, bounds: list[int], kind: str) -> None:
    """Write the blocks in ascending order of k. One shuffle, of the ids; tasks stream through their sorted rows."""
    width = np.dtype(kind).itemsize
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, seq, held, ids, size = None, 0, [], [], 0

        def block() -> pd.DataFrame:
            flat = rank[np.frombuffer(b"".join(held), kind)]
            control, data = encode_ranks(flat)
            return pd.DataFrame({"bucket": [bucket], "seq": [seq], "doc_ids": [ids], "lengths": [[len(x) // width for x in held]], "n_ids": [len(flat)], "control": [control], "data": [data]})

        for b in batches:
            for where, doc, body in zip(b.bucket, b["id"], b.ids, strict=True):
                if held and (where != bucket or size >= BLOCK):
                    yield block()
                    seq, held, ids, size = (seq + 1 if where == bucket else 0), [], [], 0
                bucket = where
                held.append(body)
                ids.append(None if pd.isna(doc) else int(doc))
                size += len(body) // width
        if held:
            yield block()

    rows = tokens.withColumn("bucket", common.bucket_of(F.col("k"), bounds).cast("int"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "k", "ids").select("bucket", F.col("id"), "ids")
    rows.mapInPandas(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark = tokens.sparkSession
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "by_rank binary").write.parquet(f"{path}/ranks")


def starts(blocks: DataFrame) -> DataFrame:
    """(bucket, seq, start): ids before each block. The global window has a row for each bucket, MAX_BUCKETS at most."""
    slim = blocks.select("bucket", "seq", "n_ids")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("bucket").agg(F.sum("n_ids").alias("total"))
    totals = totals.select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = slim.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return at.join(totals, "bucket").select("bucket", "seq", (F.col("base") + F.col("inside")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, ids as unsigned integers of 32 bits."""
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().by_rank, "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    # The slim side, a row a block, may be broadcast by its size; the blocks themselves then aren't shuffled.
    placed = blocks.join(starts(blocks), ["bucket", "seq"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples():
                ids = by_rank[decode_ranks(x.control, x.data, x.n_ids)].astype("<u4")
                edges = np.concatenate([[0], np.cumsum(np.asarray(x.lengths, np.int64))])
                body = [ids[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
                docs = pd.array([None if pd.isna(d) else int(d) for d in x.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": docs, "start": x.start + edges[:-1], "ids": body})

    return placed.select("start", "doc_ids", "lengths", "n_ids", "control", "data").mapInPandas(run, "doc_id long, start long, ids binary")


def crc(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) natively: ids are bytes already."""
    return ids.select("doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def write_corpus(documents: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenize every document once, into the shared folder, rank the ids by their counts, write the blocks."""
    spark = documents.sparkSession
    bounds = common.bucket_bounds(documents.select(common.order_key("doc_id").alias("k")), F.col("k"), ROWS_PER_BUCKET)
    tokenize(documents, tokenizer).write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    kind = vocabulary_type(tokenizer)
    write(tokens, path, rank_table(id_counts(tokens, kind)), bounds, kind)


def word_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    write_corpus(common.table(spark, sf_dir, "documents"), word_tokenizer(), path)
    return crc(read(spark, path))
