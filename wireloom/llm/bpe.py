"""Byte-level BPE encoding and decoding.

Boundaries of pre-tokens are found without regex. Texts of a batch are laid end to end as an array of code points;
a table gives each code point's class, two shifted views add what follows it, and the pattern's automaton (eight states)
is run by an associative scan: every class is a transition function, all functions that compositions can give form a
small monoid, and composing is a look-up in its table, so prefixes are composed block-wise and in any order. The state
before each character and its class then say whether a pre-token starts there.

The slices feed pair merging through a cache that is emptied when full. ``encode_texts`` also returns each text's
offsets (tokens before each pre-token): decoding goes by them, run of pre-tokens by run, and any run can be decoded alone.
Short pre-tokens that the cache lacks are merged side by side, one pair of each at a time, in arrays of pieces (``Pairs``);
long ones by a heap.

Nulls count as empty texts, an empty text has no ids, repeated rows get equal results, an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pre-tokens that a worker's cache holds before it is emptied.
CACHE = 200_000
#: Bytes from which a pre-token is merged by a heap.
LONG = 64
#: Pre-tokens that are merged side by side.
ROWS = 16_384
#: Pre-tokens that are looked up at once.
SLICE = 1 << 18
#: Rank of a pair that has none.
NEVER = np.int32(2**31 - 1)
#: Pre-tokens that are decoded at once.
RUN = 4096
#: Code points that are scanned at once, but for longer texts.
CHUNK = 1 << 20

# Classes of positions. SPACE and OTHER_SPACE split by what follows: a character that isn't white space, or not.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_LAST, OTHER_SPACE_LAST, SPACE_INSIDE, RESET = range(9)
# States after a position.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_SPACES, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a pre-token starts here)."""
    if kind == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FRESH if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_OTHER, AFTER_SPACE) or kind == OTHER:
            return IN_OTHER, state not in (IN_OTHER, AFTER_SPACE)
        return (ONE_MORE if kind == QUOTE1 else TWO_MORE), True
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == OTHER_SPACE_LAST:
        return FRESH, True
    if kind == SPACE_INSIDE:
        return IN_SPACES, state != IN_SPACES
    return FRESH, True


class Scan:
    """The automaton's transition monoid and its composition table."""

    def __init__(self, kinds: int = 9, states: int = 8):
        functions = [tuple(range(states)), *[tuple(_step(s, k)[0] for s in range(states)) for k in range(kinds)]]
        every = list(dict.fromkeys(functions))
        self.number = {f: i for i, f in enumerate(every)}
        todo = list(every)
        generators = functions[1:]
        while todo:
            f = todo.pop()
            for g in generators:
                if (h := tuple(g[s] for s in f)) not in self.number:
                    self.number[h] = len(every)
                    every.append(h)
                    todo.append(h)
        assert len(every) <= 256
        self.of_kind = np.array([self.number[f] for f in generators], np.uint8)
        self.then = np.array([[self.number[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8)
        self.from_fresh = np.array([f[FRESH] for f in every], np.uint8)
        self.starts = np.array([[_step(s, k)[1] for k in range(kinds)] for s in range(states)], bool)

    def states_before(self, kinds: np.ndarray) -> np.ndarray:
        """State before each position: composed prefixes, block by block, applied to FRESH."""
        n, width = len(kinds), 256
        rows = -(-n // width)
        f = np.zeros(rows * width, np.uint8)
        f[:n] = self.of_kind[kinds]
        f = np.ascontiguousarray(f.reshape(rows, width).T)
        then, many = self.then.reshape(-1), self.then.shape[1]
        for j in range(1, width):  # prefixes inside every block
            f[j] = then.take(f[j - 1].astype(np.int32) * many + f[j])
        total = f[-1].copy()
        step = 1
        while step < rows:  # prefixes of blocks, by doubling
            total[step:] = self.then[total[:-step], total[step:]]
            step *= 2
        f[:, 1:] = self.then[total[:-1][None, :], f[:, 1:]]
        after = self.from_fresh[f.T.reshape(-1)[:n]]
        return np.concatenate([np.array([FRESH], np.uint8), after[:-1]]) if n else after


@functools.cache
def scanner() -> Scan:
    return Scan()


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 space, 4 other white space.

    The tokenizer library itself says which code points are letters, numbers and white space, so that the table
    follows its Unicode version.
    """
    import tiktoken

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, 2, np.uint8)
    for kind, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (4, r"\s")):
        one = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(one.encode_ordinary(points)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = 3
    return table


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; 0xFFFFFFFF stands between texts."""
    reset = points == 0xFFFFFFFF
    classes = class_table()[np.where(reset, 0, points)]
    blank = (classes >= 3) & ~reset
    n = len(points)
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~blank[1:] & ~reset[1:]
    kinds = classes.copy()
    kinds[blank] = np.where(solid_next[blank], np.where(classes[blank] == 3, SPACE_LAST, OTHER_SPACE_LAST), SPACE_INSIDE)
    quotes = np.flatnonzero(points == 0x27)
    padded = np.concatenate([points, np.full(2, 0xFFFFFFFF, points.dtype)])
    one, two = padded[quotes + 1], padded[quotes + 2]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    kinds[quotes[single]] = QUOTE1
    kinds[quotes[double]] = QUOTE2
    kinds[reset] = RESET
    scan = scanner()
    return scan.starts[scan.states_before(kinds), kinds]


def pre_tokens(texts: list[str]) -> list[list[str]]:
    joined = []
    for t in texts:
        joined += [np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0xFFFFFFFF], np.uint32)]
    at = np.flatnonzero(boundaries(np.concatenate(joined))) if joined else np.zeros(0, int)
    out, low = [], 0
    for t in texts:
        a, b = np.searchsorted(at, (low, low + len(t)))
        edges = (at[a:b] - low).tolist()
        out.append([t[i:j] for i, j in zip(edges, [*edges[1:], len(t)], strict=False)])
        low += len(t) + 1
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a pre-token: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank.

    By a heap of (rank, start) over a linked list of parts: n log n for a pre-token of any length.
    """
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)

    def pair(i: int) -> None:
        j = after[i]
        rank[i] = ranks.get(piece[i : after[j]], -1) if j < n else -1
        if rank[i] >= 0:
            heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:  # changed or gone since
            continue
        j = after[i]
        after[i], rank[j] = after[j], -1
        if after[i] < n:
            before[after[i]] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by bytes and bytes by rank of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    by_rank = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        by_rank[v] = k
    return ranks, by_rank


class Pairs:
    """Rank of the pair of two ids for whole arrays of them, by open addressing; pairs are the splits of every ranked piece in two.

    An id is its rank, so a pair's rank is also the id of what it becomes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        #: The id that stands before and after a pre-token; it pairs with none.
        self.edge = max(ranks.values()) + 1
        self.width = self.edge + 1
        found = [
            (a, b, r) for piece, r in ranks.items() for i in range(1, len(piece))
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None
        ]
        a, b, r = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, (4 * len(r)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        todo = a * self.width + b
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]  # of keys that meet in a slot one stays, the others go on
            in_place = self.keys[at] == todo
            self.ranks[at[in_place]] = r[in_place]
            todo, r, at = todo[~in_place], r[~in_place], (at[~in_place] + 1) & self.mask
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NEVER."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NEVER)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.ranks[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another; how many each has), as ``merge_long`` gives.

        Pieces come in ascending size. In every round each joins its pair of lowest rank, leftmost first.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts, low = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while low < len(pieces):  # of much the same size
            high = min(low + ROWS, int(np.searchsorted(sizes, max(8, sizes[low] * 5 // 4), "right")))
            a, b = self._merge_rows(pieces[low:high], sizes[low:high])
            ids.append(a)
            counts.append(b)
            low = high
        return np.concatenate(ids), np.concatenate(counts)

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` side by side: a row has its piece's parts between edges; a part that is gone is -1."""
        n, width = len(pieces), int(sizes[-1]) + 2
        column = np.arange(width)
        inside = (column > 0) & (column <= sizes[:, None])
        parts = np.full((n, width), self.edge, np.int32)
        parts[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NEVER, np.int32)
        pairs = inside[:, :-1] & inside[:, 1:]
        ranks[:, :-1][pairs] = self.rank(parts[:, :-1][pairs], parts[:, 1:][pairs])
        after = np.arange(1, n * width + 1)
        before = np.arange(-1, n * width - 1)
        flat, flat_ranks = parts.reshape(-1), ranks.reshape(-1)
        live = np.arange(n)
        while len(live):
            i = live * width + ranks[live].argmin(axis=1)
            joined = flat_ranks[i]
            more = joined != NEVER
            live, i, joined = live[more], i[more], joined[more]
            j, h = after[i], before[i]
            k = after[j]
            flat[i], flat[j] = joined, -1
            after[i], before[k] = k, i
            flat_ranks[j] = NEVER
            flat_ranks[i] = self.rank(joined, flat[k])
            flat_ranks[h] = self.rank(flat[h], joined)
        left = (parts >= 0) & (parts != self.edge)
        return parts[left], left.sum(axis=1)


@functools.lru_cache(maxsize=4)
def load_pairs(path: str) -> Pairs:
    return Pairs(load_ranks(path)[0])


class Codec:
    def __init__(self, path: str):
        self.ranks, self.by_rank = load_ranks(path)
        self.pairs = load_pairs(path)
        self.clear()

    def clear(self) -> None:
        #: Number of each cached pre-token; those numbered k have ids[ends[k]:ends[k + 1]].
        self.cache: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        """Merge distinct pre-tokens and cache them: those that have a rank themselves first, then by size."""
        pieces = list(map(str.encode, words))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rank = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        sizes[rank >= 0] = 0
        order = np.argsort(sizes, kind="stable")
        a, b = np.searchsorted(sizes[order], (1, LONG + 1)).tolist()
        pieces = list(map(pieces.__getitem__, order.tolist()))
        ids, counts = self.pairs.merge(pieces[a:b])
        long = [merge_long(p, self.ranks) for p in pieces[b:]]
        counts = np.concatenate([np.ones(a, np.int64), counts, np.fromiter(map(len, long), np.int64, len(long))])
        self.cache.update(zip(map(words.__getitem__, order.tolist()), range(len(self.cache), len(self.cache) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, rank[order[:a]], ids, np.fromiter(chain.from_iterable(long), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + counts.cumsum()])

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pre-tokens, one after another; how many each has), by the cache; what it lacks is merged at once."""
        if len(self.cache) > CACHE:
            self.clear()
        numbers = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(numbers < 0)
        if len(lacking):
            new = list(map(words.__getitem__, lacking.tolist()))
            self.add(list(dict.fromkeys(new)))
            numbers[lacking] = np.fromiter(map(self.cache.__getitem__, new), np.int64, len(new))
        first = self.ends[numbers]
        counts = self.ends[numbers + 1] - first
        ends = counts.cumsum()
        return self.ids[np.repeat(first - ends + counts, counts) + np.arange(counts.sum())], counts

    def encode_arrays(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode_texts`` in arrays."""
        chunk, held = [], 0
        for t in [*texts, None]:
            if chunk and (t is None or held + len(t) > CHUNK):
                words, low = pre_tokens(chunk), 0
                flat = list(chain.from_iterable(words))
                found = [self.look_up(flat[i : i + SLICE]) for i in range(0, max(1, len(flat)), SLICE)]
                ids = np.concatenate([f[0] for f in found])
                before = np.concatenate([np.zeros(1, np.int64), *[f[1] for f in found]]).cumsum()
                for high in accumulate(map(len, words)):
                    a, b = before[low], before[high]
                    yield ids[a:b], before[low:high] - a
                    low = high
                chunk, held = [], 0
            if t is not None:
                chunk.append(t)
                held += len(t)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(ids, offsets) of each text; offsets[i] ids stand before pre-token i."""
        for ids, offsets in self.encode_arrays(texts):
            yield ids.tolist(), offsets.tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def decode_runs(self, ids: list[int] | np.ndarray, offsets: list[int] | np.ndarray, first: int = 0, last: int | None = None) -> Iterator[bytes]:
        """Bytes of pre-tokens first to last (exclusive), RUN of them at a time: the offsets say which ids are theirs."""
        last = len(offsets) if last is None else min(last, len(offsets))
        for i in range(first, last, RUN):
            j = min(i + RUN, last)
            yield self.decode(ids[offsets[i] : offsets[j] if j < len(offsets) else len(ids)])


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, offsets array<int>) of each text."""
    slim = df.select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for b in batches:
            done = list(codec.encode_texts([t if t is not None else "" for t in b.iloc[:, 1]]))
            yield pd.DataFrame({key: b.iloc[:, 0].array, "ids": [d[0] for d in done], "offsets": [d[1] for d in done]})

    common.bound_arrow_batches(df.sparkSession)
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInPandas(run, f"`{key}` {kind}, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", first: int = 0, last: int | None = None) -> DataFrame:
    """(key, body binary) of the rows of ``encode``, or only of each text's pre-tokens first to last (exclusive)."""
    slim = tokens.select(key, "ids", "offsets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for b in batches:
            body = [b"".join(codec.decode_runs(list(i), list(o), first, last)) for i, o in zip(b.ids, b.offsets, strict=True)]
            yield pd.DataFrame({key: b.iloc[:, 0].array, "body": body})

    common.bound_arrow_batches(tokens.sparkSession)
    return slim.mapInPandas(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, body binary")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256); the arrays stay in the worker."""
    slim = df.select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        decimal = list(map(str, range(len(codec.by_rank))))
        for b in batches:
            rows = []
            for ids, offsets in codec.encode_arrays([t if t is not None else "" for t in b.iloc[:, 1]]):
                shown, decoded = hashlib.sha256(), hashlib.sha256()
                for i in range(0, len(ids), RUN):
                    shown.update(("," * (i > 0) + ",".join(map(decimal.__getitem__, ids[i : i + RUN].tolist()))).encode())
                for part in codec.decode_runs(ids, offsets):
                    decoded.update(part)
                rows.append((len(ids), shown.hexdigest(), decoded.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, b.iloc[:, 0].array)
            yield out

    common.bound_arrow_batches(df.sparkSession)
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInPandas(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), rank_file())
