"""License scans: fuzzy search for short notices.

A notice may be found with up to ``edits`` insertions, deletions and substitutions. Cut into edits + 1 pieces, at least
one piece of any such place stands unchanged (pigeonhole): one Aho-Corasick pass over the normal form of a whole text
finds all pieces, and each gives a window around where the notice would then lie. The regex library's bounded-error
matching gives the best match of each window, with its errors. Matches of a notice are accepted by their errors, then their
starts; one that overlaps an accepted match gives way, and what its window has outside accepted matches is searched again.
So every place of a notice overlaps a reported match of it, and reported matches of a notice don't overlap.

Normal form: A-Z lower-cased, words joined by single spaces; a word is a run of digits, letters a-z and characters beyond
ASCII. Base phrases are runs of whole words without errors. ``score`` is the best notice's share of unchanged
characters, 1 for an exact notice, 0 where there is none. Spans are reported in code points of the text itself.

Nulls count as empty texts, an empty text has no words, ties between labels are all reported, repeated rows get equal
results, an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Phrases and labels of the base search.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices of the fuzzy search in normal form: (label, notice, edits). More than four times as long as their edits, so that two
#: places of a notice in one window overlap.
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    ("mit", "the software is provided as is without warranty of any kind", 5),
    ("apache-2", "licensed under the apache license version 2 0", 4),
    ("apache-2", "you may not use this file except in compliance with the license", 6),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors", 7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    ("gpl", "gnu general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify", 6),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("gfdl", "gnu free documentation license", 3),
    ("mpl-2", "mozilla public license version 2 0", 3),
    ("mpl-2", "mozilla public license v 2 0", 2),
    ("epl-2", "eclipse public license v 2 0", 2),
    ("eupl", "licensed under the european union public licence", 4),
    ("cddl", "common development and distribution license", 4),
    ("cpl", "common public license version 1 0", 3),
    ("artistic-2", "the artistic license 2 0", 2),
    ("boost", "boost software license version 1 0", 3),
    ("zlib", "this software is provided as is without any express or implied warranty", 6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
    ("wtfpl", "do what the fuck you want to public license", 4),
    ("ofl", "sil open font license version 1 1", 3),
    ("psf", "python software foundation license", 3),
    ("ms-pl", "microsoft public license", 2),
    ("odbl", "open database license", 2),
    ("cc0", "cc0 1 0 universal public domain dedication", 4),
    ("cc-by", "creative commons attribution 4 0 international", 4),
    ("cc-by-nc", "licensed under cc by nc", 2),
    ("cc-by-nc", "creative commons attribution noncommercial", 4),
    ("cc-by-nd", "creative commons attribution noderivatives", 4),
    ("cc-by-sa", "creative commons attribution sharealike", 4),
    ("public-domain", "dedicated to the public domain", 3),
    ("all-rights-reserved", "all rights reserved", 1),
    ("proprietary", "confidential and proprietary", 2),
)
#: ASCII other than digits and letters parts words; capitals become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=4)
def automaton(notices: tuple) -> tuple:
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice, edits) in enumerate(notices):
        for at, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((i, at))
    found = ahocorasick.Automaton()
    for piece, places in seeds.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, [regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}") for _, notice, edits in notices]


def _accepted(text: str, pattern, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, errors) of one notice, found in windows."""
    heap: list[tuple[int, int, int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    errors: list[int] = []

    def search(low: int, high: int) -> None:
        if low < high and (m := pattern.search(text, low, high)):
            heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), low, high))

    for low, high in sorted(windows):
        search(low, high)
    while heap:
        e, a, b, low, high = heapq.heappop(heap)
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if i == j:
            starts.insert(i, a)
            ends.insert(i, b)
            errors.insert(i, e)
        else:  # the parts of the window that accepted matches leave
            for x, y in zip([low, *(ends[k] for k in range(i, j))], [*(starts[k] for k in range(i, j)), high], strict=True):
                search(max(low, x), min(high, y))
    return list(zip(starts, ends, errors, strict=True))


def notices_in(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, errors) in the normal form."""
    found, patterns = automaton(notices)
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (size, places) in found.iter(text):
        begin = end - size + 1
        for i, at in places:
            _, notice, edits = notices[i]
            windows.setdefault(i, set()).add((max(0, begin - at - edits), min(len(text), begin - at + len(notice) + edits)))
    return sorted((a, b, i, e) for i, each in windows.items() for a, b, e in _accepted(text, patterns[i], each))


#: Words in a text that isn't in normal form.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def in_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal form as spans of the text."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    at, begins = 0, []
    for a, b in words:
        begins.append(at)
        at += b - a + 1

    def place(x: int, last: bool) -> int:
        i = bisect_right(begins, x - last) - 1
        return min(words[i][0] + x - begins[i], words[i][1])

    return [(place(a, False), place(b, True)) for a, b in spans]


def examine(text: str | None, notices: tuple = NOTICES, base: tuple = BASE) -> tuple:
    """(n_words, base places [(word, label)], notices)."""
    words = normal(text or "")
    body = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in base:
        sought, at = f" {phrase} ".encode(), -1
        while (at := body.find(sought, at + 1)) >= 0:
            places.append((body.count(b" ", 0, at), label))
    return len(words), places, notices_in(body[1:-1].decode(), notices)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple = NOTICES, base: tuple = BASE) -> DataFrame:
    """A row a text: n_words, base (word, label), found (label, start, end, errors), score."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b.body:
                n, places, found = examine(t, notices, base)
                own = in_text(t or "", [x[:2] for x in found])
                score = max((max(0.0, 1 - e / len(notices[i][1])) for _, _, i, e in found), default=0.0)
                rows.append((n, [{"word": w, "label": x} for w, x in sorted(places)], [{"label": notices[i][0], "start": s, "end": e, "errors": k} for (_, _, i, k), (s, e) in zip(found, own, strict=True)], 1.0 if places else score))
            out = pd.DataFrame(rows, columns=["n_words", "base", "found", "score"])
            out.insert(0, "key", b.key.array)
            yield out

    common.bound_arrow_batches(df.sparkSession)
    kind = slim.schema["key"].dataType.simpleString()
    got = slim.mapInPandas(run, f"key {kind}, n_words long, base array<struct<word:long,label:string>>, found array<struct<label:string,start:int,end:int,errors:int>>, score double")
    return got.withColumnRenamed("key", key)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base = F.transform("base", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        "score",
        # Exact base phrases have their words above; these are the method's.
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["errors"])), ",").alias("spans"),
    )
