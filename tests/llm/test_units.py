"""Parts of the operators that the registered queries show only in digests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import bpe, fingerprints, licenses, mixing, secrets, simhash, token_files, topk, toxicity, url_filters


def test_changed_branches(spark):
    texts = [("# a\none\n\ntwo\n# b\nthree\nfour\n", "# a\none\n\ntwo\n# b\nthree\nFOUR\n"), ("x", "x"), ("", "y")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, a string, b string")
    both = fingerprints.fingerprint(fingerprints.fingerprint(df, "a", "a_"), "b", "b_")
    got = {r.i: [tuple(x) for x in r.c] for r in both.select("i", fingerprints.changed_branches(F.col("a_sections"), F.col("b_sections")).alias("c")).collect()}
    assert got[1] == [] and got[2] == [(0, 0)] and len(got[0]) == 1
    sections = both.where("i = 0").select(F.size("a_sections").alias("n")).first().n
    assert got[0][0][0] == sections - 1


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "nothing"), (3, "nothing")], "doc_id long, text string")
    second = first.union(spark.createDataFrame([(4, "AKIAABCDEFGH1234"), (5, "password=abcdefgh1")], first.schema))
    ledger = secrets.update(first).checkpoint()
    assert ledger.count() == 2 * len(secrets.RULES)
    new = secrets.scan(second, ledger=ledger)
    assert new.select("blob").distinct().count() == 1 and new.count() == len(secrets.RULES)
    rules = (*secrets.RULES[:-1], secrets.Rule("pem", secrets.RULES[-1].pattern, version=2))
    again = secrets.scan(second, ledger=secrets.update(second, ledger), rules=rules)
    assert {(r.rule, r.version) for r in again.select("rule", "version").collect()} == {("pem", 2)} and again.count() == 3
    found = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.findings(second, secrets.update(second, ledger)).collect()}
    assert found == {1: [(0, 0, 18)], 2: [], 3: [], 4: [(0, 1, 16)], 5: [(0, 0, 18)]}


def test_redaction(spark):
    df = spark.createDataFrame([("ab token=abcdefgh1 cd", [(3, 0, 18), (9, 2, 18)])], "text string, found array<struct<start:int,kind:int,end:int>>")
    assert df.select(secrets.redact(F.col("text"), F.col("found")).alias("t")).first().t == "ab [REDACTED] cd"


def test_ledger_is_kept_and_each_blob_scanned_once(spark, tmp_path):
    rows = [(1, "password=abcdefgh1"), (2, "nothing"), (3, None), (4, "password=abcdefgh1"), (None, "AKIAABCDEFGH1234")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"blob": F.lit("x"), "spans": F.lit(1), "found": F.lit(1), "path": F.lit(2)})
    at = f"{tmp_path}/ledger"
    ledger = secrets.ingest([df.where("doc_id <= 2"), df], at)
    assert ledger.count() == 4 * len(secrets.RULES) == ledger.select("blob", "rule", "version").distinct().count()
    files = spark.read.parquet(at).inputFiles()
    secrets.ingest([df], at)  # nothing is new
    assert spark.read.parquet(at).count() == 4 * len(secrets.RULES) and set(files) <= set(spark.read.parquet(at).inputFiles())
    found = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.findings(df, ledger).collect()}
    assert found == {1: [(0, 0, 18)], 2: [], 3: [], 4: [(0, 0, 18)], None: [(0, 1, 16)]}
    assert secrets.findings(df, ledger.unionAll(ledger)).select("doc_id", "found").exceptAll(secrets.findings(df, ledger).select("doc_id", "found")).isEmpty()


def test_added_rules_and_many_matches(spark):
    import re
    import time

    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab0+/" * 40 + "=\n-----END RSA PRIVATE KEY-----"
    texts = {
        "pem": [f"x {key} y", "-----BEGIN PRIVATE KEY-----\n" + "\n".join(["Ab0+/cde" * 8] * 30) + "\nprose goes on", "-----BEGIN PRIVATE KEY----- none"],
        "jwt": ["a eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK b", "xeyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK", "eyJ" * 200_000],
        "github": ["ghp_" + "a" * 36 + " gho_short"],
        "slack": ["xoxb-1234567890-abc"],
        "assign": ["token=abcdefgh1 \U0001f600 é " * 20_000, "token=short " * 20_000],
        "hex": [("f" * 32 + " ") * 30_000],
    }
    began = time.time()
    for rule in secrets.RULES:
        if rule.name in texts:
            df = spark.createDataFrame([(t,) for t in texts[rule.name]], "t string")
            pattern = re.sub(r"\(\((\?i):(.*?)\)\)", r"((?i:\2))", rule.pattern)
            got = df.select("t", secrets.spans(F.col("t"), rule).alias("s")).collect()
            for r in got:
                assert [tuple(x) for x in r.s] == [m.span() for m in re.finditer(pattern, r.t, re.A) if len(m[rule.group]) >= rule.least]
            for r in df.select("t", secrets.redact(F.col("t"), triples_of(rule)).alias("d")).collect():
                assert r.d == re.sub(pattern, lambda m: "[REDACTED]" if len(m[rule.group]) >= rule.least else m[0], r.t, flags=re.A)
    assert time.time() - began < 120


def triples_of(rule):
    return F.transform(secrets.spans(F.col("t"), rule), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("kind"), x["end"].alias("end")))


def test_redaction_over_pieces_and_overlaps(spark):
    rng = random.Random(9)
    for n in (0, 1, secrets.PIECE, 3 * secrets.PIECE + 7):
        text = "".join(rng.choices("aé中😀", k=n))
        cuts = sorted((a, 0, min(n, a + rng.choice([1, 5, secrets.PIECE + 3]))) for a in rng.sample(range(n), min(n, 40)))
        df = spark.createDataFrame([(text, cuts)], "text string, found array<struct<start:int,kind:int,end:int>>")
        want, at = "", 0
        for a, _, b in cuts:
            if a >= at:
                want += text[at:a] + "[REDACTED]"
            at = max(at, b)
        assert df.select(secrets.redact(F.col("text"), F.col("found")).alias("t")).first().t == want + text[at:]


def test_variable_length_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert (token_files.decode_ranks(control, data, n) == ranks).all() and len(control) == -(-n // 4)


@pytest.mark.parametrize(("name", "spelt"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_word_encoder_equals_library(name, spelt):
    from tokenizers import Tokenizer

    path = token_files.word_tokenizer(name)
    whole, mine = Tokenizer.from_file(path), token_files.WordEncoder(path)
    assert mine.spelt == spelt
    rng = random.Random(1)
    pool = "abcXYZ'’ sré ßÀÿªº²½0129\t\n\u00a0\u0085\u001c.,!?-_<>|#$€Σσςİıﬁ中文한글é\u0301😀ǅ"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>x", "a<|startoftext|>'s"]
    for t in texts:
        assert np.frombuffer(mine.encode(t), mine.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_bpe_on_random_texts_and_offsets():
    import tiktoken

    import public_tokenizers as P

    codec = bpe.Codec(bpe.rank_file())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    pool = "aébs'tdmrvel  \n\t\u00a0\u2003\u0085\u001c.,!09²中😀\u0301'"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(4000)]
    for t, (ids, offsets) in zip(texts, codec.encode_texts(texts), strict=True):
        assert ids == e.encode_ordinary(t) and codec.decode(ids) == t.encode(), t
        words = bpe.pre_tokens([t])[0]
        assert len(offsets) == len(words) and "".join(words) == t
        for w, a, b in zip(words, offsets, [*offsets[1:], len(ids)][: len(words)], strict=True):
            assert codec.decode(ids[a:b]) == w.encode()


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[: a + 1] ^ fps[a]) <= bits):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [int(fps[find(i)]) for i in range(len(fps))]


def test_dense_arrays_are_linked_exactly():
    rng = np.random.default_rng(3)
    for n in (3000, 9000):
        fps = np.unique(rng.integers(0, 1 << 20, n, dtype=np.uint64)) << np.uint64(3)
        a, b = simhash.link_array(fps, 2)
        assert b.astype(np.uint64).tolist() == brute_components(fps, 2) and (a.astype(np.uint64) == fps).all()


def test_links_of_crowded_terms(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    near = [x ^ sum(np.uint64(1 << int(b)) for b in rng.choice(64, int(k), replace=False)) for x in base for k in rng.integers(1, 5, 200)]
    fps = np.unique(np.array([*base, *near, *rng.integers(0, 1 << 63, 100, dtype=np.uint64)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups, want = {}, {}
    for f, r in zip(fps, brute_components(fps, 3), strict=True):
        want.setdefault(r, set()).add(int(f))
    for f in fps.view(np.int64).tolist():
        groups.setdefault(roots.get(f, f), set()).add(f % (1 << 64))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chains_end(spark):
    n = 3000
    edges = spark.range(n).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    edges = edges.unionAll(spark.createDataFrame([(5, 7), (7, 5), (7, 6)], "a long, b long"))
    got = simhash.components(edges).groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("low")).collect()
    assert sorted(r.n for r in got) == [3, n + 1] and all(r.root == r.low for r in got)


def brute_top(vectors, queries, k):
    """vectors, queries: [(id, integers)]."""
    out = []
    for i, x in queries:
        found = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vectors if j != i and len(x) == len(y))[:k]
        out += [(i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_search_with_ties_wide_cells_and_waves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    near = rng.integers(-3, 4, (300, 6)).astype(float)
    near[50:200] = near[50]
    wide = rng.integers(-100_000, 100_000, (300, 6)).astype(float)
    wide[7, 0] = 1e9
    huge = np.array([[1e30, 1.0], [1e30, 0.0], [-1e25, 3.0], [5.0, 5.0], [2.0**40, 2.0**31], [2.0**40, 2.0**31 + 1]])
    monkeypatch.setattr(topk, "STRIPE", 40)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "WAVE", 2)
    for m, k in ((near, 20), (wide, 5), (huge, 2), (near[:3], 20)):
        data = [(3 * i, [int(x) for x in v]) for i, v in enumerate(m)]
        df = spark.createDataFrame([(i, v.tolist()) for (i, _), v in zip(data, m)] + [(1, None), (None, [1.0] * m.shape[1]), (2, [float("nan")] * m.shape[1])], "vec_id long, embedding array<double>")
        df = df.withColumns({"id": F.lit("x"), "v": F.lit(1), "rank": F.lit(2)}).repartition(5)
        got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 15 = 0"), k, scale=1).collect())
        assert got == brute_top(data, [x for x in data if x[0] % 15 == 0], k)


def test_bounds_hold():
    rng = np.random.default_rng(12)
    for scale in (10, 300, 10**6):
        v, q = rng.integers(-scale, scale, (200, 16)).astype(float), rng.integers(-scale, scale, (20, 16)).astype(float)
        got = [topk.approximate(x) for x in v]
        cells = np.array([np.frombuffer(g[2], np.uint8) for g in got], float)
        lower, upper = topk.bounds(q, np.array([g[0] for g in got]), np.array([g[1] for g in got]), cells)
        exact = q @ v.T
        assert (lower <= exact).all() and (exact <= upper).all() and ((lower == upper).all() == (scale == 10))


def test_notices_with_errors():
    assert [(n[2], n[3]) for n in licenses.notices_in("x relesed under teh mit license y")] == [(0, 3)]
    assert licenses.notices_in("released by the mint office") == []
    text = "a " * 5000 + "all rights reserved"
    assert [(s, e) for s, e, _, _ in licenses.notices_in(text)] == [(10000, len(text))]


def ends_within(text, notice, edits):
    """(end, errors) of all places: the least edit distance of the notice to a part of the text that ends there."""
    row = list(range(len(notice) + 1))
    found = []
    for j, ch in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(notice, 1):
            new.append(min(row[i - 1] + (p != ch), row[i] + 1, new[i - 1] + 1))
        row = new
        if row[-1] <= edits:
            found.append((j, row[-1]))
    return found


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, ch in enumerate(b, 1):
        new = [j]
        for i, p in enumerate(a, 1):
            new.append(min(row[i - 1] + (p != ch), row[i] + 1, new[i - 1] + 1))
        row = new
    return row[-1]


def damaged(rng, notice, k):
    out = list(notice)
    for _ in range(k):
        i = rng.randrange(len(out))
        rng.choice([lambda: out.pop(i), lambda: out.insert(i, rng.choice("abe ")), lambda: out.__setitem__(i, rng.choice("xyz"))])()
    return "".join(out)


def test_every_damaged_notice_is_found():
    rng = random.Random(11)
    for _ in range(150):
        picked = rng.sample(range(len(licenses.NOTICES)), 3)
        parts = []
        for _ in range(rng.randint(1, 6)):
            _, notice, edits = licenses.NOTICES[rng.choice(picked)]
            parts += [damaged(rng, notice, rng.randint(0, edits + 2)), rng.choice(["", " ", " ab ", " some words between "])]
        text = b" ".join(licenses.normal("".join(parts))).decode()
        found = licenses.notices_in(text)
        assert len(found) == len(set(found))
        for i in picked:
            _, notice, edits = licenses.NOTICES[i]
            own = [(a, b, e) for a, b, n, e in found if n == i]
            assert all(b <= c for (_, b, _), (c, _, _) in zip(own, own[1:]))
            for a, b, e in own:
                assert distance(notice, text[a:b]) <= e <= edits
            for end, _ in ends_within(text, notice, edits):
                # Any such place has len(notice) - edits characters at least.
                assert any(a < end and end - (len(notice) - edits) < b for a, b, _ in own), (text, notice, end)


def test_notices_side_by_side_and_their_spans():
    text = "RELESED  under teh MIT-license;\n Released under the MIT license"
    n, places, found = licenses.examine(text)
    assert [(f[2], f[3]) for f in found] == [(0, 3), (0, 0)] and n == 10 and places == [(6, "mit")]
    spans = licenses.in_text(text, [f[:2] for f in found])
    assert [text[a:b] for a, b in spans] == ["RELESED  under teh MIT-license", "Released under the MIT license"]
    many = "released under the mit license " * 3000
    assert len(licenses.notices_in(many.strip())) == 3000


def test_chain_without_labels_or_categories():
    empty = toxicity.fit_rows([], np.zeros((0, 2)), ("a", "b"))
    assert (empty.probabilities(empty.presence(["x", None])) == 0).all()
    rows = [{b"bad", b"w%d" % i} if i % 3 == 0 else {b"good", b"w%d" % i} for i in range(90)]
    y = np.array([[i % 3 == 0, False] for i in range(90)])
    chain = toxicity.fit_rows(rows, y, ("bad", "never"))
    p = chain.probabilities(chain.presence(["so bad", "good", ""]))
    assert p[0, 0] > chain.thresholds[0] > p[1, 0] and (p[:, 1] == 0).all()


def queue_of_words(docs, order, weights, budget, most=2):
    """Words taken of each document (id, source, size): the words of all queues by the virtual times of their middles, until the budget."""
    line = []
    for i, s in enumerate(sorted({d[1] for d in docs}, key=lambda x: (x is None, x))):
        own = sorted((d for d in docs if d[1] == s), key=lambda d: order[d[0]])
        at = 0
        for epoch in range(most):
            for d in own:
                for _ in range(d[2]):
                    at += 1
                    line.append(((at - 0.5) / weights[i % len(weights)], i, epoch, d[0]))
    line.sort()
    taken = dict.fromkeys((d[0] for d in docs), 0)
    for x in line[:budget]:
        taken[x[3]] += 1
    return taken, len(line)


def test_mixing_equals_a_queue_of_words(spark):
    rng = random.Random(6)
    for n, longest in ((40, 9), (60, 400), (1, 5)):
        docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, rng.randint(1, longest)])) for i in range(n)]
        df = spark.createDataFrame([(i, "w " * k, s) for i, s, k in docs], "doc_id long, text string, source string")
        order = {r.doc_id: (r.h, r.doc_id) for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
        budget = int(1.5 * sum(d[2] for d in docs))
        want, words = queue_of_words(docs, order, [3.0, 1.0, 2.0], budget)
        rows, stream = mixing.mix(df)
        assert {r.id: r.taken for r in rows.collect()} == want
        # The truncation alone decides: without it every word of both epochs would be taken.
        assert sum(want.values()) == budget and words == 2 * sum(d[2] for d in docs)
        served = [r.served for r in stream.orderBy("position").collect()]
        assert sum(served) == budget
        whole = mixing.mix(df, whole=True)[0].collect()
        assert all(r.taken == r.size * r.times or r.size == 0 and r.times == 1 for r in whole)
        assert abs(sum(r.taken for r in whole) - budget) <= max(d[2] for d in docs) / 2


def test_long_pre_tokens_merge_as_short_ones():
    codec = bpe.Codec(bpe.rank_file())
    rng = random.Random(8)
    for k in range(200):
        piece = "".join(rng.choices("aabtheing", k=rng.randint(2, 300))).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:  # the definition: join the leftmost pair of lowest rank
            ranked = [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_long(piece, codec.ranks) == tuple(codec.ranks[p] for p in parts)


def definition(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while ranked := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_unseen_pre_tokens_are_merged_side_by_side():
    import time

    codec = bpe.Codec(bpe.rank_file())
    rng = random.Random(9)
    words = list(dict.fromkeys(" " + "".join(rng.choices("aabtheingéñß", k=rng.randint(6, 14))) for _ in range(30_000)))
    t = time.process_time()
    ((ids, offsets),) = codec.encode_texts(["".join(words)])
    at_once = time.process_time() - t
    for w, a, b in list(zip(words, offsets, [*offsets[1:], len(ids)], strict=True))[::20]:
        assert ids[a:b] == definition(w.encode(), codec.ranks), w
    t = time.process_time()
    for w in words:
        bpe.merge_long(w.encode(), codec.ranks)
    assert at_once < 0.6 * (time.process_time() - t)


def test_pairs_in_small_slices(monkeypatch):
    import tiktoken

    import public_tokenizers as P

    codec = bpe.Codec(bpe.rank_file())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    a, b = (np.array([codec.ranks[x] for x in y], np.int32) for y in ((b"t", b"e", b"\x00"), (b"h", b"r", b"\xff")))
    assert codec.pairs.rank(a, b).tolist() == [codec.ranks[b"th"], codec.ranks[b"er"], bpe.NEVER]
    for name, value in (("CACHE", 50), ("SLICE", 7), ("ROWS", 3), ("RUN", 5), ("CHUNK", 300)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(10)
    texts = ["", " ", *("".join(rng.choices("aaabnthé zß中\n9😀", k=rng.randint(0, 200))) for _ in range(300)), "", "ab" * 2000, "a" * 64, "aé" * 22]
    for t, (ids, offsets) in zip(texts, codec.encode_texts(texts), strict=True):
        assert ids == e.encode_ordinary(t) and b"".join(codec.decode_runs(ids, offsets)) == t.encode(), t
        assert len(codec.cache) <= 50 + 7


def test_decoding_by_offsets(spark):
    texts = [(1, "one two  three's"), (2, ""), (3, None), (4, "a " * 10_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tokens = bpe.encode(df, bpe.rank_file())
    got = {r.doc_id: bytes(r.body).decode() for r in bpe.decode(tokens, bpe.rank_file()).collect()}
    assert got == {i: t or "" for i, t in texts}
    part = {r.doc_id: bytes(r.body).decode() for r in bpe.decode(tokens, bpe.rank_file(), first=1, last=3).collect()}
    assert part == {i: "".join(bpe.pre_tokens([t or ""])[0][1:3]) for i, t in texts}


def test_lists_by_fetch_time_and_clashing_names(spark):
    stamp = lambda df: df.withColumn("listed_at", F.to_timestamp("listed_at"))
    entries = stamp(spark.createDataFrame([("a.b.c", "block", "2024-01-02"), ("a.b.c", "none", "2024-01-04"), ("B.C", "block", "2024-01-03"), ("b.c", "allow", "2024-01-03"), ("x.y", "block", None), (None, "block", "2024-01-01")], "domain string, action string, listed_at string"))
    rows = [("http://a.b.c/", "2024-01-01"), ("http://A.b.c:8/", "2024-01-02"), ("http://a.b.c", "2024-01-03"), ("http://a.b.c", "2024-01-04"), ("http://z.b.c.", "2024-01-02"), ("http://x.y", "2024-02-01"), (None, "2024-02-01"), ("http://a.b.c", None), ("http://" + "h" * 300, "2024-02-01")]
    caps = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    names = ["host2", "held", "other", "hit", "host_", "at_", "domain", "spans", "depth", "valid_from", "action", "host"]
    out = url_filters.evaluate(caps.withColumns({n: F.lit(n) for n in names}), entries)
    assert sorted(out.columns) == sorted(["i", "url", "fetched_at", *names, "matched_domain", "verdict"])
    got = {r.i: r for r in out.collect()}
    assert [(got[i].matched_domain, got[i].action) for i in range(9)] == [(None, None), ("a.b.c", "block"), ("a.b.c", "block"), ("b.c", "block"), (None, None), *[(None, None)] * 4]
    assert all(r.held == "held" and (r.verdict == "drop") == (r.action == "block") for r in got.values()) and got[8].host is None
    assert url_filters.evaluate(caps.limit(0), entries).count() == 0 and url_filters.evaluate(caps, entries.limit(0)).where("verdict = 'keep'").count() == 9


def test_pages_meet_every_kind_of_entry(spark):
    got = url_filters.op10_url_filters(spark, "/root/testdata/sf0.01").groupBy("action").count().collect()
    assert {r.action for r in got} == {None, "allow", "block"} and min(r["count"] for r in got) >= 10


def python_tree(text):
    """Sections of paragraphs of (node, leaves), by the definition."""
    import hashlib
    import re

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for part in re.split(fingerprints.SECTION, text):
        ps = [(sha("p:" + p), [x for x in re.findall(fingerprints.CLAUSE, p)]) for p in re.split(fingerprints.PARAGRAPH, part)]
        sections.append((sha("s:" + "".join(n for n, _ in ps)), ps))
    return sha("d:" + "".join(n for n, _ in sections)), sections


def python_compare(a, b):
    (ra, sa), (rb, sb) = python_tree(a), python_tree(b)
    la, lb = ({x for _, ps in s for _, leaf in ps for x in leaf} for s in (sa, sb))
    share = 2 * sum(map(len, la & lb)) / max(sum(map(len, la)) + sum(map(len, lb)), 1)
    at = lambda xs, i: xs[i] if i < len(xs) else None
    changed = []
    for i in range(max(len(sa), len(sb))):
        x, y = at(sa, i), at(sb, i)
        if (x and x[0]) != (y and y[0]):
            px, py = (x[1] if x else []), (y[1] if y else [])
            changed += [(i, j) for j in range(max(len(px), len(py))) if (at(px, j) or [None])[0] != (at(py, j) or [None])[0]]
    first = None
    if changed:
        i, j = changed[0]
        x, y = (at(at(s, i)[1], j) if at(s, i) and at(at(s, i)[1], j) else (None, []) for s in (sa, sb))
        leaf = next((k for k in range(max(len(x[1]), len(y[1]))) if at(x[1], k) != at(y[1], k)), 0)
        first = f"{i}.{j}.{leaf}"
    return ra, rb, 1.0 if ra == rb else min(share, 0.999999), first, len(changed)


def test_fingerprints_equal_trees_by_the_definition(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    got = {r.doc_id: r for r in fingerprints.op1_document_fingerprints(spark, sf_dir).collect()}
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 2
        edited = t[: len(t) - k] + n[:k]
        ra, rb, near, first, changed = python_compare(t, edited)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint, r.first_change, r.changed_paragraphs) == (ra, rb, first, changed)
        assert abs(r.near_edited - near) < 1e-9 and abs(r.near_next - python_compare(t, n)[2]) < 1e-9


def test_fingerprint_columns_that_clash(spark):
    df = spark.createDataFrame([("a\n\nb", 1), (None, 2)], "text string, tree int").withColumns({"fp_root": F.lit("old"), "id": F.lit(7)})
    out = fingerprints.fingerprint(df)
    assert out.columns == ["text", "tree", "id", "fp_root", "fp_sections"]
    assert [r.fp_root for r in out.orderBy("tree").collect()] == [python_tree("a\n\nb")[0], python_tree("")[0]]


LABELLED = "doc_id long, text string"


def toxic_tables(spark, n=400):
    """Texts, labels, and whether each is toxic: by one of three words, in a third of the texts."""
    rng = random.Random(13)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "wretched", "filthy"]
    rows = []
    for i in range(n):
        body = rng.choices(plain, k=30)
        if i % 3 == 0:
            body[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, LABELLED)
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 2, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_distributed_fit_equals_fit_in_memory(spark):
    rows, docs, labels = toxic_tables(spark)
    chain = toxicity.fit(docs.repartition(7), labels)
    y = np.array([[i % 5 == 0, i % 3 == 0, i % 15 == 0] for i, _ in rows])
    want = toxicity.fit_rows([toxicity.words(t) for _, t in rows], y, chain.names)
    assert chain.vocabulary == want.vocabulary and {b"vile", b"wretched", b"filthy"} <= set(chain.vocabulary)
    assert chain.thresholds == want.thresholds
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, want.weights, strict=True))
    # Scores row by row, and accuracy on rows that the chain has not seen.
    fresh, docs, _ = toxic_tables(spark, 900)
    scored = {r.doc_id: r.toxicity for r in toxicity.classify(docs, chain).collect()}
    wrong = 0
    for i, t in fresh:
        p = []
        present = toxicity.features(toxicity.words(t))
        x = [float(w in present) for w in chain.vocabulary]
        for w in chain.weights:
            z = sum(a * b for a, b in zip([*x, *p], w, strict=False)) + w[-1] if len(w) else None
            p.append(1 / (1 + np.exp(-z)) if z is not None else 0.0)
        assert np.allclose([scored[i][n] for n in chain.names], p)
        wrong += (p[1] > chain.thresholds[1]) != (i % 3 == 0)
    assert wrong <= 0.01 * len(fresh)


def test_toxicity_of_awkward_rows(spark):
    rows, docs, labels = toxic_tables(spark)
    more = [(None, None), (None, "vile"), (7, None), (7, "other text " * 20_000), (0, rows[0][1]), (1000, "")]
    docs = docs.union(spark.createDataFrame(more, LABELLED)).withColumns({"toxicity": F.lit("old"), "words": F.lit(1), "id": F.lit(2), "y0": F.lit(3)})
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (7, None, None), (7, 0, 1), (5000, 1, 1)], labels.schema))
    chain = toxicity.fit(docs.repartition(5), labels.repartition(3))
    again = toxicity.fit(docs.repartition(2), labels.repartition(1))
    assert chain.vocabulary == again.vocabulary and all(np.array_equal(a, b) for a, b in zip(chain.weights, again.weights))
    out = toxicity.classify(docs, chain)
    assert out.columns == docs.columns and out.count() == len(rows) + len(more)
    got = [r.toxicity.toxic for r in out.where("text IS NULL OR text = ''").collect()]
    assert len(set(got)) == 1 and got[0] <= chain.thresholds[1]
    small = toxicity.fit(docs, labels, limit=10)
    assert len(small.weights) == 3 and toxicity.fit(docs.limit(0), labels).vocabulary == ()
