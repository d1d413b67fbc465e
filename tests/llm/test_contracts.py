"""Each registered query against a brute-force version, over the driver's small tables and over awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import registry

AWKWARD = [
    (0, "", "en", "a"),
    (3, None, "en", None),
    (4, "   \n\t ", None, "b"),
    (5, "one", "en", "a"),
    (6, "one two", "en", "a"),
    (7, "It's we'll 'sable ''s 'tis don't 'S '  's\n\n's x y  z", "en", "a"),
    (8, "Under the MIT license, or Apache License Version 2; CC BY-NC. under the mit-license", "en", "b"),
    (9, "password: hunter2hunter2 TOKEN='abcdefgh' secret=short api_key:=x token=secret=abcdefgh1 password:token: abcdefgh12", "en", "b"),
    (10, "AKIAABCDEFGH1234 AKIASHORT 0123456789abcdef0123456789abcdef0 " + "f" * 31 + " AKIAAKIAAKIAAKIA", "en", "b"),
    (11, "Zażółć gęślą jaźń 中文字符 ΑΣ Σ ẞ İ 😀😀 é ½ ² \u0085 \x1c x", "pl", "ÿ"),
    (12, "word " * 30_000, "en", "hot"),
    (13, "same text of a copy, long enough", "en", "hot"),
    (14, "same text of a copy, long enough", "en", "hot"),
    (14, "same text of a copy, long enough", "en", "hot"),
    (15, "Same text of a copy, long  enough", "en", "hot"),
    (20, "a\n\nb\n\n\n# c\nd\n", "en", "z"),
    (21, "released under the mti license and redistributon and use in source or binary forms; all rihts reserved", "en", "z"),
    (22, "<|endoftext|> 'll 'LL x's", "en", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({"key": F.lit(1), "body": F.lit("x"), "id": F.lit(None).cast("string"), "bucket": F.lit(1)}).repartition(3).write.parquet(f"{d}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.5]), (20, [0.25, -0.3]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-1.0, -1.0]), (40, [nan, 0.0]), (60, [0.01, 0.02]), (1, [1.0, 0.5])]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://a.free-bets.example.com/x"), (800, "https://u@FREE-bets.example.com:80/"), (2, None), (3, "nonsense"), (4, ""), (7000, "http://tiontion.example.net"), (6800, "http://tiontion.example.net"), (-5, "http://x.example.net./")]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit("x")).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(awkward, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings", "labels", "pages"):
        spark.read.parquet(f"{awkward}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(params=["small", "awkward"])
def tables(request, sf_dir, awkward):
    return sf_dir if request.param == "small" else awkward


def documents(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted(((r.doc_id, r.text or "", r.source) for r in rows), key=lambda r: (r[0], r[1]))


def run(spark, name, d):
    return registry.QUERIES[name](spark, d).collect()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def by_id(rows, *names):
    return sorted(tuple(r[n] for n in ("doc_id", *names)) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def test_fingerprints(spark, tables):
    docs, rows = documents(spark, tables), run(spark, "op1_document_fingerprints", tables)
    want = []
    for (i, t, _), (_, n, _) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 2
        want.append((i, len(t), sha(t[: len(t) - k] + n[:k])))
    assert by_id(rows, "n_chars", "edited_sha256") == sorted(want)
    texts = defaultdict(set)
    for i, t, _ in docs:
        texts[i].add(t)
    roots = {r.doc_id: r.fingerprint for r in rows}
    assert len(set(roots.values())) == len({t for x in texts.values() for t in x})
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) == (sha(next(iter(texts[r.doc_id]))) == r.edited_sha256)


def test_bpe(spark, tables):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in documents(spark, tables):
        ids = e.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert by_id(run(spark, "op2_byte_level_bpe", tables), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


SECRETS = {
    "assign": (re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def test_secrets(spark, tables):
    want = []
    for i, t, _ in documents(spark, tables):
        spans = sorted((m.start(), k, m.end()) for k, (_, (p, ok)) in enumerate(SECRETS.items()) for m in p.finditer(t) if ok(m))
        names = list(SECRETS)
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))))
    rows = run(spark, "op3_secret_scans", tables)
    assert by_id(rows, "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    assert "awkward" not in tables or any(r.n_assign for r in rows)
    for r in rows:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in SECRETS]
        assert sha(",".join(base)) == r.base_sha256


def test_top_k(spark, tables):
    seen = {}
    for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect():
        v = r.embedding
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[r.vec_id] = np.floor(64 * np.array(v, np.float64)).astype(np.int64)
    ids = np.array(sorted(seen))
    m = np.stack([seen[i] for i in ids])
    want = []
    for q in ids[ids % 20 == 0]:
        s = m @ seen[q]
        best = [(-int(x), int(i)) for x, i in zip(s, ids) if i != q]
        want += [(int(q), k + 1, i, -x) for k, (x, i) in enumerate(sorted(best)[:20])]
    assert sorted(tuple(r) for r in run(spark, "op4_exact_top_k", tables)) == want


def test_simhash(spark, tables):
    import xxhash

    docs = documents(spark, tables)
    fps = []
    for _, t, _ in docs:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((d[0], f"{f:016x}", docs[find(i)][0]) for i, (d, f) in enumerate(zip(docs, fps)))
    assert by_id(run(spark, "op5_simhash_near_dedup", tables), "fingerprint", "component_id") == want


def test_mixing(spark, tables):
    docs = documents(spark, tables)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in docs]
    per = defaultdict(int)
    for (_, _, s), n in zip(docs, size):
        per[s] += n
    names = sorted((s for s in per if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * per[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * per[s]
            left -= target[s]
        free -= over
    target |= share
    rows = run(spark, "op6_mixing_sources", tables)
    assert sorted((r.doc_id, r["size"]) for r in rows) == sorted((d[0], n) for d, n in zip(docs, size))
    taken = defaultdict(int)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == per[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(rows) == key(run(spark, "op6_mixing_sources", tables))


def test_token_files(spark, tables):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = [], 0
    for i, text, _ in documents(spark, tables):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert by_id(run(spark, "op8_token_id_files", tables), "start", "n_tokens", "ids_crc32") == want


def test_licenses(spark, tables):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = []
    for i, t, _ in documents(spark, tables):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first = [k for k, _ in at]
        want.append((i, len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))))
    rows = run(spark, "op9_license_scans", tables)
    key = lambda r: (r[0], r[1], r[2], r[3] or -1, r[4] or -1, r[5])
    assert sorted(map(key, by_id_nulls(rows))) == sorted(map(key, want))
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    if tables.count("awkward"):
        assert next(r.labels for r in rows if r.doc_id == 21) == "all-rights-reserved,bsd,mit"


def by_id_nulls(rows):
    return [tuple(r[n] for n in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows]


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_oracles(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        import os

        p = f"{tables}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    q = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in q.description]
    want = sorted(q.fetchall(), key=repr)
    df = registry.QUERIES[name](spark, tables)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_toxicity_finds_planted(spark, sf_dir):
    rows = run(spark, "op7_toxicity", "/root/testdata/sf0.01")
    texts = {i: t for i, t, _ in documents(spark, "/root/testdata/sf0.01")}
    insults = re.compile(r"\b(loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid)\b", re.I)
    wrong = [r for r in rows if bool(insults.search(texts[r.doc_id])) != bool(r.toxic)]
    assert len(rows) == len(texts) and len(wrong) <= 0.005 * len(rows)
