"""The pipeline's stages against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from wireloom.llm import bpe, common, minhash, secrets, simhash, toxicity


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, sf_dir, tmp_path):
    d, docs = sf_dir, common.table(spark, sf_dir, "documents")
    names = [n for n, _ in pipeline.STAGES]
    seen = {}
    before = docs
    for name, stage in pipeline.STAGES:
        stage(spark, before, d).write.parquet(f"{tmp_path}/{name}")
        seen[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != names[-1]:
            assert before.columns == docs.columns
    chain = toxicity.fit(docs, common.table(spark, d, "labels"))
    all_rows = docs.collect()
    p = chain.probabilities(chain.presence([r.text for r in all_rows]))[:, 1]
    kept = [r for r, q in zip(all_rows, p, strict=True) if q <= chain.thresholds[1]]
    assert rows(seen[names[0]]) == sorted(map(tuple, kept), key=repr) and len(kept) > 0.8 * len(all_rows)

    sets = [set(simhash.shingle_hashes(r.text, 5)) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for r, g in zip(kept, group, strict=True):
        least[g] = r if least[g] is None or r.doc_id < least[g].doc_id else least[g]
    kept = sorted(map(tuple, least.values()), key=repr)
    assert rows(seen[names[1]]) == kept

    def clean(text):
        spans = []
        for rule in secrets.RULES:
            pattern = re.sub(r"\(\((\?i):(.*?)\)\)", r"((?i:\2))", rule.pattern)
            spans += [(m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[rule.group]) >= rule.least]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        return out + text[at:]

    want = [(i, clean(t), lang, s, len(clean(t))) for i, t, lang, s, _ in kept]
    assert rows(seen[names[2]]) == sorted(want, key=repr)

    mixed = Counter(r.doc_id for r in seen[names[3]].collect())
    texts = {w[0]: w for w in want}
    assert set(mixed) <= set(texts) and max(mixed.values()) <= 2
    size = {i: len((w[1] or "").split()) for i, w in texts.items()}
    total, taken = sum(size.values()), sum(size[i] * n for i, n in mixed.items())
    assert abs(taken - 1.5 * total) <= max(size.values()) * len({w[3] for w in want})

    codec = bpe.Codec(bpe.rank_file())
    want = []
    for i, n in mixed.items():
        ids = next(codec.encode_texts([texts[i][1]]))[0]
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i][1].encode()).hexdigest())
        want += [row] * n
    assert rows(seen[names[4]]) == sorted(want, key=repr)
    assert pipeline.ORACLE_SQL is None


def test_awkward_rows(spark, tmp_path):
    text = "a long enough text that stands here more than once in the table"
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 64), (4, text, "en", "b", 64), (4, text, "en", "b", 64), (None, "x " * 50_000, "en", None, 100_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, part in (("full", docs), ("none", docs.limit(0))):
        d = f"{tmp_path}/{name}"
        part.write.parquet(f"{d}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{d}/labels.parquet")
        got = pipeline.run(spark, d)
        assert (got.count() > 0) == (name == "full")


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=200):
    return [hashlib.sha256(f"{seed}-{i}".encode()).hexdigest()[:6] for i in range(n)]


def test_near_dedup_reaches_similarity_08(spark):
    """Copies with 3 to 4 words changed in 200 (similarity 0.82 to 0.86) go, unlike ones of 9 (0.63); chains go as one."""
    data = []
    for k in range(40):
        base = prose(k)
        data.append((10 * k, " ".join(base)))
        for j, edits in enumerate((3, 4, 9), 1):
            at = {(17 + 20 * i + j) % 195 for i in range(edits)}
            data.append((10 * k + j, " ".join("new" + w if i in at else w for i, w in enumerate(base))))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], SHAPE)
    got = {r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").collect()}

    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in data}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    for k in range(40):
        ids = range(10 * k, 10 * k + 4)
        for _ in ids:
            for a in ids:
                for b in ids:
                    if similar(a, b):
                        root[a] = root[b] = min(root[a], root[b])
    assert got == set(root.values()) and len(got) == 80


def test_near_dedup_tells_rows_apart(spark):
    """Rows of null or repeated ids stay where their texts differ; copies of a text go."""
    texts = [" ".join(prose(f"row-{k}", 50)) for k in range(30)]
    data = [(None if k % 2 else 7, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    data += [data[0], data[1], (3, texts[2], "en", "b", len(texts[2]))]
    got = pipeline.near_dedup_stage(spark, spark.createDataFrame(data, SHAPE), "").collect()
    assert sorted(r.text for r in got) == sorted(texts)
    assert {r.doc_id for r in got if r.text == texts[2]} == {3}


def test_near_dedup_has_simhash_candidates(spark):
    """The sets that share a SimHash group are those whose fingerprints three bits connect."""
    base = prose("long", 4000)
    texts = [" ".join(base[:i] + ["new"] * (i > 0) + base[i + 1 :]) for i in (0, 7, 900, 2500)] + [" ".join(prose(f"other-{k}", 300)) for k in range(20)]
    rows = spark.createDataFrame([(k, k, k, t) for k, t in enumerate(texts)], "r1 long, r2 long, id long, text string")
    signed = minhash.signatures(rows).cache()
    fp = {r.id: r.fp for r in signed.collect()}
    value = {r.fp: r.value for r in minhash.simhash_groups(signed).collect()}
    sims = [simhash.simhash(t, 5) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sims):
            for j, b in enumerate(sims):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(root)) < len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (root[i] == root[j]) == (value[fp[i]] == value[fp[j]])
