import random

import pytest

import corpus_pipeline
from pluvia.llm import minhash, simhash

D = "doc_id long, text string, source string"


def brute(texts):
    """Component of each text, by the exact similarity of five-word shingles."""
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    s = [sh(t) for t in texts]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    comp = list(range(len(s)))
    for _ in s:
        new = [min(comp[j] for j in range(len(s)) if like(s[i], s[j])) for i in range(len(s))]
        if new == comp:
            return comp
        comp = new


def test_keep_one_copy_against_brute_force(spark):
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(3000)]
    texts = [None, "", "Two words", "two  WORDS", "two word"]
    for k in range(40):
        w = [r.choice(vocab) for _ in range(r.choice((60, 200, 400)))]
        texts.append(" ".join(w))
        for edits in (1, 2, 4, 8, 16):   # from near copies to texts under the threshold
            v = list(w)
            for i in r.sample(range(len(v)), edits):
                v[i] = r.choice(vocab)
            texts.append(" ".join(v))
    comp = brute(texts)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], D)
    got = {x.doc_id for x in corpus_pipeline.keep_one_copy(spark, docs, None).collect()}
    assert got == {i for i, c in enumerate(comp) if i == c}


@pytest.mark.parametrize("block", [8, 256])
def test_large_buckets_by_blocks(spark, monkeypatch, block):
    """Copies of one text with few and with many words changed: one bucket holds most of them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(13)
    base = ["w%d" % i for i in range(200)]
    texts = []
    for k in range(120):
        w = list(base)
        for i in r.sample(range(200), r.choice((1, 2, 4, 6, 9, 14))):
            w[i] = "x%d" % r.randrange(10**6)
        texts.append(" ".join(w))
    comp = brute(texts)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], D)
    assert {x.doc_id for x in minhash.keep_one(docs).collect()} == {i for i, c in enumerate(comp) if i == c}


def test_keep_one_copy_keeps_rows_without_id(spark):
    a, b = (" ".join("%s%d" % (p, i) for i in range(50)) for p in "ab")
    docs = spark.createDataFrame([(None, a, "s"), (None, b, "s"), (3, b, "s"), (3, b, "s")], D)
    got = corpus_pipeline.keep_one_copy(spark, docs, None).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, a), (3, b)]
    assert minhash.keep_one(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    """Every stage but the last returns the columns of documents; what each drops is what brute force drops."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and {"rate", "residual"} <= set(out.columns)
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == list(docs.columns) and set(r.doc_id for r in docs.select("doc_id").collect()) <= set(before)
    bench = [set(zip(*[r.text.lower().split()[k:] for k in range(10)])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for r in rows:
        w = (r.text or "").lower().split()
        assert not any(g & set(zip(*[w[k:] for k in range(10)])) for g in bench)
        assert "@" not in (r.text or "") or not __import__("re").search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    texts = [before[r.doc_id] for r in rows]
    assert brute(texts) == list(range(len(texts)))   # no two kept texts are near copies


def test_near_copies_come_through_simhash_classes(spark):
    """Long texts with one word changed are found by their fingerprints alone, without a band; a like fingerprint of an unlike
    text gives no link."""
    base = ["w%d" % i for i in range(6000)]
    texts = [" ".join(base), " ".join([*base[:3000], "other", *base[3001:]]), " ".join("z%d" % i for i in range(5900)), ""]
    sh = [minhash.shingles(t) for t in texts]
    fp = [simhash.majority(s) for s in sh]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 < (fp[0] ^ fp[2]).bit_count() and fp[3] == 0
    fp[2] = fp[0]
    sets = spark.createDataFrame([(i, len(s), [], minhash.sketch(minhash.minima(s)), int(f) - (f >> 63 << 64)) for i, (s, f) in enumerate(zip(sh, fp))],
                                 "rid long, n long, bands array<long>, sk array<long>, fp long")
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    assert sorted(map(tuple, minhash.links(sets, rows).collect())) == [(0, 0), (1, 0)]
