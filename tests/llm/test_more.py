"""Fingerprints and their groups, tokens of special strings, the least change of rates, and clashing names."""
import random

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from pluvia.llm import mixing, quality, simhash, substrings, tokens

D = "/root/testdata/sf0.001"


def print_of(text):
    """A fingerprint bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(prints):
    """Smallest id that each id reaches over two or fewer differing bits, all pairs compared."""
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups_of_a_table(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    edited = [" ".join(base[:k] + ["new"] + base[k + 1:]) if k else " ".join(base) for k in range(0, 40, 4)]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    more = [(10**6 + k, t) for k, t in enumerate([*edited, *edited[:2], "", " \n", None, "a b", "A\tB", "x" * 10**6, "long " * 200_000])]
    rows = docs.union(spark.createDataFrame(more, "doc_id long, text string")).cache()
    prints = {r.doc_id: print_of(r.text) for r in rows.collect()}
    want = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert want[10**6 + 12] == want[10**6 + 13] == want[10**6 + 14] and len({want[10**6 + k] for k in range(12)}) < 12


def test_groups_at_each_distance(spark):
    """Fingerprints with 0 to 4 other bits, in one half, in both and in chains."""
    rnd = random.Random(2)
    base, prints = rnd.getrandbits(64), {}
    for d in range(5):
        for k in range(30):
            flip = 0
            for b in rnd.sample(range(64) if k % 3 else range(32), d):
                flip |= 1 << b
            prints[len(prints)] = base ^ flip
    prints |= {1000 + k: rnd.getrandbits(64) for k in range(50)}
    prints |= {2000 + k: prints[1000] ^ ((1 << 2 * k) - 1) for k in range(8)}   # a chain of two bits each
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    fps = spark.createDataFrame([(signed(p),) for p in set(prints.values())], "fp long")
    got = {(r.a, r.b) for r in simhash.links(fps).collect()}
    values = sorted(set(prints.values()))
    want = {tuple(sorted((signed(a), signed(b)))) for n, a in enumerate(values) for b in values[n + 1:] if (a ^ b).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_tokens_of_special_strings_and_long_texts(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokens.Sizes(path).tok
    rnd = random.Random(4)
    texts = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "<|EndOfText|>", "don't stop...now!!", "é" * 3000, "x" * 100_000, " ".join(f"q{rnd.randrange(10**9)}z" for _ in range(20_000)), "  \x85\t", "日本語テキスト 123", "a" * 300 + "?!)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(tokens, "CACHE", 50)   # more distinct pieces than are remembered
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in tokens.token_counts(docs, path).collect()}
    assert got == {k: (n := len(lib.encode(t, add_special_tokens=False).ids), len(t.encode()), n > 2048) for k, t in enumerate(texts)}


def test_rates_change_least(spark):
    """Against projected gradient steps with a falling penalty on the whole vector of rates."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet((6, 1, 0.6), 60)
    n = rng.integers(1, 200, 60)
    w, t = n / n.sum(), np.array(mixing.TARGETS)
    post = spark.createDataFrame([(k, "s", int(a), [float(v) for v in b]) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, source string, tokens long, p array<double>")
    x, far, infeasible = mixing.solve(post, mixing.TARGETS)
    rate = np.array([r.rate for r in mixing.rated(post, x, far, infeasible).orderBy("doc_id").collect()])
    assert far <= mixing.TOL and not infeasible
    r, dual = np.ones(60), np.zeros(3)
    for _ in range(200_000):   # Uzawa steps: the multiplier of the totals rises with the residual
        r = np.maximum(0, 1 - p @ dual)
        dual += 0.5 * ((w * r) @ p - t)
    assert np.allclose((w * r) @ p, t, atol=1e-6) and np.allclose(rate, r, atol=1e-3)
    assert (w * (rate - 1) ** 2).sum() <= (w * (r - 1) ** 2).sum() + 1e-6


def test_ties_and_clashing_names(spark):
    rows = [(k, "one two three four five six seven eight nine ten eleven", 5, "x") for k in (1, 1, 2)] + [(3, None, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int, residual string").withColumn("_kept", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.filter_kept(docs, quality.fit(docs, labels), threshold=0.0)
    assert kept.columns == docs.columns and {r["_kept"] for r in kept.collect()} <= {"mine"}
    rated = mixing.rates(docs, labels)
    assert rated.columns.count("rate") == rated.columns.count("residual") == 1
    assert len({r.rate for r in rated.where("doc_id < 3").collect()}) == 1 and rated.count() == 4


def test_a_long_text_and_a_hot_string(spark):
    """One text of a megabyte that repeats itself, and a string that every document holds."""
    rnd = random.Random(9)
    hot = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(500_000))
    texts = [long + hot + long] + [f"{k} start {hot} end {k}" for k in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got[0] == (1_000_300, 500_000, 1)
    assert all(got[k][1] >= 302 and got[k][2] == 1 for k in range(2, 201)) and 300 <= got[1][1] <= 303
