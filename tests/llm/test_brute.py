"""The operators' fixed columns against plain Python over every text of a small table, and held-out figures."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import coder, decontaminate, license, lm, pii, quality, toxicity

D = "/root/testdata/sf0.001"
SPACE = "[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "CC by cc BY, all rights\nreserved 4111 1111 1111 1111 a@b.c.d +49 (30) 1234-5678 300.1.1.1 1.2.3.4"), (10**6 + 3, "w" * 20_000 + " " + "é ß " * 3000),
             (10**6 + 4, "é.b@c.de, CC by 1.2.3.4 x\n" * 1300)]
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).coalesce(2).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def held(i, k):
    return zlib.crc32(str(i).encode()) % k == 0


def test_license_base(docs, texts):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for r in license.report(docs).collect():
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id]))
        hits = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i:i + len(p)] == p]
        at = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_quality_counts(docs, texts, labels):
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        t = texts[r.doc_id]
        w = re.findall(SPACE, t)
        lines, seen, dup = [x for x in t.split("\n") if re.search(SPACE, x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep))
        bad = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        assert r.base_failed == bad and not (bad and r.kept)


def test_trees_are_monotone_and_fit():
    rng = np.random.default_rng(5)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(2000) < 0.05)).astype(float)
    m = quality.fit_trees(x, y)
    assert ((quality.predict(m, x) >= 0.5) == (x[:, 2] < 0.5)).mean() > 0.95
    for name, way in quality.MONOTONE.items():
        j = quality.FEATURES.index(name)
        z = np.repeat(x[:50, None, :], 40, axis=1)
        z[:, :, j] = np.linspace(0, 1, 40)
        p = quality.predict(m, z.reshape(-1, x.shape[1])).reshape(50, 40)
        assert (way * np.diff(p, axis=1) >= -1e-12).all()


def test_language_model_base(docs, texts):
    words = {i: [*re.findall(SPACE, lower(t)), "\n"] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if not held(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = lm.scores(docs).collect()
    for r in rows:
        ws = words[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and r.bits_per_byte > 0
    few = {r.doc_id: r for r in lm.scores(docs, frequent=50).collect()}   # most tokens joined
    assert all(few[r.doc_id].base_score == pytest.approx(r.base_score, rel=1e-9) and few[r.doc_id].n_known == r.n_known for r in rows)


def test_code_is_a_distribution():
    code = coder.Code(np.array([50, 20, 20, 5, 3, 1, 1]))
    assert sum(2.0 ** -code.length) == 1
    model = coder.Model(code, 2, 13, [])
    ctx = [np.full(7, 3, dtype=np.uint64), np.zeros(7, dtype=np.int32)]
    lp = model.log10(np.arange(7), ctx, np.tile(model.w, 7), np.arange(7) * model.w.shape[1])
    assert (10 ** lp).sum() == pytest.approx(1, abs=1e-4)


def test_every_token_is_a_context():
    """Rare tokens with the same last bytes, and own tokens of any rank, are told apart by what follows them."""
    own = [b"o%03d" % i for i in range(lm.OWN - 1)]
    rare = [b"x%05d77" % i for i in range(40)]
    tokens, c = [lm.END, *own, *rare], np.array([10**6, *range(5000, 5000 - len(own), -1), *[3] * len(rare)])
    v = lm.Vocabulary(tokens, c, int(c.sum()), len(c), [(t[-2:], int(k), 1) for t, k in zip(tokens, c)], 0.5)

    def context(*before):
        _, x, text, word, _, _ = v.read([b" ".join([*before, b"last"]).decode()])
        return tuple(int(a[len(before)]) for a in v.contexts(x, text, word))
    seen = {context(own[0], t) for t in [*rare, b"unknown77", b"other77"]} | {context(t, own[0]) for t in own} | {context(), context(own[1])}
    assert len(seen) == len(rare) + 2 + len(own) + 2
    assert max(int(max(a, b)) for a, b, _ in seen) * len(v.code.odds) < v.slots()


def test_long_token_is_linear(spark):
    d = spark.createDataFrame([(1, "ab" * 1_000_000 + " the end"), (2, "the end " * 50)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scores(d).collect()}
    assert got[1].n_tokens == 4 and math.isfinite(got[1].score)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(ds):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(ds)))) % 10 == 0


def fine(kind, v):
    ds = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(ds) <= 19 and luhn(ds), "phone": 9 <= len(ds) <= 15}[kind]


def test_personal_data_base(docs, texts):
    for r in pii.report(docs).collect():
        t = texts[r.doc_id]
        base = [(k, m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, t) if fine(k, m[0])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k, _ in KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_toxicity_held_out(docs, labels, texts):
    y = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(docs, labels).collect()]
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    assert sum(p == t for p, t in seen) / len(seen) >= 0.85


@pytest.mark.parametrize("written", ["1d10t", "id1ot", "idiooooot", "i.d.i.o.t", "1 d 1 0 t", "i d i o t", "!d!0t###", "iidiot", "idiöt", "іdiot", "idi0t" * 3, "idio" + "o" * 500 + "t"])
def test_restoring(written):
    words = [b"idiot", b"worthless"]
    prose = toxicity.trigrams([b"the", b"reading", b"nation", b"within", b"other"] * 50)
    r = toxicity.Restorer(toxicity.log_model(prose, toxicity.trigrams(words)), words)
    assert b"idiot" in r.words(f"they read {written} within")
    assert r.words("the 2nd nation, within 1999") == [b"the", r.restore(b"2nd"), b"nation", b"within", b"1999"]


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_decontamination_recall(spark, rate, least):
    """Passages of 40 words with a part of their words replaced, found by the seeds and verified."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(vocab) for _ in range(40)] for _ in range(150)]
    change = lambda w: [rng.choice(vocab) if rng.random() < rate else x for x in w]
    d = spark.createDataFrame([(i, " ".join([rng.choice(vocab) for _ in range(100)] + change(w) + [rng.choice(vocab) for _ in range(50)])) for i, w in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(d, b).collect()}
    assert all(i == k for i, k in got) and len(got) / len(items) >= least


def test_overlap_runs():
    """Two runs along one alignment are both found."""
    w = np.arange(60, dtype=np.uint64)
    h = np.concatenate([w[:20], np.arange(100, 120, dtype=np.uint64), w[40:]])
    assert [v[:2] for v in decontaminate.verify(h, w, 0)] == [(0, 19), (40, 59)]


def stretches(equal):
    """Every stretch with at least 80 % equal words: (length, first, end)."""
    n = len(equal)
    return [(j - i, -i, j) for i in range(n) for j in range(i + 1, n + 1) if 5 * sum(equal[i:j]) >= 4 * (j - i)]


def test_longest_run_against_every_stretch():
    rnd = random.Random(6)
    for _ in range(400):
        equal = [rnd.random() < 0.75 for _ in range(rnd.randrange(1, 30))]
        lo, hi = decontaminate._longest(np.array(equal))
        best = max(stretches(equal), default=(0, 0, 0))
        assert hi - lo == best[0] and (not best[0] or 5 * sum(equal[lo:hi]) >= 4 * (hi - lo))
        w = np.arange(100, 100 + len(equal), dtype=np.uint64)
        h = np.where(equal, w, 0).astype(np.uint64)
        got = decontaminate.verify(h, w, 0)
        found = any(sum(equal[-i:j]) >= min(10, len(equal)) for _, i, j in stretches(equal))
        assert bool(got) == found


@pytest.mark.parametrize("words", [12, 16, 20, 25, 40])
def test_recall_by_length(spark, words):
    """One word of ten is replaced; a passage is to be found if ten of its words stand in a stretch of 80 %."""
    rnd = random.Random(words)
    items, docs, due = [], [], set()
    for k in range(150):
        item = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        copy, equal = list(item), [True] * words
        for i in rnd.sample(range(words), max(1, words // 10)):
            copy[i], equal[i] = "other", False
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([f"x{rnd.randrange(10**6)}" for _ in range(30)] + copy + ["end"] * 5)))
        if any(sum(equal[-i:j]) >= 10 for _, i, j in stretches(equal)):
            due.add((k, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= {(k, k) for k in range(150)} and len(due) > 100
    assert len(got & due) == len(due)


def test_pairs_equal_every_offset(spark, docs, texts):
    """All documents against all items at every offset that has enough equal words, whatever the seeds."""
    bench = spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text")
    short = spark.createDataFrame([(-1, "all rights"), (-2, "4111 1111 1111"), (-3, None)], "item_id long, text string")
    items = {r.item_id: decontaminate.word_hashes(r.text) for r in bench.union(short).collect()}
    want, want_short = set(), set()
    for i, t in texts.items():
        h = decontaminate.word_hashes(t)
        at = {}
        for p, x in enumerate(h.tolist()):
            at.setdefault(x, []).append(p)
        for k, w in items.items():
            least = min(10, len(w))
            offs = Counter(p - q for q, x in enumerate(w.tolist()) for p in at.get(x, ()))
            if any(n >= least and decontaminate.verify(h, w, o) for o, n in offs.items()):
                (want if len(w) >= 5 else want_short).add((i, k))
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.select("doc_id", "item_id").distinct().collect()}
    assert pairs(decontaminate.pairs(docs, bench.union(short))) == want and len(want) >= 3
    every = decontaminate.overlaps(docs, bench.union(short), least_item=1)
    assert pairs(every) == want | want_short and want_short
    shuffled = docs.repartition(3, "doc_id")
    assert sorted(map(tuple, decontaminate.overlaps(shuffled, bench.union(short), 0, 1).collect())) == sorted(map(tuple, every.collect()))
    assert decontaminate.pairs(docs.where("false"), bench).count() == 0


def test_many_matches_in_one_text(spark):
    """More spans than a fold gathers at once: places and replacements stay right to the end of the text."""
    t = "".join(f"é{k} m{k}@x.org {'pad ' * (k % 7)}" for k in range(1500))
    docs = spark.createDataFrame([(1, t, 5)], "doc_id long, text string, n_chars int")
    none = {"roots": [], "threshold": 2.0}
    want = [(m.start(), m.end()) for m in re.finditer(r"m\d+@x\.org", t)]
    assert pii.report(docs, none).first().spans == ",".join(f"email:{a}:{z}" for a, z in want)
    new = pii.redact(docs, none).first()
    assert new.text == re.sub(r"m\d+@x\.org", "[email]", t) and new.n_chars == len(new.text)
    got = license.detect(spark.createDataFrame([(1, "MIT License and cc by " * 900)], "doc_id long, text string")).first()
    assert (got.n_base, got.last_word, len(got.detections)) == (900, 899 * 5 + 3, 900)
    text = "0123456789" * 200
    row = spark.createDataFrame([(text,)], "t string").select(*[pii.piece(pii.chunked(F.col("t")), F.lit(a), F.lit(z)).alias(f"{a}_{z}") for a, z in ((0, 0), (0, 5), (510, 514), (512, 1024), (3, 1999), (1990, 2000), (7, 3))]).first()
    assert list(row) == [text[a:z] for a, z in ((0, 0), (0, 5), (510, 514), (512, 1024), (3, 1999), (1990, 2000), (7, 3))]
