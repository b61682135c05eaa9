import hashlib
import random

import pytest

from pluvia.llm import substrings


def brute(texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = [True] * 100
            seen.add(b[p:p + 100])
        want[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return want


@pytest.mark.parametrize("batch", [3, 50, 10_000])
def test_equal_brute_force(spark, batch):
    """Periodic, repeated, edited and random texts; small batches carry the scans' state over their ends."""
    rng = random.Random(batch)
    parts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (1, 3, 40, 90, 130, 260)] + ["é" * 70]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101]
    for _ in range(60):
        t = "".join(rng.choice(parts) * rng.choice((1, 1, 2, 5, 40 if rng.random() < 0.1 else 1)) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.4 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "z" + t[k + 1:]
        texts.append(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(texts)


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
