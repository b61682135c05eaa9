"""Ranked search against plain Python over every document, the bounds of blocks, and cases that any table may hold."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pluvia.llm import search

D = "/root/testdata/sf0.001"
TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    """docs, items: (id, text). The rank's document and score for each item, equal ids and scores counted."""
    rows = [(i, Counter(plain_terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        q, got = Counter(plain_terms(text)), []
        for i, c, n in rows:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard, block_bytes", [(2048, 4 << 20), (37, 1500)])
def test_equals_brute_force(spark, shard, block_bytes):
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(search.search(docs.repartition(3), items, shard=shard, block_bytes=block_bytes)) == want


def test_cases(spark):
    big = 2**60
    long = "tree " * 300_000 + "fox " * 3
    data = [(big + 1, "Fox fox dog"), (big + 3, "fox DOG fox"), (None, "fox dog fox"), (5, None), (6, ""), (7, " ., !"), (8, "é fox É"), (8, "é fox É"), (9, long)]
    items = [(1, "fox Fox é"), (1, "dog"), (None, "fox"), (3, None), (4, ""), (5, "absent"), (6, "é É")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in data], "doc_id long, text string, score int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(search.search(docs, bench)) == brute(data, items)
    assert rows(search.search(docs, bench, k=2)) == brute(data, items, 2)
    assert search.search(docs.where("false"), bench).count() == 0 == search.search(docs, bench.where("false")).count()
    assert search.search(docs, bench).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(40, 0, -1)] + [(99, "other words")] * 60, "doc_id long, text string").repartition(4)
    got = rows(search.search(docs, spark.createDataFrame([(0, "two one")], "item_id long, text string")))
    assert sorted((r, i) for _, r, i, _ in got) == [(r, r) for r in range(1, 11)] and len({s for *_, s in got}) == 1


def groups(seed, n):
    """Documents of ten topics, with words of all topics in between."""
    rnd = random.Random(seed)
    return [" ".join(rnd.choice([f"t{k % 10}w{rnd.randrange(8)}", f"c{rnd.randrange(30)}"]) for _ in range(40)) for k in range(n)]


def test_blocks_bound_and_skip():
    """No document scores above its blocks' bounds, and blocks of other topics are left out."""
    texts = groups(1, 600)
    queries = search.Queries(["t3w1 t3w2 t3w3 t3w4 c1 c2", "t7w1 t7w5 c9"])
    found = [Counter(queries.vocab[t] for t in search.terms(x) if t in queries.vocab) for x in texts]
    weights = np.arange(1, len(queries.vocab) + 1, dtype=np.int64) * 900
    impact = [(np.array(list(c), dtype=np.int64), np.array([1_000_000_000 * f // (1000 * f + 800) for f in c.values()], dtype=np.int64)) for c in found]
    shard = search.Shard(queries, weights, list(range(len(texts))), impact)
    bound, which, members, begin = shard.bounds()
    for q, ts in enumerate(queries.terms):
        score = shard.x[:, ts] @ (weights[ts] * queries.times[q])
        for b, w in zip(bound[q], which[q]):
            assert score[members[begin[w]:begin[w + 1]]].max() <= b
        assert set(np.flatnonzero(score)) <= set(np.concatenate([members[begin[w]:begin[w + 1]] for w in which[q]]))
    best = [search.Best(5) for _ in queries.terms]
    shard.search(best)
    for q, ts in enumerate(queries.terms):
        score = shard.x[:, ts] @ (weights[ts] * queries.times[q])
        order = np.lexsort((np.arange(len(score)), -score))[:5]
        assert best[q].doc.tolist() == order.tolist()
    assert shard.visited < sum(map(len, which)) / 2
