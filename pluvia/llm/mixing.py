"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

Domains come from the labelled table: 0 sound, 1 low quality, 2 toxic. A classifier on hashed words and coarse text
statistics gives each text its posteriors. Null and empty texts have no tokens and rate 1; repeated rows keep their own
result; a null doc_id has no label and is rated like any other; columns of docs that are named like the added ones are
replaced; an empty table gives an empty result."""
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .toxicity import platt

TARGETS = (0.93, 0.05, 0.02)
SAMPLE, BUCKETS = 40_000, 1 << 18   # labelled rows the classifier is fitted on, at most; hashed features
STRONGEST = 3                    # features of a domain that count in one text
TOL, STEPS = 1e-6, 60            # largest residual of a domain's share of all tokens; steps of each tie-breaker
EASE = (1e-3, 1e-6, 1e-9)        # weights of the tie-breaker
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ADDED = "tokens long, p array<double>"


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Words of the text and its distinct hashed features: its words, and steps of five statistics."""
    b = (text or "").encode("utf-8").translate(_LOWER)
    words = b.split()
    n, distinct = len(words), set(words)
    lines = [x for x in b.split(b"\n") if x]
    of = lambda k, m: round(8 * k / max(m, 1))
    coarse = (min(n.bit_length(), 12), of(len(distinct), n), of(len(b) - len(b.translate(None, b"#*$%&|<>!")), n), of(len(lines) - len(set(lines)), len(lines)), len(b) // max(n, 1))
    h = np.fromiter(map(xxhash.xxh32_intdigest, distinct), dtype=np.int64, count=len(distinct)) if n else np.zeros(0, np.int64)
    own = [xxhash.xxh32_intdigest(f" {i} {min(v, 40)}") for i, v in enumerate(coarse)] if n else []
    return n, np.unique(np.concatenate([h, np.array(own, dtype=np.int64)]) % BUCKETS)


def _evidence(f: np.ndarray, w: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Sum of each domain's strongest weights."""
    f = f[used[f]]
    if not len(f):
        return np.zeros(len(w))
    got = w[:, f]
    return (got if len(f) <= STRONGEST else np.partition(got, -STRONGEST, axis=1)[:, -STRONGEST:]).sum(axis=1)


def fit(docs: DataFrame, labelled: DataFrame, classes: int, sample: int = SAMPLE) -> dict:
    """labelled (doc_id, y); at most `sample` rows, the smallest by hash. Of these four fifths give the lower bound of each
    feature's log odds against the rest, one fifth the slope and offset that make the evidence a probability."""
    ids = labelled.where("y is not null AND doc_id is not null").select("doc_id", "y").orderBy(F.xxhash64("doc_id")).limit(sample)
    ids = ids.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) > 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def count(it):
        n, of = np.zeros((classes, BUCKETS + 1), dtype=np.int64), classes * (BUCKETS + 1)
        for pdf in it:
            for t, y in zip(pdf["text"], pdf["y"]):
                n[y, features(t)[1]] += 1
                n[y, BUCKETS] += 1
        k = np.flatnonzero(n.ravel()[:of])
        yield pd.DataFrame({"k": k, "n": n.ravel()[k]})
    got = rows.where("own").select("text", "y").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS x classes rows at most
    n = np.zeros((classes, BUCKETS + 1))
    n.ravel()[got["k"].to_numpy()] = got["n"].to_numpy()
    w = np.zeros((classes, BUCKETS), dtype=np.float32)
    for k in range(classes):
        a, b, na, nb = n[k, :-1], n[:, :-1].sum(axis=0) - n[k, :-1], n[k, -1], n[:, -1].sum() - n[k, -1]
        w[k] = np.maximum(0, np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    used = (w > 0).any(axis=0)
    b = docs.sparkSession.sparkContext.broadcast((w, used))

    def measure(it):
        for pdf in it:
            yield pd.DataFrame({"y": pdf["y"], "s": [_evidence(features(t)[1], *b.value) for t in pdf["text"]]})
    seen = rows.where("NOT own").select("text", "y").mapInPandas(measure, "y int, s array<double>").toPandas()  # a fifth of `sample` rows at most
    x, y = np.array(seen["s"].tolist(), dtype=np.float64).reshape(-1, classes), seen["y"].to_numpy()
    return {"w": w, "used": used, "fit": np.array([platt(x[:, k], (y == k).astype(float)) for k in range(classes)])}


def posteriors(docs: DataFrame, labels: DataFrame, texts: bool = False) -> DataFrame:
    """The columns of docs, text only with `texts`, and tokens, p."""
    y = labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END AS y")
    b = docs.sparkSession.sparkContext.broadcast(fit(docs, y, len(TARGETS)))

    def run(values):
        m, n, z = b.value, [], []
        for t in values:
            k, f = features(t)
            n.append(k)
            z.append(_evidence(f, m["w"], m["used"]))
        z = np.array(z, dtype=np.float64).reshape(-1, len(m["w"])) * m["fit"][:, 0] + m["fit"][:, 1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return n, list(e / e.sum(axis=1, keepdims=True))
    return map_texts(docs, run, ADDED, keep=texts)


def solve(post: DataFrame, targets=TARGETS) -> tuple[np.ndarray, float, bool]:
    """(x, residual, infeasible) for post (tokens, p): the rates max(0, 1 - p.x) are those of least token-weighted change from
    1 whose domain totals over all tokens are the targets. Projected gradient on the squared residual: each step moves every rate
    along its p by the same K numbers and projects it on the nonnegative ones; one aggregate gives the K sums of the gradient and
    the K x K curvature that scales it. A tie-breaker falls in turn until the largest residual is at most TOL. Where targets
    can't be met, m is nearest to them: no rates of total 1 reach a lower (m - t).A r than its least value over the texts, so
    targets below that are proved infeasible."""
    t, K = np.array(targets, dtype=float), len(targets)
    total = post.agg(F.sum("tokens")).first()[0] or 0
    x, far, proved = np.zeros(K), 0.0, False
    if not total:
        return x, far, proved
    w = F.col("tokens") / F.lit(float(total))
    dot = lambda v: reduce(lambda a, b: a + b, [F.col("p")[k] * F.lit(float(v[k])) for k in range(K)])
    def at(v):
        df = post.select("p", w.alias("w"), F.greatest(F.lit(0.0), 1 - dot(v)).alias("r"))
        live = F.when(F.col("r") > 0, F.col("w")).otherwise(0.0)
        got = df.agg(*[F.sum(F.col("w") * F.col("r") * F.col("p")[k]) for k in range(K)], F.sum(F.col("w") * F.col("r") * F.col("r")),
                     *[F.sum(live * F.col("p")[i] * F.col("p")[j]) for i in range(K) for j in range(K)]).first()
        return np.array(got[:K]), got[K], np.array(got[K + 1:]).reshape(K, K)
    now = at(x)
    for ease in EASE:
        value = lambda v, s: -s[1] / 2 - t @ v - ease * v @ v / 2
        for _ in range(STEPS):
            g = now[0] - t - ease * x
            if np.abs(g).max() <= TOL / 10:
                break
            d, step = np.linalg.solve(now[2] + ease * np.eye(K), g), 1.0
            new = at(x + d)
            while value(x + step * d, new) < value(x, now) + 1e-4 * step * (g @ d) - 1e-12 and step > 1e-4:
                step /= 2
                new = at(x + step * d)
            x, now = x + step * d, new
        far = float(np.abs(now[0] - t).max())
        if far <= TOL:
            break
        y = now[0] - t
        proved = bool(t @ y < post.where("tokens > 0").agg(F.min(dot(y))).first()[0] - 1e-12)
        if proved and np.abs(ease * x - y).max() <= TOL and ease <= EASE[-2]:
            break
    return x, far, proved


def rates(docs: DataFrame, labels: DataFrame, targets=TARGETS, texts: bool = False) -> DataFrame:
    """The columns of docs, text only with `texts`, and tokens, p, rate, and in every row the largest difference of a domain's
    share from its target and whether the targets are proved out of reach."""
    post = written(posteriors(docs, labels, texts))
    return rated(post, *solve(post, targets))


def rated(post: DataFrame, x: np.ndarray, residual: float, infeasible: bool) -> DataFrame:
    moved = reduce(lambda a, b: a + b, [F.col("p")[k] * F.lit(float(v)) for k, v in enumerate(x)])
    rate = F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), 1 - moved)).otherwise(1.0)
    return post.withColumn("rate", rate).withColumn("residual", F.lit(residual)).withColumn("infeasible", F.lit(infeasible))
