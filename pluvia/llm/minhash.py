"""Near copies by five-word shingles: SimHash classes and, for pairs further apart than these reach, MinHash bands propose
pairs of texts; their exact Jaccard similarity decides.

Null and empty texts are copies of each other; texts of fewer words have one shingle; one row of each component stays,
that of the smallest doc_id (null ids after all others), so repeated rows are copies like any other. Words are runs
without ASCII white space, A-Z lower-cased."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, few, is_scan, sent_if_few, written
from .simhash import _LOWER, classes, majority

N, LEAST = 5, 0.8
BANDS, ROWS = 20, 5   # a pair at LEAST shares a band with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996
SKETCH = 35   # differing minima (by two bits of each) that a pair may have to be compared: 15 are expected at LEAST, and more
              # than 35 have a probability of two in ten million
_EVEN = 0x5555555555555555
BLOCK = 256   # texts of a large bucket that are compared with as many others at a time; buckets up to a quarter of it are small
_MUL = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = len(h) - n + 1
    acc = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + size]
    return np.unique((acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def minima(s: np.ndarray, block: int = 2048) -> np.ndarray:
    """The BANDS * ROWS smallest values; zeros for no shingles."""
    if not len(s):
        return np.zeros(len(_MUL), dtype=np.uint64)
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), block):
        low = np.minimum(low, (_MUL[:, None] * s[None, k:k + block]).min(axis=1))
    return low


def bands(low: np.ndarray) -> list[int]:
    """One hash for each band of ROWS minima."""
    low = low.reshape(BANDS, ROWS)
    acc = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + low[:, k]
    return acc.view(np.int64).tolist()


def sketch(low: np.ndarray) -> list[int]:
    """Two bits of each minimum, 32 minima in a number."""
    two = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    two = np.append(two, np.zeros(-len(two) % 32, dtype=np.uint64)).reshape(-1, 32)
    return np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        sets = [shingles(t) for t in pdf["text"]]
        low = [minima(s) for s in sets]
        yield pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], "words": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets],
                            "bands": [bands(x) for x in low], "sk": [sketch(x) for x in low], "fp": np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)})


def _verified(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        known = {}
        def of(i, t):
            if i not in known:
                known[i] = shingles(t)
            return known[i]
        fine = [similarity(of(a, x), of(b, y)) >= LEAST for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"])]
        yield pdf.loc[fine, ["a", "b"]]


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) at LEAST or more; texts (rid, text). Where the pairs are few enough to be sent to every task, only the
    texts of pairs are shuffled: the first one's with its pairs, the second one's once."""
    pairs = sent_if_few(pairs)
    first = texts.selectExpr("rid AS a", "text AS ta").join(pairs, "a")
    second = texts.selectExpr("rid AS b", "text AS tb").join(sent_if_few(pairs.select("b").distinct()), "b", "left_semi")
    full = first.join(second, "b").select("a", "b", "ta", "tb")
    return cut(full.mapInPandas(_verified, "a long, b long"))


def _inner(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of one with each of the other sets, over slices of the values that occur."""
    every, at = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    owner = np.repeat(np.arange(len(one) + len(other)), [len(x) for x in (*one, *other)])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((len(one), len(other)), dtype=np.float32)
    for lo in range(0, len(every), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        held = np.zeros((len(one) + len(other), width), dtype=np.float32)
        held[owner[a:b], at[a:b] - lo] = 1
        total += held[:len(one)] @ held[len(one):].T
    return total


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of two roots at LEAST or more, between the two sides of a block pair or inside one block."""
    sets = [shingles(t) for t in pdf["text"]]
    side, rid, root, n = pdf["main"].to_numpy(), pdf["rid"].to_numpy(), pdf["root"].to_numpy(), np.array([len(x) for x in sets], dtype=np.float32)
    one, other = (np.flatnonzero(~side), np.flatnonzero(side)) if pdf["i"].iloc[0] >= 0 else (np.arange(len(pdf)),) * 2
    if not len(one) or not len(other):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    both = _inner([sets[k] for k in one], [sets[k] for k in other])
    x, y = np.nonzero((both >= LEAST * (n[one][:, None] + n[other][None] - both)) & (root[one][:, None] != root[other][None]))
    a, b = rid[one[x]], rid[other[y]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def blocks(m: DataFrame, texts: DataFrame) -> DataFrame:
    """m: rows of large buckets with their root, all (rows of the bucket) and most (rows and root of its largest component)
    -> the pairs of two roots at LEAST or more. The rows outside the largest component are compared with it and with each
    other, BLOCK by BLOCK rows at a time, so that a task holds two blocks and a text is sent once for each block."""
    ways = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    rows = m.withColumn("main", F.col("root") == F.col("most.root")).withColumn("ways", ways(F.col("most.c"))).withColumn("out", ways(F.col("all") - F.col("most.c")))
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("main"), F.col("ways")).otherwise(F.col("out"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    keys = F.when(F.col("main"), F.transform(upto(F.col("out")), lambda j: key(F.col("own"), j))).otherwise(F.concat(
        F.transform(upto(F.col("ways")), lambda i: key(i, F.col("own"))), F.transform(upto(F.col("out")), lambda k: key(-1 - F.least("own", k), F.greatest("own", k)))))
    dealt = rows.withColumn("own", own).select("band", "h", "rid", "root", "main", F.explode(keys).alias("at")).select("band", "h", "at.*", "rid", "root", "main")
    return dealt.join(texts, "rid").groupBy("band", "h", "i", "j").applyInPandas(_block, "a long, b long").distinct()


def alike(sets: DataFrame) -> DataFrame:
    """sets (rid, n, fp) -> pairs (a, b) of each set and the first one of its SimHash class, which links fingerprints over
    all distances of two bits or fewer. Sizes that rule LEAST out are left out."""
    at = sets.join(classes(sets.selectExpr("rid AS doc_id", "fp")), "fp").where("rid <> component_id").select("component_id", "rid", "n")
    first = sets.selectExpr("rid AS component_id", "n AS m")
    return at.join(first, "component_id").where(f"least(n, m) >= {LEAST} * greatest(n, m)").selectExpr("component_id AS a", "rid AS b")   # the first is the smallest


def links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """sets (rid, n, bands, sk, fp), one row for each distinct shingle set, rows (rid, text) -> (node, root). First each text
    is compared with the first one of its SimHash class, and each bucket's texts with that one of them which shares most
    buckets; then all pairs of a bucket that lie in two components, in small buckets one by one, in large ones by blocks.
    Sizes and, in buckets, sketches that rule LEAST out are never compared."""
    near_fp = cut(alike(sets.select("rid", "n", "fp")))
    every = sets.select("rid", F.posexplode("bands").alias("band", "h"))
    shared = every.groupBy("band", "h").agg(F.count("*").alias("c")).where("c > 1")
    held = every.join(shared, ["band", "h"]).groupBy("rid").agg(F.collect_list(F.struct("band", "h")).alias("at"), F.sum("c").alias("weight"))   # BANDS entries at most
    b = written(held.join(sets.select("rid", "n", "sk"), "rid").select("rid", "n", "sk", "weight", F.explode("at").alias("x")).select("rid", "n", "sk", "weight", "x.band", "x.h"))
    size = b.count()
    used = b.select("rid").union(near_fp.selectExpr("a AS rid")).union(near_fp.selectExpr("b AS rid")).distinct()
    texts = written(rows.join(sent_if_few(used), "rid", "left_semi"))
    differ = " + ".join(f"bit_count(((p.sk[{k}] ^ q.sk[{k}]) | shiftrightunsigned(p.sk[{k}] ^ q.sk[{k}], 1)) & {_EVEN}L)" for k in range(-(-BANDS * ROWS // 32)))
    near = F.expr(f"least(p.n, q.n) >= {LEAST} * greatest(p.n, q.n) AND {differ} <= {SKETCH}")

    def proposed(one: DataFrame, all_: DataFrame, other: str) -> DataFrame:
        both = one.alias("p").join(all_.alias("q"), ["band", "h"]).where(near & F.expr(other))
        return both.selectExpr("least(p.rid, q.rid) AS a", "greatest(p.rid, q.rid) AS b")
    centre = b.groupBy("band", "h").agg(F.min_by(F.struct("rid", "n", "sk"), F.struct(-F.col("weight"), "rid")).alias("x")).select("band", "h", "x.*")
    first = verify(cut(proposed(centre, b, "p.rid <> q.rid").union(near_fp).distinct()), texts)
    m = b.join(components(first), F.col("rid") == F.col("node"), "left").select("band", "h", "rid", "n", "sk", F.coalesce("root", "rid").alias("root"))
    per = m.groupBy("band", "h", "root").agg(F.count("*").alias("c"))
    open_ = per.groupBy("band", "h").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("k")).where("k > 1")
    m = written(few(m.join(open_.select("band", "h", "all", "most"), ["band", "h"]), size))
    small = m.where(F.col("all") <= BLOCK // 4)
    second = verify(cut(proposed(small, small, "p.rid < q.rid AND p.root <> q.root").distinct()), texts)
    return components(first.union(second).union(blocks(m.where(F.col("all") > BLOCK // 4), texts)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns."""
    rows = docs.withColumn("rid", F.monotonically_increasing_id())
    if not is_scan(docs):   # else the ids are the same whenever they are read
        rows = written(rows)
    ids = F.col("doc_id").cast("string").alias("id")  # text keeps null ids apart from the numbers
    sig = written(rows.select("rid", ids, "text").mapInPandas(_signed, "rid long, id string, words binary, n long, bands array<long>, sk array<long>, fp long"))
    order = F.struct(F.col("id").isNull(), F.col("id").cast("long"), "rid")
    sets = written(sig.groupBy("words").agg(F.min("rid").alias("rid"), F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sk").alias("sk"), F.first("fp").alias("fp")))
    comp = links(sets.select("rid", "n", "bands", "sk", "fp"), rows.select("rid", "text"))
    kept = sets.join(comp, sets.rid == comp.node, "left").groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    copies = sent_if_few(sig.select("rid").join(kept, "rid", "left_anti"))
    return rows.join(copies, "rid", "left_anti").select(*docs.columns)
