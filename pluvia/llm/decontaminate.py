"""Benchmark passages in documents by spaced seeds.

A seed is the hash of the words that a fixed mask leaves in a stretch; equal seeds of a document and an item propose an
alignment, along which every run of enough equal words is an overlap. Items of LEAST_ITEM to 7 words are shorter than
the masks and are found as a whole; shorter ones are too common in clean texts to be evidence and match nothing, unless
a call asks for them.

Null and empty texts match nothing; repeated rows each give their rows; rows with a null doc_id are searched and give
rows with a null doc_id, of which `clean` keeps those without an overlap; texts may be of any length; empty tables give
an empty result; extra columns are not read, and `clean` keeps them. The benchmark's arrays are broadcast up to
INDEX_BYTES; a larger benchmark is joined by seed instead, with the same result."""
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_scan, sent_if_few, written

MASKS = ("11011011", "1110010111", "110100110011")  # 0: the word at that place is ignored
INDEX_BYTES = 64 << 20
MIN_WORDS, IDENTITY = 10, 0.8
MISS = round(IDENTITY / (1 - IDENTITY))   # equal words that make up for another one
LEAST_ITEM = 5   # words of an item that can be found
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    w = (text or "").encode("utf-8").translate(_TABLE).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    g = np.full(max(n, 0), salt, dtype=np.uint64)
    if n > 0:
        for k, c in enumerate(mask):
            if c == "1":
                g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:k + n]
    return g


def masks(words: int, least_item: int) -> list[tuple[int, str]]:
    """Number and mask of the seeds of an item of so many words."""
    if words < max(least_item, 1):
        return []
    return [*enumerate(MASKS)] if words >= len(MASKS[0]) else [(words + 100, "1" * words)]


def all_masks(least_item: int) -> list[tuple[int, str]]:
    return [*enumerate(MASKS), *((k + 100, "1" * k) for k in range(max(least_item, 1), len(MASKS[0])))]


def _longest(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch (from, to) with at least IDENTITY of its words equal, the first of several. With prefix sums of
    +1 for an equal word and -4 for another one, a stretch holds enough where its sum isn't negative; the earliest place
    whose sum is no larger than that at the end is found in the running minimum, which never rises."""
    c = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISS))))
    low = np.minimum.accumulate(c)
    start = np.searchsorted(-low, -c)
    end = int((np.arange(len(c)) - start).argmax())
    return int(start[end]), end


def verify(h: np.ndarray, w: np.ndarray, off: int) -> list[tuple]:
    """Runs of the overlap when item words w start at word `off` of h: (first, last, equal words) of the longest run with
    enough equal words, without other words at its ends, and of those on either side of it."""
    a, z = max(off, 0), min(off + len(w), len(h))
    equal = h[a:z] == w[a - off:z - off]
    least, out, work = min(MIN_WORDS, len(w)), [], [(0, len(equal))]
    while work:
        lo, hi = work.pop()
        if hi - lo < least:
            continue
        start, end = _longest(equal[lo:hi])
        at = np.flatnonzero(equal[lo + start:lo + end])
        if len(at) >= least:
            out.append((a + lo + start + int(at[0]), a + lo + start + int(at[-1]), len(at)))
            work += [(lo, lo + start), (lo + end, hi)]
    return sorted(out)


OVERLAP = "doc string, item string, first_word long, last_word long, n_matched long"   # ids as text, so that large ones beside nulls stay whole
_COLUMNS = ["doc", "item", "first_word", "last_word", "n_matched"]


def overlaps(docs: DataFrame, bench: DataFrame, index_bytes: int = INDEX_BYTES, least_item: int = LEAST_ITEM) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_matched for each verified overlap. Items of `least_item` words or more are
    looked for; with 1 that is every item that has a word."""
    stable = is_scan(docs)
    docs, bench = docs.selectExpr("string(doc_id) AS doc", "text"), bench.selectExpr("string(item_id) AS item", "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    got = _broadcast(docs, bench, least_item) if size * 8 <= index_bytes else _joined(docs, bench, least_item, stable)
    return got.select(F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"), "first_word", "last_word", "n_matched")


def _joined(docs: DataFrame, bench: DataFrame, least_item: int, stable: bool) -> DataFrame:
    """Seeds of both sides joined by key (a hot key's document side is split by AQE), each distinct offset verified once. Rows
    are numbered for it; where another reading might number them otherwise, they are written first."""
    def spread(item: bool):
        def run(it):
            for pdf in it:
                out = []
                for k, t in zip(pdf["id"], pdf["text"]):
                    h = word_hashes(t)
                    for s, m in masks(len(h), least_item) if item else all_masks(least_item):
                        g = seeds(h, m, s).view(np.int64)
                        out.append(pd.DataFrame({"id": k, "key": g, "at": np.arange(len(g))}))
                if out:
                    yield pd.concat(out)
        return run

    def check(it):
        for pdf in it:
            rows = []
            for d, i, t, u, offs in zip(pdf["doc"], pdf["item"], pdf["text"], pdf["words"], pdf["offs"]):
                h, w = word_hashes(t), word_hashes(u)
                rows += [(d, i, *v) for o in offs for v in verify(h, w, int(o))]
            yield pd.DataFrame(rows, columns=_COLUMNS)
    rows, items = docs.withColumn("rid", F.monotonically_increasing_id()), written(bench.withColumn("bid", F.monotonically_increasing_id()))
    if not stable:
        rows = written(rows)
    a = rows.selectExpr("rid AS id", "text").mapInPandas(spread(False), "id long, key long, at long").selectExpr("id AS rid", "key", "at AS p")
    b = items.selectExpr("bid AS id", "text").mapInPandas(spread(True), "id long, key long, at long").selectExpr("id AS bid", "key", "at AS q")
    hits = a.join(b, "key").selectExpr("rid", "bid", "p - q AS off").distinct().groupBy("rid", "bid").agg(F.collect_list("off").alias("offs"))
    full = hits.join(rows, "rid").join(items.select("bid", "item", F.col("text").alias("words")), "bid")
    return full.select("doc", "item", "text", "words", "offs").mapInPandas(check, OVERLAP)


def _broadcast(docs: DataFrame, bench: DataFrame, least_item: int) -> DataFrame:
    items = [(r["item"], word_hashes(r["text"])) for r in bench.collect()]   # INDEX_BYTES at most
    sc = docs.sparkSession.sparkContext
    used, keys, owner = [], [], []
    for s, m in all_masks(least_item):
        of = [(i, h) for i, (_, h) in enumerate(items) if (s, m) in masks(len(h), least_item)]
        if of:
            g = [seeds(h, m, s) for _, h in of]
            k = np.concatenate(g)
            o = np.argsort(k, kind="stable")
            at = np.column_stack([np.repeat([i for i, _ in of], [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])])
            used.append((s, m))
            keys.append(k[o])
            owner.append(at[o].astype(np.int64))
    b = sc.broadcast((items, used, keys, owner))

    def run(it):
        items, used, keys, owner = b.value
        filt = np.zeros(1 << 22, dtype=bool)
        for k in keys:
            filt[(k & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for pdf in it:
            rows = []
            for d, t in zip(pdf["doc"], pdf["text"]):
                h = word_hashes(t)
                cand = set()
                for (s, m), key, own in zip(used, keys, owner):
                    g = seeds(h, m, s)
                    at = np.flatnonzero(filt[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    lo, hi = np.searchsorted(key, g[at], "left"), np.searchsorted(key, g[at], "right")
                    for p, a, z in zip(at.tolist(), lo.tolist(), hi.tolist()):
                        cand.update((int(own[q, 0]), p - int(own[q, 1])) for q in range(a, z))
                for i, off in sorted(cand):
                    rows += [(d, items[i][0], *v) for v in verify(h, items[i][1], off)]
            yield pd.DataFrame(rows, columns=_COLUMNS)
    return docs.mapInPandas(run, OVERLAP)


def pairs(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return overlaps(docs, bench).groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("n_matched").alias("n_matched"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs without an overlap, with their columns. Rows that share a doc_id share its verdict."""
    found = sent_if_few(overlaps(docs, bench).select(F.col("doc_id").alias("_found")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_found")), "left_anti").select(*docs.columns)
