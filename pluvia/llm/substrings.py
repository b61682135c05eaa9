"""Removal of 100-byte strings that also start earlier, over sampled suffixes.

Runs of 100-byte windows with one smallest 32-byte gram and one side of it are the sampled suffixes: equal windows have
equal keys. Equal runs are settled by two 64-bit fingerprints; only runs that share a key but differ are compared window
by window.

Null texts are empty; rows are taken in the order of doc_id, null ids last, those of one doc_id in the order of the table's
parts; repeated rows so keep the bytes of the first one; texts may be of any length; an empty table gives an empty result;
extra columns are not read."""
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

WINDOW, GRAM = 100, 32
SIDE = (WINDOW - GRAM) // 2   # a window holds at least so many bytes on one side of its gram
_M = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_G = np.uint64(0x9E3779B97F4A7C15)


def grams(b: np.ndarray) -> np.ndarray:
    x = (b.astype(np.uint64) + np.uint64(1)) * _G
    n = 1
    for m in _M:
        y = x[:-n] * m
        y ^= y >> np.uint64(29)
        y += x[n:]
        x = y * _G
        x ^= x >> np.uint64(32)
        n *= 2
    return x


def _mix(x: np.ndarray, at: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    s = x[at] * np.uint64(3) + (end - at).astype(np.uint64) + np.uint64(salt)
    for k in (32, 64, 96, 128, 160):
        s = (s ^ (s >> np.uint64(31))) * _M[0] + x[np.minimum(at + k, end - GRAM)]
    return s


def runs(text: str | None):
    """Key, run fingerprint, first window, end window (exclusive) of each run: windows whose first smallest gram stands at
    one place and that hold the SIDE bytes before it (else they hold those after it). The key hashes the gram with that side,
    so equal windows have equal keys and places in it, and no run holds a window twice."""
    b = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    nw = len(b) - WINDOW + 1
    if nw < 1:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    x = grams(b)
    m, at, n = x, np.arange(len(x)), 1
    for _ in range(6):
        less = m[n:] < m[:-n]
        m, at = np.where(less, m[n:], m[:-n]), np.where(less, at[n:], at[:-n])
        n *= 2
    k = WINDOW - GRAM + 1 - 64
    at = np.where(m[k:][:nw] < m[:nw], at[k:][:nw], at[:nw])
    left = at - np.arange(nw) >= SIDE
    lo = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (left[1:] != left[:-1])) + 1))
    hi = np.concatenate((lo[1:], [nw]))
    at, left = at[lo], left[lo]
    key = x[at] * np.uint64(3) + left
    for far in (SIDE - GRAM, SIDE):
        key = (key ^ (key >> np.uint64(31))) * _M[1] + x[np.where(left, at - far, at + far)]
    return key.view(np.int64), _mix(x, lo, hi + WINDOW - 1, 0).view(np.int64), lo, hi


RUN = "k long, s long, key long, lo int, hi int"
SPAN = "key long, lo int, hi int, rep boolean"


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks rows whose keys differ from the row before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _runs(it):
    """Sampled suffixes. Within a batch all but the first of equal runs are settled here as spans: hi is negative and k only spreads them."""
    for pdf in it:
        got = [runs(t) for t in pdf["text"]]
        d = np.repeat(pdf["key"].to_numpy(), [len(g[0]) for g in got])
        k, s, lo, hi = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(4))
        o = np.lexsort((lo, d, s, k))
        new = np.zeros(len(k), dtype=bool)
        new[o] = _firsts(k[o], s[o])
        o = np.flatnonzero(~new)
        o = o[np.lexsort((lo[o], d[o]))]
        start = np.ones(len(o), dtype=bool)
        start[1:] = (d[o][1:] != d[o][:-1]) | (lo[o][1:] > hi[o][:-1])
        one, end = o[start], o[np.append(start[1:], True)[:len(o)]]
        cols = {"k": (k[new], d[one]), "s": (s[new], 0 * one), "key": (d[new], d[one]), "lo": (lo[new], lo[one]), "hi": (hi[new], -hi[end] - WINDOW + 1)}
        yield pd.DataFrame({c: np.concatenate(v).astype(np.int32 if c in ("lo", "hi") else np.int64) for c, v in cols.items()})


def _scan(it):
    """One pass over suffixes sorted by k, s, key, lo: later equal runs are spans, and the first runs of each class are
    representatives where a key has several classes. Only a key's first run waits between batches."""
    last, wait = None, None   # (k, s) of the row before; the first run of its key while that has one class
    for pdf in it:
        done = pdf[pdf["hi"] < 0]
        out = [done.assign(rep=False, hi=-done["hi"])] if len(done) else []
        pdf = pdf[pdf["hi"] >= 0].reset_index(drop=True)
        if len(pdf):
            k, s = pdf["k"].to_numpy(), pdf["s"].to_numpy()
            first, cls = _firsts(k), _firsts(k, s)
            on = last is not None and last[0] == k[0]
            cls[0] = not on or last[1] != s[0]
            group = np.cumsum(first) - 1
            extra = cls & ~first
            extra[0] = on and cls[0]
            mixed = np.bincount(group, extra) > 0
            if on and mixed[0] and wait is not None:
                out.append(wait)
                wait = None
            rep = cls & mixed[group]
            same = pdf[~cls]
            out += [same.assign(rep=False, hi=same["hi"] + WINDOW - 1), pdf[rep].assign(rep=True)]
            if not (on and first.sum() == 1):
                wait = None if mixed[-1] else pdf.iloc[[np.flatnonzero(first)[-1]]].assign(rep=True)
            last = (k[-1], s[-1])
        if out:
            yield pd.concat(out)[["key", "lo", "hi", "rep"]]


def _later(it):
    """Windows sorted by w, w2, key, at: all but the first of equal ones, as spans."""
    last = None
    for pdf in it:
        w, w2 = pdf["w"].to_numpy(), pdf["w2"].to_numpy()
        new = _firsts(w, w2)
        if len(new):
            new[0] = last != (w[0], w2[0])
            last = (w[-1], w2[-1])
        got = pdf[~new]
        yield pd.DataFrame({"key": got["key"], "lo": got["at"], "hi": got["at"] + WINDOW})


def _windows(it, rows=200_000):
    for pdf in it:
        out, held = [], 0
        for d, t, rs in zip(pdf["key"], pdf["text"], pdf["rs"]):
            x = grams(np.frombuffer((t or "").encode("utf-8"), dtype=np.uint8))
            at = np.concatenate([np.arange(r["lo"], r["hi"]) for r in rs])
            out.append(pd.DataFrame({"key": d, "w": _mix(x, at, at + WINDOW, 1).view(np.int64), "w2": _mix(x, at, at + WINDOW, 77).view(np.int64), "at": at.astype(np.int32)}))
            held += len(at)
            if held >= rows:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)


def _cut(texts, spans):
    rows = []
    for t, own in zip(texts, spans):
        b = np.frombuffer((t or "").encode("utf-8"), dtype=np.uint8)
        mark = np.zeros(len(b) + 1, dtype=np.int64)
        if own is not None:
            np.add.at(mark, np.array([s["lo"] for s in own], dtype=np.int64), 1)
            np.add.at(mark, np.array([s["hi"] for s in own], dtype=np.int64), -1)
        gone = np.cumsum(mark)[:-1] > 0
        n = int(gone.sum())
        rows.append((len(b), n, int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if n else 0, hashlib.sha256(b[~gone].tobytes() if n else b.tobytes()).hexdigest()))
    return list(zip(*rows)) if rows else [[]] * 4


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a number of each row in the order of doc_id: doc_id itself, if no row shares or lacks it."""
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    rows = docs.withColumn("rid", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "rid")
    return written(rows.select("doc_id", "text", F.monotonically_increasing_id().alias("key")))


def removals(docs: DataFrame) -> DataFrame:
    """key, lo, hi: bytes to remove; docs (key, text). The suffix table is hashed by gram, sorted and scanned once; windows
    likewise."""
    docs = docs.select("key", "text")
    table = docs.mapInPandas(_runs, RUN).repartition("k").sortWithinPartitions("k", "s", "key", "lo")
    found = written(table.mapInPandas(_scan, SPAN))
    per = found.where("rep").groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("rs"))
    win = docs.join(per, "key").mapInPandas(_windows, "key long, w long, w2 long, at int")
    later = win.repartition("w").sortWithinPartitions("w", "w2", "key", "at").mapInPandas(_later, "key long, lo int, hi int")
    return found.where("NOT rep").select("key", "lo", "hi").union(later)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs)
    per = removals(rows).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    both = rows.join(per, "key", "left").select("doc_id", F.struct("text", "spans").alias("text"))
    return map_texts(both, lambda vs: _cut([v["text"] for v in vs], [v["spans"] for v in vs]), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
