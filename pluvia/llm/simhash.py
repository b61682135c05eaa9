"""SimHash near-duplicate groups by multi-index hashing.

Null and empty texts have fingerprint 0 and link like any other; repeated rows keep their own result; a null doc_id is
no candidate for a component's smallest one, and a component of null ids alone has none; texts may be of any length; an
empty table gives an empty result; extra columns are not read."""
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, map_texts

HALF = 0xFFFFFFFF
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, n: int = 3, block: int = 65536) -> int:
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    n = min(n, len(words))
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - n + 1].tolist()
    ends = ends[n - 1:].tolist()
    h64 = xxhash.xxh64_intdigest
    return majority(np.fromiter((h64(whole[s:e], 42) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts)), block)


def majority(h: np.ndarray, block: int = 65536) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), block):
        ones += np.unpackbits(h[k:k + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""
    return map_texts(docs.select("doc_id", "text"), lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)], "fp long")


def links(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (a, b) at two or fewer differing bits. Two or fewer differences leave one 32-bit half with at
    most one: a table row per half, probes for the half itself and for each of its zero bits set."""
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.expr(f"fp & {HALF}L").alias("key")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("key")))).alias("k")).select("fp", "k.*")
    flips = F.expr("filter(transform(sequence(0, 31), i -> key | shiftleft(1L, i)), v -> v <> key)")
    probes = halves.select(F.col("fp").alias("a"), "half", F.explode(F.concat(F.array("key"), flips)).alias("key"))
    pairs = probes.join(halves.withColumnRenamed("fp", "b"), ["half", "key"]).where("a <> b AND bit_count(a ^ b) <= 2")
    return pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def classes(fp: DataFrame) -> DataFrame:
    """Rows (doc_id, fp) -> each fp with component_id, the smallest doc_id that is reachable from it."""
    firsts = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(firsts.select("fp")))
    g = firsts.join(comp, firsts.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = g.groupBy("root").agg(F.min("first").alias("component_id"))
    return g.join(roots, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest reachable doc_id)."""
    fp = cut(fingerprints(docs))
    return fp.join(classes(fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
