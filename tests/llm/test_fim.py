"""Fill-in-the-middle against plain Python, and exact round trips."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pluvia.llm import fim

D = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    """The text's tokens one by one."""
    t = text or ""
    tokens = TOKEN.findall(t)
    assert "".join(tokens) == t
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if t == "" or re.search("<[PSM]>", t) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, form, len(pre), len(mid), sha(out), sha(t)


CASES = [(None, "a b"), (2**60 + 1, " lead and trail \n"), (3, ""), (4, None), (5, "x<S>y z"), (6, "x<P"), (7, "S>x <S <P <M a<"), (8, "\x85 é\u3000ü\x1f b"), (9, "one two " * 200_000), (10, "w" * 1_000_000), (11, "   \t\n"), (12, "a b c"), (12, "a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame(CASES + [(k, f"<P <S> {k}" if k % 9 == 0 else f"> <a{k} <S b <M") for k in range(100, 300)], "doc_id long, text string")
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(own).withColumn("output", F.lit(1)).withColumn("n", F.lit("n")).repartition(3).cache()


def test_equals_brute_force(docs):
    got = sorted((tuple(r) for r in fim.report(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rates_columns_and_empty_tables(docs):
    every = fim.transform(docs, seed=7, rate=100, spm=0)
    assert every.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and every.where("form = 'spm'").count() == 0
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.t) for r in every.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()), key=repr) == texts
    assert fim.transform(docs, rate=0).where("form <> 'plain'").count() == 0
    assert fim.report(docs.where("false")).count() == 0


def test_one_match_keeps_every_end():
    for t in ("", " ", "a", " a", "a ", "a  b\n", "é\u2028x"):
        assert fim.UNITS.fullmatch(t).ends(1) == [m.end() for m in TOKEN.finditer(t)]
