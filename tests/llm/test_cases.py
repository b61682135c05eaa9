"""Rows that any table may hold: nulls, repeated rows, large ids beside nulls, empty tables, clashing columns."""
import pytest

from pluvia.llm import decontaminate, license, lm, minhash, mixing, pii, quality, simhash, substrings, tokens, toxicity
import public_tokenizers

BIG = 2**60
A = "the quick brown fox jumps over the lazy dog and then runs far away from all of the others in the wood today " * 2
ROWS = [(BIG + 1, A), (BIG + 3, A.replace("fox", "cat")), (None, A), (5, None), (6, ""), (7, A), (7, A)]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1.0, "x") for i, t in ROWS], "doc_id long, text string, source string, p double, fp string").coalesce(1).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(BIG + 9, "quick brown fox jumps over the lazy dog and then runs far away"), (None, None), (2, "over the lazy dog and then runs"), (3, "the lazy")], "item_id long, text string")


def operators(labels, bench):
    return {
        "op1": simhash.near_duplicates, "op2": license.report, "op3": lambda d: toxicity.toxicity(d, labels), "op5": substrings.dedup,
        "op6": lambda d: quality.score(d, quality.fit(d, labels)), "op7": lambda d: mixing.rates(d, labels), "op8": lm.scores,
        "op9": pii.report, "op10": lambda d: tokens.token_counts(d, PATH),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_ids_stay_whole_and_empty_tables_give_none(docs, labels, bench, name):
    f = operators(labels, bench)[name]
    got = sorted((r.doc_id for r in f(docs).collect()), key=lambda x: (x is None, x))
    assert got == sorted((i for i, _ in ROWS), key=lambda x: (x is None, x))
    assert f(docs.where("false")).count() == 0


def test_repeated_rows_keep_the_first(spark):
    d = spark.createDataFrame([(1, A), (1, A), (None, A)], "doc_id long, text string")
    got = sorted(r.n_removed for r in substrings.dedup(d).collect())
    one = substrings.dedup(spark.createDataFrame([(1, A)], "doc_id long, text string")).first().n_removed
    assert got == [one, len(A), len(A)]


def test_decontamination_cases(docs, bench):
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(docs, bench).collect()}
    assert got == {(i, k) for i, t in ROWS if t for k in (BIG + 9, 2)}
    same = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, 0).collect()}
    assert same == got
    kept = [r.doc_id for r in decontaminate.clean(docs, bench).collect()]
    assert sorted(kept) == [5, 6]
    assert decontaminate.clean(docs, bench.where("false")).count() == len(ROWS)


def test_stages_keep_clashing_columns(docs, labels):
    kept = mixing.rates(docs, labels, texts=True)
    assert {"doc_id", "text", "source", "p", "fp", "rate"} <= set(kept.columns) and kept.count() == len(ROWS)
    assert quality.filter_kept(docs, quality.fit(docs, labels)).columns == docs.columns
    assert minhash.keep_one(docs).columns == docs.columns
    assert pii.redact(docs).columns == docs.columns


def test_without_labels(docs, labels):
    none = labels.where("false")
    assert toxicity.toxicity(docs, none).count() == mixing.rates(docs, none).count() == quality.score(docs, quality.fit(docs, none)).count() == len(ROWS)
