"""Scores, losses, error samples, metrics by name and moments on small rows with known values."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia import catalog
from pluvia.functions import losses, moments
from pluvia.functions import scores as S
from pluvia.operators import verify
from pluvia.registry import METRICS, PYTHON_METRICS
from pluvia.sources import sinks
from pluvia.streaming import scores as stream

NAN, INF = float("nan"), float("inf")
PAIR = "batch_id long, sample_id string, pred double, label double"


def pairs(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], PAIR)


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9, abs=1e-12))


def test_cc_of_small_units_and_flat_samples(spark):
    """Values of 1e-11 correlate as those of 1 do; equal values don't, however large."""
    rows = [(f"s{k}", u * x, u * y) for k, u in enumerate((1.0, 1e-11, 1e-30, 1e9)) for x, y in ((1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (7.0, 14.0))]
    rows += [("flat", 0.1, float(k)) for k in range(7)] + [("large", 1e15 + 0.3, float(k)) for k in range(7)]
    got = {r.sample_id: (r.CC, r.KGE) for r in verify.sample_scores(pairs(spark, rows)).collect()}
    assert all(got[f"s{k}"][0] == pytest.approx(0.75) for k in range(4))   # (n - 1) / n of 1
    assert got["flat"][0] == got["large"][0] == 0.0
    assert got["s1"][1] == pytest.approx(1 - math.sqrt(0.25 ** 2))   # deviations and means under 1e-8 count as equal


def test_float_columns_meet_float_edges(spark):
    d = spark.createDataFrame([(x,) for x in (0.1, 5.0, 15.0, 0.2, 10.0, 25.0, 0.0, NAN)], "y double")
    wanted = ["none", "light", "moderate", "light", "moderate", "heavy", "none", "none"]
    for kind in ("double", "float"):
        y = F.col("y").cast(kind)
        got = d.select(S.loss_class(y).alias("c"), S.event(y, 0.1).alias("e"), S.squared_weight(y).alias("w"), S.absolute_weight(y).alias("a")).collect()
        assert [r.c for r in got] == wanted
        assert [r.e for r in got] == [True] * 6 + [False] * 2
        assert [r.w for r in got][:3] == [1.0, 4.0, 3.0] and [r.a for r in got][:3] == [1.0, 6.0, 4.0] and got[5].w == 2.0 and got[5].a == 3.0
    loss = lambda kind: verify.weighted_loss(d.select(F.lit("s").alias("sample_id"), F.lit(0.0).cast(kind).alias("pred"), F.col("y").cast(kind).alias("label")).where("label = label AND NOT isnan(label)"), "sample_id").first().loss
    assert loss("float") == pytest.approx(loss("double"), rel=1e-6)


def test_binary_cross_entropy_is_not_clamped(spark):
    cases = [(0.5, 1, math.log(2)), (0.0, 1, INF), (0.0, 0, NAN), (1.0, 0, INF), (1.0, 1, NAN), (-0.1, 1, NAN), (1.5, 0, NAN), (0.25, 0, -math.log(0.75))]
    got = spark.createDataFrame([c[:2] for c in cases], "p double, y int").select(losses.binary(F.col("p"), F.col("y")).alias("l")).collect()
    assert all(same(r.l, w) for r, (*_, w) in zip(got, cases)), got
    rows = spark.createDataFrame([([0.5, 0.25], [1, 0]), ([0.5, 0.5], [0, 1])], "p array<double>, y array<int>")
    assert losses.multi_label(rows).first().loss == pytest.approx((3 * math.log(2) - math.log(0.75)) / 2)
    assert losses.multi_label(rows.union(spark.createDataFrame([([0.0, 0.5], [1, 1])], rows.schema))).first().loss == INF


def test_error_samples(spark, tmp_path):
    d = pairs(spark, [("b", NAN, 1.0), ("b", NAN, 2.0), ("c", INF, 1.0), ("c", 3.0, 4.0), ("d", 1.0, 1.0), ("d", 2.0, 1.5), ("e", NAN, 7.0), ("f", 1.0, NAN), ("f", 2.0, 3.0), ("g", -INF, 1.0), ("g", NAN, 1.0)])
    got = {(r.sample_id, r.error): tuple(r)[2:] for r in verify.error_samples(d).collect()}
    no = (False, False)
    assert got == {
        ("b", "nan_inf_values"): (True, False, None, None, *no, 1.0, 2.0), ("c", "nan_inf_values"): (False, True, 3.0, INF, *no, 1.0, 4.0),
        ("e", "nan_inf_values"): (True, False, None, None, *no, 7.0, 7.0), ("e", "nan_std"): (*no, 0.0, 0.0, *no, 7.0, 7.0),
        ("f", "nan_std"): (*no, 1.0, 2.0, True, False, 3.0, 3.0), ("g", "nan_inf_values"): (True, True, -INF, -INF, *no, 1.0, 1.0)}
    errors = verify.error_samples(d)
    for _ in range(2):
        sinks.write_errors(errors, verify.error_values(d, errors), str(tmp_path))
    saved = spark.read.parquet(str(tmp_path / "values"))
    assert saved.count() == 2 * 10 and saved.where("error = 'nan_std' AND sample_id = 'e'").first().pred == 0.0
    assert spark.read.parquet(str(tmp_path / "summary")).count() == 2 * len(got)


def test_metrics_by_name(spark):
    rng = np.random.default_rng(5)
    rows = [(b, f"{b}-{k % 3}", float(p), float(y)) for b in range(3) for k, (p, y) in enumerate(rng.gamma(1, 9, (20 + 7 * b, 2)))]
    d = spark.createDataFrame(rows, PAIR)
    catalog.python_metric("WORST", lambda p, y: np.abs(p - y).max())
    try:
        got = {r.metric: r.value for r in catalog.metric_report(d, catalog.SIXTEEN | {"worst": ("WORST", None), "est": ("EST", 10.0), "median": ("MEDAE", None)}).collect()}
    finally:
        METRICS.pop("WORST")
        PYTHON_METRICS.discard("WORST")
    report = {r.metric: r.value for r in verify.verification_report(d).collect()}
    assert {k: v for k, v in got.items() if k in report} == report and len(report) == 16 and got["est"] == report["TS_moderate_rain"]
    mean = lambda f: np.mean([np.mean([f([(p, y) for _, s, p, y in rows if s == f"{b}-{k}"]) for k in range(3)]) for b in range(3)])
    assert got["worst"] == pytest.approx(mean(lambda c: max(abs(p - y) for p, y in c)), abs=6e-4)
    assert got["median"] == pytest.approx(mean(lambda c: np.median([abs(p - y) for p, y in c])), abs=6e-4)
    assert {r.value for r in catalog.metric_report(d.where("false")).collect()} == {0.0}
    with pytest.raises(ValueError):
        catalog.metric_report(d, {"x": ("no such metric", None)})


CASES = ([("a", float(k * k % 11), float(k % 7)) for k in range(30)] + [("one", 3.0, 4.0)] + [("nan", NAN, 1.0), ("nan", 2.0, 3.0), ("nan", 5.0, 4.0)] + [("inf", INF, 1.0), ("inf", 2.0, 3.0), ("inf", 1.0, 30.0)]
         + [("flat", 1e-11, float(k)) for k in range(5)] + [("offset", 1e8 + k % 3, 1e8 + k % 5) for k in range(20)])


def scored(df):
    return {r.sample_id: tuple(r[m] for m in S.METRICS) for r in df.collect()}


def test_moments_merge_to_the_whole(spark):
    d = pairs(spark, CASES).drop("batch_id")
    whole = scored(verify.sample_scores(pairs(spark, CASES)))
    direct = scored(moments.scores(moments.moments(d, "sample_id"), "sample_id"))
    assert direct.keys() == whole.keys() and all(same(x, y) for k in whole for x, y in zip(direct[k], whole[k])), (direct, whole)


def test_batches_of_scores(spark, tmp_path):
    """Any parts give the scores of the whole; a batch taken again changes nothing; only touched samples get rows."""
    out, d = str(tmp_path / "t"), pairs(spark, [(s, p, y) for k, (s, p, y) in enumerate(CASES)]).drop("batch_id")
    number = F.pmod(F.xxhash64("sample_id", "pred", "label"), F.lit(3))
    parts = [d.where(number == k) for k in range(3)] + [spark.createDataFrame([("new", 1.0, 1.0), ("new", 2.0, None)], d.schema)]
    for k, part in enumerate(parts):
        stream.take_batch(part, k, out)
        if k == 1:
            before = scored(stream.read(spark, out))
            stream.take_batch(part, k, out)
            again = scored(stream.read(spark, out))
            assert again.keys() == before.keys() and all(same(x, y) for k in again for x, y in zip(again[k], before[k]))
    got, whole = scored(stream.read(spark, out)), scored(verify.sample_scores(pairs(spark, CASES + [("new", 1.0, 1.0)])))
    assert got.keys() == whole.keys()
    assert all(same(x, y) or k == "offset" and x == pytest.approx(y, rel=1e-6) for k in whole for x, y in zip(got[k], whole[k]))
    rows = {r.batch: r.n for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert rows[3] == 1 and rows[1] == parts[1].select("sample_id").distinct().count()


def test_chosen_values_of_confusion_counts(spark):
    d = spark.createDataFrame([("a", 3, 1, 2), ("b", 0, 0, 0), ("c", 1, 3, 0)], "class string, tp long, fp long, fn long")
    r = losses.prf(d).first()
    assert (r.micro_p, r.micro_r, r.micro_f1) == pytest.approx((4 / 8, 4 / 6, 8 / 14))
    assert (r.macro_p, r.macro_r, r.macro_f1) == pytest.approx(((3 / 4 + 1 / 4) / 2, (3 / 5 + 1) / 2, (6 / 9 + 2 / 5) / 2))
    assert losses.prf(d, ("macro_r", "micro_p")).columns == ["macro_r", "micro_p"] and losses.prf(d.where("false")).first().micro_p is None
    with pytest.raises(ValueError):
        losses.prf(d, ("median",))
