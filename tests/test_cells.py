"""Cleaning in parts, tables of limits and moments, resumed sinks, numbering, windows, orders and models."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions import text as X
from pluvia.operators import clean, correct, external, samples, verify
from pluvia.registry import MODELS
from pluvia.sources import files, scratch, sinks
from pluvia.streaming import preprocess

NAN, INF = float("nan"), float("inf")
CELLS = "id long, file string, variable string, value double"


def cells(spark, n=400, seed=1):
    rnd = random.Random(seed)
    odd = [9999.0, -9999.0, 999999.0, -999999.0, NAN, -5.0, 130.0]
    rows = [(k, f"f{rnd.randrange(4)}", rnd.choice(["TAIR", "UWIN", "PRE"]), rnd.choice(odd) if rnd.random() < 0.3 else rnd.uniform(0, 90)) for k in range(n)]
    return spark.createDataFrame(rows + [(n, "g", "UWIN", INF), (n + 1, "g", "UWIN", 9999.0), (n + 2, "h", "TAIR", NAN), (n + 3, "h", "TAIR", 9999.0)], CELLS)


STATS = [("TAIR", 40.0, 20.0), ("UWIN", 1.0, 3.0)]


def by_id(df):
    return {r.id: (r.file, r.variable, None if r.value is None else round(r.value, 9)) for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_parts_of_files_equal_the_whole(spark, tmp_path, seed):
    d, stats, out = cells(spark), spark.createDataFrame(STATS, "variable string, mean double, std double"), str(tmp_path)
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3))
    for k in range(3):
        preprocess.take_part(d.where(part == k), k, stats, out)
        if k == 1:   # taken again, as after a failure
            preprocess.take_part(d.where(part == k), k, stats, out)
    got = preprocess.read(spark, out, d.schema)
    assert got.columns == d.columns and got.count() == d.count()
    assert by_id(got) == by_id(clean.zscore(clean.clean(d), stats))


def test_stream_takes_files_once(spark, tmp_path):
    d, stats = cells(spark), spark.createDataFrame(STATS, "variable string, mean double, std double")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    d.where("id % 2 = 0").coalesce(1).write.parquet(src)
    preprocess.stream_preprocess(spark, src, stats, out, ck)
    d.where("id % 2 = 1").repartition(2).write.mode("append").parquet(src)
    got = preprocess.stream_preprocess(spark, src, stats, out, ck, files_at_once=1)
    assert by_id(got) == by_id(clean.zscore(clean.clean(d), stats))


def test_limits_as_a_table(spark):
    d = spark.createDataFrame([(k, "f", v, x) for k, (v, x) in enumerate([("TAIR", -1.0), ("TAIR", 1e9), ("UWIN", -100.0), ("UWIN", -100.1), ("PRE", 100.0), ("PRE", 100.1), ("other", 1e9), ("PRE", NAN), ("PRE", None), ("UWIN", INF)])], CELLS)
    out = [r.out for r in clean.range_flags(d, clean.limits_table(spark)).orderBy("id").collect()]
    assert out == [True, False, False, True, False, True, False, False, False, True]
    own = clean.limits_table(spark, {"other": (None, 5), "UWIN": (None, None)})
    assert [r.id for r in clean.range_flags(d, own).where("out").collect()] == [6]
    assert by_id(clean.range_zero(d, clean.limits_table(spark)).where("id <> 7")) == by_id(clean.range_zero(d).where("id <> 7"))


def test_statistics_from_moments_of_files(spark, tmp_path):
    d, out = clean.clean(cells(spark)), str(tmp_path / "m")
    for names in (["f0", "f1"], ["f2", "f3", "g", "h"], ["f1"]):   # the last is written again
        sinks.add_moments(clean.file_moments(d.where(F.col("file").isin(names))), out)
    for limit in (2, 5, None):
        got = {r.variable: (r.n, r.mean, r.std) for r in clean.stats_of(sinks.read_moments(spark, out), limit).collect()}
        want = {r.variable: (r.n, r.mean, r.std) for r in clean.global_stats(d, limit).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    first = d.where("file IN ('f0', 'f1') AND variable = 'UWIN'").toPandas().value
    stats = clean.stats_of(sinks.read_moments(spark, out), 2)
    uwin = stats.where("variable = 'UWIN'").first()
    assert (uwin.mean, uwin["std"]) == pytest.approx((first.mean(), max(first.std(ddof=0), 1e-3)))
    sinks.write_stats(stats, str(tmp_path / "s"))
    back = {r.variable: (r.mean, r["std"]) for r in sinks.read_stats(spark, str(tmp_path / "s")).collect()}
    assert back == {r.variable: (r.mean, r["std"]) for r in stats.collect()}


def test_sink_goes_on_where_it_broke_off(spark, tmp_path):
    d, out, calls = cells(spark), str(tmp_path / "out"), []

    def process(c):
        calls.append(sorted(r.file for r in c.select("file").distinct().collect()))
        if len(calls) == 2:
            raise RuntimeError("killed between two waves")
        return clean.clean(c)
    with pytest.raises(RuntimeError):
        sinks.write_resumable(d, process, out, "first", files_at_once=2)
    # a wave that wrote its files but not the manifest
    sinks.write_processed(d.where("file = 'f2'").withColumn("value", F.lit(-1.0)), out)
    assert sinks.write_resumable(d, process, out, "second", files_at_once=2) == 0
    assert calls == [["f0", "f1"], ["f2", "f3"], ["f2", "f3"], ["g", "h"]]
    assert by_id(sinks.read_processed(spark, out)) == by_id(clean.clean(d))
    assert sinks.write_resumable(d, process, out, "third") == 0 and len(calls) == 4
    more = d.union(spark.createDataFrame([(10**6, "f1", "UWIN", 2.0)], CELLS))
    assert sinks.write_resumable(more, process, out, "fourth", waves=0) == 1 and len(calls) == 4
    sinks.write_resumable(more, process, out, "fourth")
    assert calls[4:] == [["f1"]] and by_id(sinks.read_processed(spark, out)) == by_id(clean.clean(more))


@pytest.mark.parametrize("small", [0, 10**6])
def test_numbers_and_sums_by_window_or_ranges(spark, small):
    d = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 13).alias("v")).repartition(5)
    got = scratch.numbered(d, "v", "id", name="at", small=small).orderBy("at").collect()
    want = sorted((i * 7 % 13, i) for i in range(500))
    assert [(r.v, r.id, r["at"]) for r in got] == [(v, i, k) for k, (v, i) in enumerate(want)]
    sums = {r.id: r.end for r in scratch.running_sum(d, "v", "v", "id", small=small).collect()}
    assert sums == {i: s for (_, i), s in zip(want, np.cumsum([v for v, _ in want]).tolist())}
    assert scratch.numbered(d.where("false"), "id", small=small).count() == scratch.running_sum(d.where("false"), "v", "id", small=small).count() == 0
    plan = scratch.numbered(d, "v", "id", small=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("small", [0, 10**6])
def test_lines_of_files_in_several_splits(spark, tmp_path, small):
    """Files are read in splits of 200 bytes; lines are numbered as they stand, blank and broken ones too."""
    rnd, want = random.Random(2), []
    for name in ("b", "a", "c-empty", "d"):
        lines = [] if "empty" in name else [rnd.choice(["", "{", f'{{"x": {k}}}', f'{{"x": {k}, "y": "{"z" * rnd.randrange(300)}"}}']) for k in range(120)]
        (tmp_path / f"{name}.json").write_text("".join(x + "\n" for x in lines))
        want.append((f"{name}.json", lines))
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "10"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = files.line_rows(spark, str(tmp_path / "*.json"), small=small).orderBy("row").collect()
        sizes = {r.file.rsplit("/")[-1]: (r.n, r.lo, r.hi) for r in files.line_counts(spark, str(tmp_path / "*.json"), small=small).collect()}
        assert spark.read.text(str(tmp_path / "*.json")).rdd.getNumPartitions() > 20
    finally:
        for k in conf:
            spark.conf.unset(k)
    flat = [(f, x) for f, lines in sorted(want) for x in lines]
    assert [(r.file.rsplit("/")[-1], r.value) for r in got] == flat and [r["row"] for r in got] == list(range(360))
    assert sizes == {"a.json": (120, 0, 120), "b.json": (120, 120, 240), "d.json": (120, 240, 360)}
    records = files.line_rows(spark, str(tmp_path / "*.json"), "x int")
    assert records.columns == ["file", "row", "x"] and records.where("x IS NOT NULL").count() == sum("x" in x for _, x in flat)


def grid(spark, places=23, holes=True):
    rnd = random.Random(4)
    rows = [(f"f{p // 5}", p % 5, y, x, *[round(rnd.uniform(0, 9), 3) for _ in range(5)]) for p in range(places) for y in range(3) for x in range(4) if not holes or rnd.random() < 0.7]
    names = [*samples.FEATURES, samples.TARGET]
    d = spark.createDataFrame(rows, "file string, time_idx int, y int, x int, " + ", ".join(f"{n} double" for n in names))
    index = spark.createDataFrame([(f"f{p // 5}", p % 5, p) for p in range(places)], "file string, time_idx int, pos long")
    return d, index, {(int(r[0][1:]) * 5 + r[1], r[2], r[3]): r[4:] for r in rows}


@pytest.mark.parametrize("steps, stride, places", [(4, 1, 8), (4, 3, 5), (6, 1, 4), (1, 1, 3), (23, 1, 64), (24, 1, 8)])
def test_windows_by_ranges(spark, steps, stride, places):
    d, index, at = grid(spark)
    got = {(r.start, r.y, r.x): ([list(s) for s in r.data], r.label) for r in samples.stacked(d, index, steps, stride, places=places).collect()}
    want = {}
    for start in range(0, 23 - steps + 1, stride):
        for y in range(3):
            for x in range(4):
                seq = [at.get((start + k, y, x)) for k in range(steps)]
                if any(seq):
                    want[start, y, x] = ([list(s[:4]) if s else [0.0] * 4 for s in seq], seq[-1][4] if seq[-1] else 0.0)
    assert got == want


def test_windows_shuffle_cells_once(spark):
    """What is shuffled for windows of 8 steps is little more than the cells; nothing is shuffled after they are repeated."""
    d, index, at = grid(spark, 60, holes=False)
    wide = samples.stacked(d, index, 8, 1, places=32)
    ranged = wide._jdf.queryExecution().optimizedPlan().toString()
    assert ranged.count("Generate") == 1 and "Aggregate" not in ranged
    copies = sum(1 + (p % 32 < 7 and p >= 32) for p, *_ in at)
    assert copies < 1.2 * len(at) and wide.count() == 53 * 12
    plan = samples.sequence_cells(d, index, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")   # repeated above the join


@pytest.mark.parametrize("total", [0, 1, 2, 3, 10, 97, 1000, 4096])
def test_orders_are_permutations(spark, total):
    d = spark.range(total).withColumnRenamed("id", "sample_id")
    order = lambda seed: [r.place for r in samples.epoch_batches(d, total, 8, seed, "test").orderBy("sample_id").collect()]
    a, b = order(1), order(2)
    assert sorted(a) == sorted(b) == list(range(total)) and a == order(1)
    if total >= 97:
        assert a != b and sum(abs(x - k) for k, x in enumerate(a)) / total > total / 5
        close = sum(abs(x - y) <= 2 for x, y in zip(a, a[1:])) / total
        assert close < 0.2
    rows = samples.epoch_batches(d, total, 8, 1)
    assert rows.count() == total // 8 * 8 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["count"] for r in rows.groupBy("batch_id").count().collect()} <= {8}


def loss_of(w, x, y):
    r = y - x @ w[:-1] - w[-1]
    band = np.where(y > 15, 3, np.where(y > 5, 2, np.where(y > 0.1, 1, 0)))
    return float(np.mean(np.abs(r) * np.array([1, 6, 4, 3])[band] + r * r * np.array([1, 4, 3, 2])[band]))


def test_combined_loss_is_least(spark, tmp_path):
    """Against a search that halves its steps along every axis and pair of axes from several starts."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(280, 10, 300), rng.gamma(1, 4, 300)])
    y = np.maximum(0, 0.8 * x[:, 1] + 0.02 * (x[:, 0] - 280) + rng.standard_t(2, 300))
    rows = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)] + [(NAN, 1.0, 1.0), (1.0, None, 1.0)], "TAIR double, PRE double, corrected_precip double")
    w, b, loss = correct.combined_weights(rows, ["TAIR", "PRE"])
    assert loss == pytest.approx(loss_of(np.r_[w, b], x, y), rel=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    best = math.inf
    for start in (np.zeros(3), rng.normal(size=3), np.r_[np.linalg.lstsq(np.c_[z, np.ones(300)], y, rcond=None)[0]]):
        p, step, value = start, 4.0, loss_of(start, z, y)
        moves = [np.array(m, dtype=float) for m in np.ndindex(3, 3, 3)]
        while step > 1e-7:
            tries = [p + step * (m - 1) for m in moves]
            k = int(np.argmin(scores := [loss_of(t, z, y) for t in tries]))
            p, value, step = (tries[k], scores[k], step) if scores[k] < value - 1e-12 else (p, value, step / 2)
        best = min(best, value)
    assert loss <= best + 1e-4
    model = MODELS["combined"](rows, ["TAIR", "PRE"])
    correct.save(model, str(tmp_path / "m"))
    good = rows.where("NOT isnan(TAIR) AND PRE IS NOT NULL")
    pred = np.array([r.pred for r in correct.predict(correct.load(str(tmp_path / "m")), good).collect()])
    assert np.allclose(pred, x @ w + b)
    pairs = correct.predict(model, good).select(F.lit("s").alias("sample_id"), "pred", F.col("corrected_precip").alias("label"))
    assert verify.weighted_loss(pairs, "sample_id").first().loss == pytest.approx(loss)
    assert correct.combined_weights(rows.where("false"), ["PRE"])[2] == 0.0
    flat = correct.combined_weights(good.withColumn("TAIR", F.lit(1.0)), ["TAIR", "PRE"])
    assert math.isfinite(flat[2]) and np.isfinite(flat[0]).all()


def test_weighted_regression_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), rng.gamma(1, 8, 200)
    rows = spark.createDataFrame([(*map(float, a), float(t)) for a, t in zip(x, y)], ", ".join(f"{c} double" for c in [*samples.FEATURES, samples.TARGET]))
    m = MODELS["linear"](rows).stages[-1]
    weight = np.array([1, 4, 3, 2])[np.where(y > 15, 3, np.where(y > 5, 2, np.where(y > 0.1, 1, 0)))]
    root, full = np.sqrt(weight)[:, None], np.c_[x, np.ones(200)]
    want = np.linalg.lstsq(root * full, root[:, 0] * y, rcond=None)[0]
    assert np.allclose([*m.coefficients, m.intercept], want, atol=1e-8)


def test_lagged_rows_have_whole_windows(spark):
    d, index, at = grid(spark, 7)
    rows, names = correct.lagged(d.join(index, ["file", "time_idx"]), 3, ["TAIR"])
    got = {(r.pos, r.y, r.x): (r.TAIR_0, r.TAIR_1, r.TAIR_2) for r in rows.collect()}
    assert names == ["TAIR_0", "TAIR_1", "TAIR_2"]
    assert got == {(p, y, x): tuple(at[p - k, y, x][0] if (p - k, y, x) in at else 0.0 for k in range(3)) for p, y, x in at if p >= 2}


def test_external_models_get_arrays(spark):
    d, index, _ = grid(spark, 9)
    rows = samples.stacked(d, index, 4)
    got = external.predict(rows, external.EXTERNAL["persistence"], 4, 4, cells=40).collect()
    want = {(r.start, r.y, r.x): r.data[-1][-1] for r in rows.collect()}
    assert {(r.start, r.y, r.x): r.pred for r in got} == want and "data" not in got[0]

    def negative():
        return lambda x: -x.sum(axis=(1, 2)) if len(x) <= 2 else 1 / 0   # 2 rows hold 40 numbers
    assert {r.pred for r in external.predict(rows, negative, 4, 4, non_negative=True, cells=40).collect()} == {0.0}
    with pytest.raises(ValueError):
        external.EXTERNAL["none"]


@pytest.mark.parametrize("small", [0, 10**6])
def test_token_ids_by_lookup_or_join(spark, small):
    t = spark.createDataFrame([(1, "The the X"), (2, None), (None, "the"), (1, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.ids) for r in X.token_ids(t, X.vocabulary(t, 1), 4, small).collect()), key=repr)
    assert got == sorted([(1, [2, 3, 3, 1]), (2, [2, 1, 0, 0]), (None, [2, 3, 0, 0]), (1, [2, 1, 0, 0])], key=repr)
    assert X.token_ids(t.where("false"), X.vocabulary(t, 1), 4, small).count() == 0


def test_scratch_tables_go_with_their_block(spark, tmp_path):
    import os
    d = spark.range(5)
    with scratch.cleared(spark):
        outer = scratch.folder(spark, "outer")
        with scratch.cleared(spark, keep=(kept := scratch.folder(spark, "before"),)):
            inner = scratch.folder(spark, "inner")
            for x in (outer, inner, kept):
                d.write.parquet(x)
            assert scratch.written(d).count() == 5
        assert os.path.exists(outer) and os.path.exists(kept) and not os.path.exists(inner)
    assert not os.path.exists(outer) and not os.path.exists(kept)
    with pytest.raises(RuntimeError), scratch.cleared(spark):
        d.write.parquet(broken := scratch.folder(spark, "broken"))
        raise RuntimeError
    assert os.path.exists(broken)
