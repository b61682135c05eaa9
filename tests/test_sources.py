import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pluvia import catalog
from pluvia.functions import losses
from pluvia.functions import text as X
from pluvia.operators import correct, samples, verify
from pluvia.registry import FORMATTERS, METRICS, MODELS, OUTPUTS, SOURCES
from pluvia.sources import files, grid, scratch, sinks


def grid_file(path, drop=(), steps=6, compressed=False):
    """A file of arrays over (time, y, x)."""
    time = np.datetime64("2024-01-01T00", "us") + np.arange(steps) * np.timedelta64(1, "h")
    values = {v: np.arange(steps * 12.0).reshape(steps, 3, 4) + k for k, v in enumerate(grid.VARS) if v not in drop}
    (np.savez_compressed if compressed else np.savez)(path, time=time, **values)


def test_grid_scan_and_quarantine(spark, tmp_path):
    grid_file(tmp_path / "b.npz", drop=("VWIN",))
    grid_file(tmp_path / "a.npz", compressed=True)
    (tmp_path / "c.npz").write_bytes((tmp_path / "a.npz").read_bytes()[:100])
    broken = bytearray((tmp_path / "b.npz").read_bytes())
    broken[broken.rindex(b"NUMPY")] ^= 255   # one variable's header
    (tmp_path / "e.npz").write_bytes(broken)
    (tmp_path / "inner").mkdir()
    grid_file(tmp_path / "inner" / "d.npz")
    got = grid.scan(spark, str(tmp_path)).cache()
    good = grid.good_cells(got)
    assert {r.file: r.n for r in good.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"a.npz": 72, "b.npz": 72}
    assert sorted(r.file for r in grid.bad_files(got).collect()) == ["c.npz", "e.npz"]
    r = good.where("file = 'b.npz' AND time_idx = 2 AND y = 1 AND x = 3").first()
    assert (r.TAIR, r.VWIN, r.PRE, r.time) == (2 * 12 + 7, 0.0, 2 * 12 + 7 + 3, dt.datetime(2024, 1, 1, 2))
    assert files.file_listing(spark, str(tmp_path), True, "*.npz").count() == 5
    assert files.file_listing(spark, str(tmp_path), False, "*.npz").count() == 4
    both = files.multi_root_listing(spark, f"{tmp_path}/inner, {tmp_path}/inner")
    assert both.count() == 2
    with pytest.raises(FileNotFoundError):
        files.file_listing(spark, str(tmp_path), pattern="*.nc")
    with pytest.raises(Exception, match="FileNotFound"):
        grid.scan(spark, str(tmp_path / "inner"), "npz").union(grid.scan(spark, str(tmp_path.parent), "npz")).collect()
    with pytest.raises(ValueError):
        grid.scan(spark, str(tmp_path), "nc")


def test_grid_slabs_are_pruned(spark, tmp_path):
    """A slab of 2 steps is read by itself; times and variables that aren't wanted are not."""
    grid_file(tmp_path / "a.npz", steps=48)
    grid_file(tmp_path / "b.npz", steps=3)
    two = 2 * 12 * 8 * 2
    scan = lambda **o: grid.scan(spark, str(tmp_path), variables=["TAIR", "PRE"], slab_bytes=two, **o)
    assert scan().rdd.getNumPartitions() == 24 + 2 and scan().count() == 51 * 12
    some = scan(since="2024-01-01T05:00", until="2024-01-01T08:00")
    assert some.rdd.getNumPartitions() == 3
    assert sorted({r.time.hour for r in some.select("time").collect()}) == [5, 6, 7, 8]
    assert scan(since="2025-01-01").count() == 0
    reader = grid.Reader({"path": str(tmp_path), "variables": "TAIR", "slab_bytes": "100"})
    assert max(s.cells() for p in reader.partitions() for s in p.slabs) == 12
    assert grid.scan(spark, str(tmp_path)).rdd.getNumPartitions() == 1   # small slabs share a task
    spark.conf.set(grid.PUSHDOWN, "true")
    try:
        day = scan().where((F.col("time") >= dt.datetime(2024, 1, 2, 3)) & (F.col("file") == "a.npz") & (F.col("TAIR") > 0))
        assert day.rdd.getNumPartitions() == 11
        assert day.count() == 21 * 12
    finally:
        spark.conf.unset(grid.PUSHDOWN)


def test_points_equal_dense_grids(spark, tmp_path):
    grid_file(tmp_path / "a.npz")
    dense = grid.good_cells(grid.scan(spark, str(tmp_path)))
    p = dense.toPandas().sort_values(["time_idx", "y", "x"])
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "a.npz").write_bytes(grid.encode({c: p[c].to_numpy("datetime64[us]" if c == "time" else None) for c in ("time_idx", "time", "y", "x", *grid.VARS)}))
    got = grid.good_cells(grid.scan(spark, str(tmp_path / "points"), slab_bytes=1000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense.collect()))


def test_json_sources(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "one.json").write_text('{"text": "a", "label": 1}\n{"text": "b\\nc", "label": 0}\n')
    (tmp_path / "l" / "two.json").write_text('{"text": "d"}\n')
    (tmp_path / "s.json").write_text(json.dumps([{"text": "a", "label": 1}, {"text": "é", "label": 2}]))
    lines = catalog.source(spark, {"train": {"type": "json", "paths": str(tmp_path / "l"), "schema": "text string, label int"}, "valid": None}, "valid")
    assert sorted(map(tuple, lines.collect()), key=str) == [("a", 1), ("b\nc", 0), ("d", None)]
    single = SOURCES["json"](spark, {"paths": str(tmp_path / "s.json"), "schema": "text string, label int", "format": "single"})
    assert sorted(map(tuple, single.collect())) == [("a", 1), ("é", 2)]
    with pytest.raises(ValueError):
        SOURCES["json"](spark, {"paths": "", "schema": "a int", "format": "csv"})


@pytest.mark.parametrize("registry", [SOURCES, FORMATTERS, MODELS, METRICS, OUTPUTS])
def test_unknown_names_raise(registry):
    assert registry
    with pytest.raises(ValueError):
        registry["no such name"]


def test_malformed_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"text": "a", "label": 1}\n{"text": "b", "lab\n\n[1]\n{"text": "c", "label": "x"}\n{"label": 2}\n')
    got = files.json_lines(spark, str(tmp_path / "l.json"), "text string, label int", malformed=True)
    assert got.columns == ["text", "label", "malformed"]
    rows = [(r.text, r.label) for r in got.where("malformed IS NULL").collect()]
    bad = [r.malformed for r in got.where("malformed IS NOT NULL").collect()]
    assert sorted(rows, key=str) == [("a", 1), (None, 2)] and '{"text": "b", "lab' in bad and '{"text": "c", "label": "x"}' in bad and len(bad) == 4


def test_image_files(spark, tmp_path):
    (tmp_path / "img" / "in").mkdir(parents=True)
    (tmp_path / "img" / "in" / "a.png").write_bytes(b"xy")
    (tmp_path / "m.json").write_text(json.dumps([{"path": "in/a.png", "label": 1}, {"path": "b.png", "label": 0}]))
    got = SOURCES["images"](spark, {"manifests": str(tmp_path / "m.json"), "prefix": f"file://{tmp_path}/img/", "label": "int"})
    assert {(r.path, r.label, r.content and bytes(r.content)) for r in got.collect()} == {("in/a.png", 1, b"xy"), ("b.png", 0, None)}


def test_files_are_written_whole(spark, tmp_path):
    d = spark.createDataFrame([("x/a", bytearray(b"1")), ("b", bytearray(b"22"))], "name string, content binary")
    assert sinks.write_files(d, str(tmp_path)) == 2 == sinks.write_files(d, f"file://{tmp_path}")
    assert (tmp_path / "x" / "a").read_bytes() == b"1" and sorted(p.name for p in tmp_path.iterdir()) == ["b", "x"]


def test_image_manifest_keeps_missing(spark):
    m = spark.createDataFrame([("a.png", 1), ("b.png", 0)], "path string, label int")
    i = spark.createDataFrame([("p/a.png", bytearray(b"xy"))], "path string, content binary")
    assert {r.path: r.content for r in files.image_manifest(m, i, "p").collect()} == {"a.png": b"xy", "b.png": None}


def test_time_index_ties_and_windows(spark):
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("b", 0, t), ("a", 1, t), ("a", 0, t + dt.timedelta(hours=5)), ("c", 0, t - dt.timedelta(hours=1)), ("d", 3, t)], "file string, time_idx int, time timestamp_ntz")
    i = samples.global_time_index(f)
    assert [(r.file, r.time_idx) for r in i.orderBy("pos").collect()] == [("c", 0), ("a", 1), ("b", 0), ("d", 3), ("a", 0)]
    assert sorted((r.start, r.step, r.pos) for r in samples.windows(i, 3, 2).collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (2, 0, 2), (2, 1, 3), (2, 2, 4)]
    assert samples.windows(i, 6).count() == 0 and samples.windows(i.where("false"), 2).count() == 0


def test_batches(spark):
    d = spark.range(10).select(F.col("id").alias("sample_id"))
    count = lambda mode: sorted(r["count"] for r in samples.batches(d, 4, mode).groupBy("batch_id").count().collect())
    assert count("train") == [4, 4] and count("test") == [2, 4, 4]


def test_numbers_and_prefix_counts(spark):
    d = spark.range(1000).select((F.col("id") % 7).cast("string").alias("file"), F.col("id").alias("line")).repartition(5)
    got = files.global_rows(d, "line").orderBy("row").collect()
    assert [r.row for r in got] == list(range(1000)) and [(r.file, r.line) for r in got] == sorted((str(i % 7), i) for i in range(1000))
    iv = samples.prefix_counts(d).orderBy("file").collect()
    assert iv[0].lo == 0 and iv[-1].hi == 1000 and all(a.hi == b.lo for a, b in zip(iv, iv[1:]))
    one = samples.rows_to_files(scratch.numbered(d, "file", "line", name="row").withColumnRenamed("file", "own"), samples.prefix_counts(d), bucket=64)
    assert one.where("own <> file").count() == 0 and one.count() == 1000


def test_nan_labels(spark):
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([(0, "a", 1.0, nan), (0, "a", 2.0, 1.0), (0, "b", nan, 1.0), (0, "b", nan, 2.0), (0, "c", inf, 1.0), (0, "c", 3.0, 1.0), (0, "d", 1.0, 1.0), (0, "d", 2.0, 1.5)], "batch_id long, sample_id string, pred double, label double")
    cc = {r.sample_id: r.CC for r in verify.sample_scores(d).collect()}
    assert cc["a"] == 0.0 and cc["d"] > 0


def test_losses(spark):
    d = spark.createDataFrame([([1000.0, 0.0], 0), ([1000.0, 0.0], 1)], "z array<double>, label int")
    got = [r.l for r in d.select(losses.cross_entropy(F.col("z"), F.col("label")).alias("l")).collect()]
    assert got == [0.0, 1000.0]


def test_formatters(spark):
    d = spark.createDataFrame([(float("nan"), float("inf"))], "x double, label double")
    r = FORMATTERS["grid"](d).first()
    assert r.x == 0.0 and r.label == pytest.approx(3.4028235e38)
    assert FORMATTERS["grid"](d, "infer").columns == ["x"]
    t = spark.createDataFrame([(1, "The the X", 0), (2, None, 1)], "doc_id long, text string, label int")
    ids = {r.doc_id: r.ids for r in FORMATTERS["text"](t, "train", X.vocabulary(t, 1), 5).collect()}
    assert ids == {1: [2, 3, 3, 1, 0], 2: [2, 1, 0, 0, 0]}
    line = spark.range(1).select(X.report_line([F.lit("12345678"), F.lit("b")], sign="_").alias("l")).first().l
    assert line == "12345678b_____"


def test_models_save_and_weights(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), 0.0, 1.0, float(i % 3), 2.0 * i) for i in range(40)], "TAIR double, UWIN double, VWIN double, PRE double, corrected_precip double")
    m = MODELS["linear"](rows)
    correct.save(m, str(tmp_path / "m"))
    r = correct.predict(correct.load(str(tmp_path / "m")), rows.limit(5), non_negative=True).collect()
    assert all(x.pred == pytest.approx(x.corrected_precip, abs=1e-6) for x in r)


def test_history_and_predictions(spark, tmp_path):
    d = spark.createDataFrame([(0, 1.0, 2.0)], "b long, RMSE double, MAE double")
    sinks.write_history(sinks.history_rows(d, "b", ["RMSE", "MAE"], "r", "valid", "step"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    sinks.write_predictions(d, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first().value == '{"MAE":2.0,"RMSE":1.0,"b":0}'


def test_outputs(spark):
    d = spark.createDataFrame([(0, "a", 1.0, 1.0)], "batch_id long, sample_id string, pred double, label double")
    assert json.loads(OUTPUTS["json"](d).first().line)["RMSE"] == 0.0 and OUTPUTS["null"](d).count() == 0
    assert d.groupBy("sample_id").agg(METRICS["POD"](F.col("pred"), F.col("label"), 0.1).alias("v")).first().v == 1.0


def hours(spark):
    """(day, hour) of all events."""
    return {(r.d, r.h) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("date_format(ts, 'yyyyMMdd') AS d", "hour(ts) AS h").distinct().collect()}


def test_listing_holds_a_file_for_each_hour(spark):
    got = [r.path for r in entry.queries()["grid_file_listing"](spark, "/root/testdata/sf0.001").collect()]
    assert got == sorted(f"grid-{d}-{h:02}.npz" for d, h in hours(spark))


def test_quarantine_reads_a_file_for_each_hour(spark):
    got = sorted(r.file for r in entry.queries()["bad_file_quarantine"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(f"grid-{d}-{h:02}.npz" for d, h in hours(spark) if h % 7 == 0)
