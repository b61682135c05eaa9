"""What the registries offer: sources, formatters, metrics and outputs by name."""
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pluvia.functions import scores as S
from pluvia.functions import text as X
from pluvia.operators import verify
from pluvia.registry import FORMATTERS, METRICS, OUTPUTS, PYTHON_METRICS, SOURCES
from pluvia.sources import files
from pluvia.sources import grid as grids

FLOAT_MAX = 3.4028235e38   # fixed value: the largest finite float of 32 bits


@SOURCES.add("json")
def json_source(spark, spec: dict) -> DataFrame:
    """spec: paths, schema, format (line or single)."""
    if spec.get("format", "line") not in ("line", "single"):
        raise ValueError(f"unknown JSON format {spec['format']!r}")
    read = files.json_arrays if spec.get("format") == "single" else files.json_lines
    return read(spark, spec["paths"], spec["schema"], spec.get("encoding", "UTF-8"))


@SOURCES.add("images")
def image_source(spark, spec: dict) -> DataFrame:
    """spec: manifests, prefix."""
    return files.image_source(spark, spec["manifests"], spec["prefix"], spec.get("label", "string"))


@SOURCES.add("grid")
def grid_source(spark, spec: dict) -> DataFrame:
    """spec: root, decoder, variables, since, until."""
    return grids.good_cells(grids.scan(spark, spec["root"], spec.get("decoder", "npz"), spec.get("variables"), spec.get("since"), spec.get("until")))


@SOURCES.add("filenames")
def listing_source(spark, spec: dict) -> DataFrame:
    return files.multi_root_listing(spark, spec["roots"], spec.get("recursive", True))


@SOURCES.add("parquet")
def parquet_source(spark, spec: dict) -> DataFrame:
    return spark.read.parquet(spec["root"])


def source(spark, specs: dict, mode: str) -> DataFrame:
    """The source of a split; valid and test fall back on that of train. Kept in memory and on disk where the spec says so."""
    spec = files.split_spec(specs, mode)
    df = SOURCES[spec["type"]](spark, spec)
    return df.persist() if spec.get("keep") else df


@FORMATTERS.add("identity")
def identity(df: DataFrame, mode: str = "train") -> DataFrame:
    return df


@FORMATTERS.add("grid")
def grid(df: DataFrame, mode: str = "train") -> DataFrame:
    """NaN becomes zero, infinities the largest finite float; without the label in infer mode."""
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            c = F.col(name)
            df = df.withColumn(name, F.when(F.isnan(c), 0.0).when(F.abs(c) == float("inf"), F.signum(c) * FLOAT_MAX).otherwise(c).cast(kind))
    return df.drop("label") if mode == "infer" else df


@FORMATTERS.add("text")
def text(df: DataFrame, mode: str = "train", vocab: DataFrame | None = None, length: int = 512) -> DataFrame:
    """Token ids of doc_id, text (the words themselves without vocab), with the label but in test mode."""
    out = X.token_ids(df, vocab, length) if vocab is not None else df.select("doc_id", X.pad(X.tokens(F.col("text")), length).alias("tokens"))
    return out if mode == "test" or "label" not in df.columns else out.join(df.select("doc_id", "label"), "doc_id")


def _counted(form):
    def of(pred, label, threshold: float):
        p, y = S.event(pred, threshold), S.event(label, threshold)
        h, m, f = F.count_if(p & y), F.count_if(~p & y), F.count_if(p & ~y)
        return form(h, m, f)
    return of


METRICS.add("POD", _counted(lambda h, m, f: S.pod(h, m)))
METRICS.add("FAR", _counted(lambda h, m, f: S.far(h, f)))
METRICS.add("TS", _counted(S.ts))
METRICS.add("MAR", _counted(lambda h, m, f: S.mar(h, m)))
METRICS.add("BIAS", _counted(S.bias))
METRICS.add("RMSE", lambda pred, label, threshold=None: F.sqrt(F.avg((pred - label) * (pred - label))))
METRICS.add("MAE", lambda pred, label, threshold=None: F.avg(F.abs(pred - label)))
METRICS.add("CC", lambda pred, label, threshold=None: S.cc(S.aggregates(pred, label).__getitem__))
METRICS.add("KGE", lambda pred, label, threshold=None: S.kge(S.aggregates(pred, label).__getitem__))
METRICS.add("EST", METRICS["TS"])   # as coded
METRICS.add("null", lambda pred, label, threshold=None: F.count(F.lit(None)))


def python_metric(name: str, f: Callable) -> None:
    """Registers f(predictions, labels) -> number over the numpy arrays of a sample, which one task holds."""
    def of(pred: pa.Array, label: pa.Array) -> float:
        return float(f(pred.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False)))
    aggregate = F.arrow_udf(of, DoubleType())
    METRICS.add(name, lambda pred, label, threshold=None: aggregate(pred.cast("double"), label.cast("double")))
    PYTHON_METRICS.add(name)


python_metric("MEDAE", lambda p, y: np.median(np.abs(p - y)))
#: tag -> metric and threshold: the sixteen scores of a batch
SIXTEEN = {m: (m, None) for m in ("RMSE", "MAE", "CC", "KGE")} | {f"{m}_{t}_rain": (m, v) for t, v in S.THRESHOLDS.items() for m in ("POD", "FAR", "TS", "BIAS")}


def sample_metrics(pairs: DataFrame, wanted: dict[str, tuple[str, float | None]]) -> DataFrame:
    """batch_id, sample_id and a column for each of wanted (tag -> metric name and threshold)."""
    keys = ["batch_id", "sample_id"]
    parts = []
    for python in (False, True):
        aggs = [METRICS[m](F.col("pred"), F.col("label"), t).alias(tag) for tag, (m, t) in wanted.items() if (m in PYTHON_METRICS) == python]
        if aggs:
            parts.append(pairs.groupBy(*keys).agg(*aggs))
    return reduce(lambda a, b: a.join(b, keys), parts).select(*keys, *wanted)


def metric_report(pairs: DataFrame, wanted: dict[str, tuple[str, float | None]] = SIXTEEN) -> DataFrame:
    """metric, value: the mean over batches of the means over a batch's samples, with NaN and empty input as 0."""
    batch = sample_metrics(pairs, wanted).groupBy("batch_id").agg(*[F.avg(m).alias(m) for m in wanted])
    one = batch.agg(*[verify.short(F.nanvl(F.coalesce(F.avg(m), F.lit(0.0)), F.lit(0.0))).alias(m) for m in wanted])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wanted])).alias("r")).select("r.*")


@OUTPUTS.add("null")
def null_output(pairs: DataFrame) -> DataFrame:
    return verify.verification_report(pairs).where("false")


@OUTPUTS.add("report")
def report_output(pairs: DataFrame) -> DataFrame:
    return verify.verification_report(pairs)


@OUTPUTS.add("json")
def json_output(pairs: DataFrame) -> DataFrame:
    """One row: the report's metrics as JSON with sorted keys."""
    return verify.verification_report(pairs).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("line"))
