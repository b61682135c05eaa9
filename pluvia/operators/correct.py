"""Fitting, validating and applying a correction of forecasts: MLlib models, and the combined loss by reweighted least squares."""
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvia.functions import scores as S
from pluvia.operators import verify
from pluvia.operators.samples import FEATURES, TARGET
from pluvia.registry import MODELS
from pluvia.sources.scratch import written

def _pipeline(stage, train: DataFrame, features: list[str], target: str) -> PipelineModel:
    rows = train.withColumn("label", F.col(target).cast("double")).withColumn("weight", S.squared_weight(F.col("label")))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), stage]).fit(rows)


@MODELS.add("linear")
def fit_linear(train: DataFrame, features: list[str] = FEATURES, target: str = TARGET) -> PipelineModel:
    return _pipeline(LinearRegression(weightCol="weight", predictionCol="pred", solver="normal"), train, features, target)


@MODELS.add("trees")
def fit_trees(train: DataFrame, features: list[str] = FEATURES, target: str = TARGET, rounds: int = 10) -> PipelineModel:
    return _pipeline(GBTRegressor(weightCol="weight", predictionCol="pred", maxIter=rounds, maxDepth=4, seed=7), train, features, target)


def combined_weights(train: DataFrame, features: list[str] = FEATURES, target: str = TARGET, rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and mean loss of the linear correction with the least loss of verify.cell_loss, by reweighted least
    squares: of a residual r, |r| counts as r * r / (2 * |last r|), so each round solves the normal equations of one
    aggregate of (K + 1) * (K + 4) / 2 sums, and no round's loss is above the one before but for `floor`, which keeps the
    weights finite. Rows with a null or NaN are left out; without a row the correction is zero."""
    cols = [F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]
    y = F.col(target).cast("double")
    rows = train.select(*cols, y.alias("y"), S.absolute_weight(y).alias("a"), S.squared_weight(y).alias("b"))
    rows = rows.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) for c in rows.columns]))
    names, k = [f"x{i}" for i in range(len(features))], len(features)
    scale = rows.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("sy"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    if not scale.n:
        return np.zeros(k), 0.0, 0.0
    mean = np.array([scale[f"m_{c}"] for c in names])
    dev = np.array([scale[f"s_{c}"] or 1.0 for c in names])
    rows = written(rows.select(*[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(names, mean, dev)], F.lit(1.0).alias(f"x{k}"), "y", "a", "b"))
    names.append(f"x{k}")
    w, best, last, floor = np.zeros(k + 1), (np.inf, np.zeros(k + 1)), np.inf, max(scale.sy, 1e-9)
    for _ in range(rounds):
        r = F.col("y") - reduce(lambda p, q: p + q, [F.col(c) * float(v) for c, v in zip(names, w)])
        q = F.col("b") + F.col("a") / (2 * F.greatest(F.abs(r), F.lit(float(floor))))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        got = rows.agg(F.avg(F.col("a") * F.abs(r) + F.col("b") * r * r).alias("loss"), *[F.sum(q * F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(q * F.col(names[i]) * F.col("y")).alias(f"h{i}") for i in range(k + 1)]).first()
        if got.loss < best[0]:
            best = (got.loss, w)
        if floor < 1e-7 * max(scale.sy, 1e-9) and abs(last - got.loss) <= tolerance * max(abs(last), 1e-300):
            break
        last, floor = got.loss, max(floor / 4, 1e-10 * max(scale.sy, 1e-9))
        g = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            g[i, j] = g[j, i] = got[f"g{i}_{j}"]
        w = np.linalg.lstsq(g, np.array([got[f"h{i}"] for i in range(k + 1)]), rcond=None)[0]
    loss, w = best
    own = w[:k] / dev
    return own, float(w[k] - own @ mean), float(loss)


@MODELS.add("combined")
def fit_combined(train: DataFrame, features: list[str] = FEATURES, target: str = TARGET) -> PipelineModel:
    """The correction of combined_weights, to be saved and loaded as the other models are."""
    own, intercept, _ = combined_weights(train, features, target)
    total = " + ".join([f"({intercept!r}D)", *[f"({float(v)!r}D) * `{f}`" for f, v in zip(features, own)]])
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {total} AS pred FROM __THIS__")])


def lagged(cells: DataFrame, steps: int, features: list[str] = FEATURES) -> tuple[DataFrame, list[str]]:
    """cells (pos, y, x, ...) with the features of the `steps` last places of each cell, from the first place that has as
    many; a place where a cell is absent is zeros."""
    w = Window.partitionBy("y", "x").orderBy("pos").rangeBetween(-(steps - 1), 0)
    seen = F.map_from_entries(F.collect_list(F.struct("pos", F.array(*features))).over(w))  # `steps` entries at most
    rows = cells.withColumn("_m", seen)
    names = [f"{v}_{k}" for k in range(steps) for v in features]
    cols = [F.coalesce(F.get(F.try_element_at("_m", F.col("pos") - k), i), F.lit(0.0)).alias(f"{v}_{k}") for k in range(steps) for i, v in enumerate(features)]
    return rows.where(F.col("pos") >= steps - 1).select("*", *cols).drop("_m"), names


def predict(model: PipelineModel, rows: DataFrame, non_negative: bool = False) -> DataFrame:
    out = model.transform(rows).drop("features")
    return out.withColumn("pred", F.greatest("pred", F.lit(0.0))) if non_negative else out


def validate(model: PipelineModel, valid: DataFrame, batch: Column, sample: Column, target: str = TARGET) -> DataFrame:
    """metric, value: the loss weighted by batch size, and the 16 scores; no rows: infinite loss and zero scores."""
    pairs = predict(model, valid).select(batch.alias("batch_id"), sample.alias("sample_id"), "pred", F.col(target).alias("label"))
    loss = verify.weighted_loss(pairs, "batch_id").join(pairs.groupBy("batch_id").agg(F.count_distinct("sample_id").alias("n")), "batch_id")
    total = loss.agg(F.coalesce(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")), F.lit(float("inf"))).alias("value"))
    return total.select(F.lit("loss").alias("metric"), "value").union(verify.verification_report(pairs))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
