"""Sample, batch and final verification scores."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions import scores as S


def sample_scores(pairs: DataFrame) -> DataFrame:
    agg = pairs.groupBy("batch_id", "sample_id").agg(*S.sample_stats(F.col("pred"), F.col("label")))
    return agg.select("batch_id", "sample_id", *S.score_columns())


def batch_scores(pairs: DataFrame) -> DataFrame:
    return sample_scores(pairs).groupBy("batch_id").agg(*[F.avg(m).alias(m) for m in S.METRICS])


def short(c):
    """Three decimals; nine come first, so that a mean's last bits don't decide a tie."""
    return F.round(F.round(c, 9), 3) + F.lit(0.0)   # no negative zero


def verification_report(pairs: DataFrame) -> DataFrame:
    """Mean over batches, NaN and empty input give 0, three decimals: 16 rows (metric, value)."""
    one = batch_scores(pairs).agg(*[short(F.nanvl(F.coalesce(F.avg(m), F.lit(0.0)), F.lit(0.0))).alias(m) for m in S.METRICS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in S.METRICS])).alias("r")).select("r.*")


def cell_loss(p, y):
    """Loss of a cell: absolute and squared error, each weighted by the rain class of the label."""
    return F.abs(p - y) * S.absolute_weight(y) + (p - y) * (p - y) * S.squared_weight(y)


def weighted_loss(pairs: DataFrame, *keys: str, size: bool = False) -> DataFrame:
    """Mean loss of the cells for each key; with `size` also n, the number of samples."""
    n = [F.count_distinct("sample_id").alias("n")] if size else []
    return pairs.groupBy(*keys).agg(F.avg(cell_loss(F.col("pred"), F.col("label"))).alias("loss"), *n)


def counts(pairs: DataFrame) -> DataFrame:
    """Hits, misses, false alarms and correct negatives of each sample at each threshold."""
    return pairs.groupBy("sample_id").agg(*[c for tag, t in S.THRESHOLDS.items() for c in S.contingency(F.col("pred"), F.col("label"), t, tag)])


def _side(c, tag: str) -> list:
    """Flags of one side, and its least and largest value but NaN (null where all are NaN)."""
    shown = F.when(~F.isnan(c), c)
    return [F.bool_or(F.isnan(c)).alias(f"{tag}_contains_nan"), F.bool_or(~F.isnan(c) & (F.abs(c) == float("inf"))).alias(f"{tag}_contains_inf"), F.min(shown).alias(f"{tag}_min"), F.max(shown).alias(f"{tag}_max")]


def error_samples(pairs: DataFrame) -> DataFrame:
    """A row for each sample and error, with the flags and ranges of predictions and labels. `nan_inf_values`: predictions
    hold NaN or infinities. `nan_std`: with these set to zero, a deviation is NaN (a single cell, or labels that hold NaN or
    infinities); its predictions are the ones set to zero."""
    p, y = F.col("pred"), F.col("label")
    clean = S.finite(p)
    agg = pairs.groupBy("sample_id").agg(*_side(p, "pred"), *_side(y, "label"), F.count("*").alias("n"), F.min(clean).alias("_lo"), F.max(clean).alias("_hi"))
    label = [f"label_{k}" for k in ("contains_nan", "contains_inf", "min", "max")]
    raw = agg.where("pred_contains_nan OR pred_contains_inf").select("sample_id", F.lit("nan_inf_values").alias("error"), "pred_contains_nan", "pred_contains_inf", "pred_min", "pred_max", *label)
    flat = agg.where("n = 1 OR label_contains_nan OR label_contains_inf").select(
        "sample_id", F.lit("nan_std").alias("error"), F.lit(False).alias("pred_contains_nan"), F.lit(False).alias("pred_contains_inf"), F.col("_lo").alias("pred_min"), F.col("_hi").alias("pred_max"), *label)
    return raw.union(flat)


def error_values(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """The cells of the samples in error, with the error; predictions as they were saved."""
    bad = errors.select("sample_id", "error")
    return pairs.join(bad, "sample_id").withColumn("pred", F.when(F.col("error") == "nan_std", S.finite(F.col("pred"))).otherwise(F.col("pred")))
