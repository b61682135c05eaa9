"""Cleaning of gridded values: sentinel fill, range check, log, global statistics, z-score."""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources.scratch import sent_if_small, written

# fixed values
SENTINELS = (9999.0, -9999.0, 999999.0, -999999.0)
PRECIP = ("PRE", "corrected_precip")
LIMITS = {"TAIR": (0.0, None), "UWIN": (-100.0, 100.0), "VWIN": (-100.0, 100.0), "PRE": (0.0, 100.0), "corrected_precip": (0.0, 100.0)}

def is_sentinel(c, s):
    return (~F.isnan(c)) & (F.abs(c - F.lit(s)) < 1e-3)


def any_sentinel(c):
    return reduce(lambda a, b: a | b, [is_sentinel(c, x) for x in SENTINELS])


def fill_sums(cells: DataFrame) -> DataFrame:
    """Per (file, variable) what its fill values need: sums that add up over parts of a file."""
    v = F.col("value")
    aggs = [F.coalesce(F.sum(F.when(~F.isnan(v), v)), F.lit(0.0)).alias("s"), F.count(F.when(~F.isnan(v), v)).alias("n")]
    for k, x in enumerate(SENTINELS):
        aggs += [F.count_if(is_sentinel(v, x)).alias(f"c{k}"), F.coalesce(F.sum(F.when(is_sentinel(v, x), v)), F.lit(0.0)).alias(f"q{k}")]
    return cells.groupBy("file", "variable").agg(*aggs)


SUMS = ["s", "n", *(f"{x}{k}" for k in range(len(SENTINELS)) for x in "cq")]


def fill_values(sums: DataFrame) -> DataFrame:
    """The four sequential fill values: each mean still holds the later sentinels, and what earlier ones were replaced by."""
    df = sums
    for k in range(len(SENTINELS)):
        df = df.withColumn(f"f{k}", F.when(F.col("variable").isin(*PRECIP), 0.0).otherwise(F.try_divide("s", "n")))
        df = df.withColumn("s", F.when(F.col(f"c{k}") > 0, F.col("s") - F.col(f"q{k}") + F.col(f"c{k}") * F.col(f"f{k}")).otherwise(F.col("s")))
    return df.select("file", "variable", *[f"f{k}" for k in range(len(SENTINELS))])


def fills(cells: DataFrame) -> DataFrame:
    """Per (file, variable) the fill values from one aggregate."""
    return fill_values(fill_sums(cells))


def filled(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells with sentinels replaced by the fill values (file, variable, f0 ...)."""
    v = F.col("value")
    expr = v
    for k in reversed(range(len(SENTINELS))):
        expr = F.when(is_sentinel(v, SENTINELS[k]), F.col(f"f{k}")).otherwise(expr)
    return cells.join(sent_if_small(values), ["file", "variable"]).withColumn("value", expr).drop(*[f"f{k}" for k in range(len(SENTINELS))])


def sentinel_fill(cells: DataFrame) -> DataFrame:
    return filled(cells, fills(cells))


def out_of_range(v, var):
    """By the fixed limits."""
    bad = F.lit(False)
    for name, (lo, hi) in LIMITS.items():
        o = (F.lit(False) if lo is None else v < lo) | (F.lit(False) if hi is None else v > hi)
        bad = F.when(var == name, o).otherwise(bad)
    return (~F.isnan(v)) & bad


def limits_table(spark: SparkSession, limits: dict = LIMITS) -> DataFrame:
    """variable, lo, hi; null where a side has no limit."""
    return spark.createDataFrame([(k, *map(lambda x: None if x is None else float(x), v)) for k, v in limits.items()], "variable string, lo double, hi double")


def range_flags(cells: DataFrame, limits: DataFrame, name: str = "out") -> DataFrame:
    """cells with whether their value lies outside the limits (variable, lo, hi) of their variable, which count as inside. A
    variable without limits, a null limit and NaN are never outside."""
    v, side = F.col("value"), sent_if_small(limits.select("variable", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
    out = ~F.isnan(v) & (F.coalesce(v < F.col("_lo"), F.lit(False)) | F.coalesce(v > F.col("_hi"), F.lit(False)))
    return cells.join(side, "variable", "left").withColumn(name, F.coalesce(out, F.lit(False))).drop("_lo", "_hi")


def range_zero(cells: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Values outside the limits become zero: by a table, or by the fixed ones without a join."""
    if limits is None:
        return cells.withColumn("value", F.when(out_of_range(F.col("value"), F.col("variable")), 0.0).otherwise(F.col("value")))
    return range_flags(cells, limits, "_out").withColumn("value", F.when(F.col("_out"), 0.0).otherwise(F.col("value"))).drop("_out")


def finish(cells: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Filled cells: range check, logarithm of precipitation, zero for what isn't finite."""
    df = range_zero(cells, limits)
    df = df.withColumn("value", F.when(F.col("variable").isin(*PRECIP), F.log1p("value")).otherwise(F.col("value")))
    v = F.col("value")
    return df.withColumn("value", F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def clean(cells: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    return finish(sentinel_fill(cells), limits)


def counted_value():
    """What the statistics count: cells of precipitation only where they aren't close to zero."""
    return F.when(~F.col("variable").isin(*PRECIP) | (F.abs("value") > 1e-8), F.col("value"))


def file_moments(cleaned: DataFrame) -> DataFrame:
    """file, variable, n, s, q: count, sum and sum of squares of each file's cells, from which the statistics of any files
    follow."""
    v = counted_value()
    return cleaned.groupBy("file", "variable").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def first_files(rows: DataFrame, limit: int | None) -> DataFrame:
    """The rows of the first `limit` files by name, of all without limit."""
    if limit is None:
        return rows
    files = rows.select("file").distinct().orderBy("file").limit(limit)
    return rows.join(sent_if_small(files), "file", "left_semi")


def stats_of(moments: DataFrame, file_limit: int | None = 50) -> DataFrame:
    """variable, n, mean, std (population) over the first files by name, from their moments; no cell gives 0 and 1."""
    g = first_files(moments, file_limit).groupBy("variable").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.try_divide("s", "n")
    return g.select("variable", "n", F.coalesce(mean, F.lit(0.0)).alias("mean"),
                    F.when(F.col("n") > 0, F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(1e-6)))).otherwise(1.0).alias("std"))


def wide_stats(stats: DataFrame, variables=tuple(LIMITS)) -> DataFrame:
    """One row with <variable>_mean and <variable>_std."""
    return stats.agg(*[F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{v}_{c}") for v in variables for c in ("mean", "std")])


def global_stats(cleaned: DataFrame, file_limit: int | None = 50) -> DataFrame:
    """Population mean and deviation per variable over the first files by name; non-zero cells for precipitation."""
    return stats_of(file_moments(first_files(cleaned, file_limit)), None)


def zscore(cleaned: DataFrame, stats: DataFrame) -> DataFrame:
    """stats has one row per variable (five at most), so its side is broadcast."""
    j = cleaned.join(F.broadcast(stats.select("variable", "mean", "std")), "variable", "left")
    return j.withColumn("value", (F.col("value") - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0))).drop("mean", "std")


def preprocess(cells: DataFrame, file_limit: int = 50) -> DataFrame:
    """Cleaned and normalised cells; they are cleaned once, for the statistics and for the result."""
    c = written(clean(cells))
    return zscore(c, global_stats(c, file_limit))
