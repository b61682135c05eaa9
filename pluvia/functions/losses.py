"""Classification losses and confusion counts."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.sources.scratch import written


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log probability of the label's class; the largest logit is taken out, so that none overflows."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return top + F.ln(total) - F.element_at(logits, label.cast("int") + 1)


def log(x: Column) -> Column:
    """Natural logarithm as floating point has it: minus infinity at 0, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.when(x.isNotNull(), F.lit(float("nan"))))


def binary(p: Column, y: Column) -> Column:
    """Cross-entropy of a probability and a label of 0 or 1, not clamped: infinite where p denies the label, NaN where p is 0
    or 1 and right, as 0 times infinity is."""
    return -y * log(p) - (1 - y) * log(1 - p)


def multi_label(rows: DataFrame) -> DataFrame:
    """loss of rows (p, y: arrays of probabilities and labels): the mean over rows of the sum over labels."""
    total = F.aggregate(F.zip_with("p", "y", lambda p, y: binary(p.cast("double"), y.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return rows.agg(F.avg(total).alias("loss"))


def focal(rows: DataFrame, gamma: float = 0.0, alpha: list[float] | None = None, mean: bool = True) -> DataFrame:
    """loss of rows (nll, label): each weighs (1 - p) ** gamma, and its class's alpha."""
    weight = F.pow(1 - F.exp(-F.col("nll")), F.lit(gamma))
    if alpha:
        weight = weight * F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), F.col("label").cast("int") + 1)
    return rows.agg((F.avg if mean else F.sum)(weight * F.col("nll")).alias("loss"))


def multi_task(rows: DataFrame, ratio: float | None = None) -> DataFrame:
    """loss of rows (logits: an array of two logits for each task; y: a 0 or 1 for each): the weighted mean of each task, where
    label 1 weighs `ratio`, summed over the tasks."""
    one = rows.select(F.posexplode(F.arrays_zip("logits", "y")).alias("task", "v")).select("task", F.col("v.y").alias("y"), cross_entropy(F.col("v.logits"), F.col("v.y")).alias("nll"))
    w = F.when(F.col("y") == 1, F.lit(float(ratio or 1.0))).otherwise(1.0)
    return one.groupBy("task").agg(F.try_divide(F.sum(w * F.col("nll")), F.sum(w)).alias("l")).agg(F.sum("l").alias("loss"))


def class_confusion(rows: DataFrame) -> DataFrame:
    """class, tp, fp, fn, tn of rows (label, pred). Each row counts for its label and its prediction, so that no class meets
    every row."""
    n = rows.select(F.col("label").cast("long").alias("label"), F.col("pred").cast("long").alias("pred"))
    hit = (F.col("label") == F.col("pred")).cast("long")
    zero = F.lit(0).cast("long")
    two = F.array(F.struct(F.col("label").alias("class"), hit.alias("tp"), zero.alias("fp"), (1 - hit).alias("fn")),
                  F.struct(F.col("pred").alias("class"), zero.alias("tp"), (1 - hit).alias("fp"), zero.alias("fn")))
    per = written(n.select(F.explode(two).alias("r")).select("r.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    total = per.agg(F.coalesce(F.sum(F.col("tp") + F.col("fn")), F.lit(0))).first()[0]
    return per.withColumn("tn", F.lit(total).cast("long") - F.col("tp") - F.col("fp") - F.col("fn"))


PRF = ("micro_p", "micro_r", "micro_f1", "macro_p", "macro_r", "macro_f1")


def prf(confusion: DataFrame, wanted: tuple[str, ...] = PRF) -> DataFrame:
    """One row of the wanted values of confusion counts (tp, fp, fn by class or label): micro over the sums, macro as the mean
    over classes. A value without a denominator is null, and such a class doesn't count for its mean."""
    ratios = {"p": "try_divide({tp}, {tp} + {fp})", "r": "try_divide({tp}, {tp} + {fn})", "f1": "try_divide(2 * {tp}, 2 * {tp} + {fp} + {fn})"}
    unknown = set(wanted) - set(PRF)
    if unknown:
        raise ValueError(f"unknown values {sorted(unknown)}: {list(PRF)}")
    plain, sums = {k: k for k in ("tp", "fp", "fn")}, {k: f"sum({k})" for k in ("tp", "fp", "fn")}
    every = {f"micro_{k}": f.format(**sums) for k, f in ratios.items()} | {f"macro_{k}": f"avg({f.format(**plain)})" for k, f in ratios.items()}
    return confusion.agg(*[F.expr(every[k]).alias(k) for k in wanted])
