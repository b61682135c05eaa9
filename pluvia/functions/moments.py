"""Moments of predictions and labels that can be merged: counts, means, sums of squared deviations and events.

Two parts of a sample are merged pairwise: with d the difference of their means, the deviations' squares sum to those of
both parts plus d * d * n1 * n2 / (n1 + n2). So parts need not be read again, and nothing is lost to cancellation."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions import scores as S

COUNTS = [f"{k}_{t}" for t in S.THRESHOLDS for k in "hmfc"]
ADDED, LARGEST = ["se", "ae", *COUNTS], ["ap", "ay"]
MEANS = {"mp": "qp", "my": "qy", "mc": "qc"}   # mean, sum of squared deviations: of predictions, labels, finite predictions
NAMES = ["n", *MEANS, *MEANS.values(), "qcy", *ADDED, *LARGEST]


def moments(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys and NAMES of pairs (pred, label); pairs with a null are left out."""
    p, y = F.col("pred"), F.col("label")
    c = S.finite(p)
    spread = lambda x: F.var_pop(x) * F.count("*")
    aggs = {"n": F.count("*"), "mp": F.avg(p), "my": F.avg(y), "mc": F.avg(c), "qp": spread(p), "qy": spread(y), "qc": spread(c), "qcy": F.covar_pop(c, y) * F.count("*"),
            "se": F.sum((p - y) * (p - y)), "ae": F.sum(F.abs(p - y)), "ap": F.max(F.abs(c)), "ay": F.max(F.abs(y))}
    events = [e for t, v in S.THRESHOLDS.items() for e in S.contingency(p, y, v, t)]
    return pairs.where(p.isNotNull() & y.isNotNull()).groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()], *events).select(*keys, *NAMES)


def merged(new: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    """The rows of new, each merged with the row of old that has its keys, if there is one."""
    a = new.select(*keys, *[F.col(c).alias(f"a_{c}") for c in NAMES])
    b = old.select(*keys, *[F.col(c).alias(f"b_{c}") for c in NAMES])
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    n = A("n") + B("n")
    d = lambda m: B(m) - A(m)
    both = {"n": n, **{m: A(m) + d(m) * B("n") / n for m in MEANS}, **{q: A(q) + B(q) + d(m) * d(m) * A("n") * B("n") / n for m, q in MEANS.items()},
            "qcy": A("qcy") + B("qcy") + d("mc") * d("my") * A("n") * B("n") / n, **{c: A(c) + B(c) for c in ADDED}, **{c: F.greatest(A(c), B(c)) for c in LARGEST}}
    return a.join(b, list(keys), "left").select(*keys, *[F.when(B("n").isNull(), A(c)).otherwise(both[c]).alias(c) for c in NAMES])


def scores(m: DataFrame, *keys: str) -> DataFrame:
    """The sixteen scores of each row of moments."""
    def deviation(q: str, one: Column) -> Column:
        return F.when(F.col("n") > 1, F.sqrt(F.col(q) / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(one)
    zero, nan, none = F.lit(0.0), F.lit(float("nan")), F.lit(None).cast("double")
    flat = lambda q: F.nanvl(deviation(q, zero), zero)
    stats = {"mse": F.col("se") / F.col("n"), "mae": F.col("ae") / F.col("n"), "cov": F.col("qcy") / F.col("n"), "sp": flat("qc"), "sy": flat("qy"), "sy_raw": deviation("qy", none), "sp_raw": deviation("qp", nan)}
    return m.select(*keys, "n", "mp", "my", "ap", "ay", *COUNTS, *[c.alias(k) for k, c in stats.items()]).select(*keys, *S.score_columns())
