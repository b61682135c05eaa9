"""Verification scores as column expressions over one aggregate pass."""
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLDS = {"light": 0.1, "moderate": 10.0, "heavy": 25.0}
METRICS = ["RMSE", "MAE", "CC", "KGE"] + [f"{m}_{t}_rain" for t in THRESHOLDS for m in ("POD", "FAR", "TS", "BIAS")]
FLAT = 1e-12   # a deviation up to this share of the largest magnitude is none, as equal values differ in the last bits


def edge(c: Column, t: float) -> Column:
    """t as the type of c holds it: a FLOAT column is compared with the nearest float, as its own values are."""
    return F.when(F.typeof(c) == "float", F.lit(t).cast("float").cast("double")).otherwise(F.lit(t))


def event(c: Column, t: float) -> Column:
    """value >= t with NaN counted as no event (Spark orders NaN highest)."""
    return (~F.isnan(c)) & (c >= edge(c, t))


def contingency(pred: Column, label: Column, t: float, tag: str) -> list[Column]:
    p, y = event(pred, t), event(label, t)
    return [F.count_if(p & y).alias(f"h_{tag}"), F.count_if(~p & y).alias(f"m_{tag}"),
            F.count_if(p & ~y).alias(f"f_{tag}"), F.count_if(~p & ~y).alias(f"c_{tag}")]


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(empty))


def pod(h: Column, m: Column) -> Column:
    return ratio(h, h + m, 1.0)


def far(h: Column, f: Column) -> Column:
    return ratio(f, h + f, 1.0)


def ts(h: Column, m: Column, f: Column) -> Column:
    return ratio(h, h + m + f, 1.0)


def mar(h: Column, m: Column) -> Column:
    return ratio(m, h + m, 1.0)


def bias(h: Column, m: Column, f: Column) -> Column:
    return F.when(h + m > 0, (h + f) / F.when(h + m > 0, h + m)).when(h + f > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def aggregates(pred: Column, label: Column) -> dict[str, Column]:
    """What RMSE, MAE, CC and KGE need, by name."""
    p = finite(pred)
    flat = lambda c: F.nanvl(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(0.0))
    return {"mse": F.avg((pred - label) * (pred - label)), "mae": F.avg(F.abs(pred - label)), "cov": F.covar_pop(p, label),
            "sp": flat(p), "sy": flat(label), "ap": F.max(F.abs(p)), "ay": F.max(F.abs(label)), "sy_raw": F.stddev_samp(label), "mp": F.avg(pred), "my": F.avg(label),
            "sp_raw": F.coalesce(F.stddev_samp(pred), F.lit(float("nan"))), "n": F.count("*")}


def sample_stats(pred: Column, label: Column) -> list[Column]:
    """Sufficient statistics of every score; one hash aggregate."""
    out = [c.alias(k) for k, c in aggregates(pred, label).items()]
    for tag, t in THRESHOLDS.items():
        out += contingency(pred, label, t, tag)
    return out


def cc(c: Callable[[str], Column] = F.col) -> Column:
    """c gives each aggregate by its name: a column, or the aggregate itself."""
    varied = (c("sp") > FLAT * c("ap")) & (c("sy") > FLAT * c("ay"))
    return F.when(varied, clamp(c("cov") / F.when(varied, c("sp")) / F.when(varied, c("sy")))).otherwise(0.0)


def _kge_ratio(num: Column, den: Column) -> Column:
    small = F.abs(den) < 1e-8
    return F.when(small, F.when(F.abs(num) < 1e-8, 1.0).otherwise(0.0)).otherwise(num / F.when(~small, den))


def kge(c: Callable[[str], Column] = F.col) -> Column:
    a, b = _kge_ratio(c("sp_raw"), c("sy_raw")), _kge_ratio(c("mp"), c("my"))
    return F.when(c("n") == 1, 1.0).otherwise(clamp(1 - F.sqrt((cc(c) - 1) * (cc(c) - 1) + (a - 1) * (a - 1) + (b - 1) * (b - 1))))


def score_columns() -> list[Column]:
    out = [F.sqrt("mse").alias("RMSE"), F.col("mae").alias("MAE"), cc().alias("CC"), kge().alias("KGE")]
    for t in THRESHOLDS:
        h, m, f = (F.col(f"{k}_{t}") for k in "hmf")
        out += [pod(h, m).alias(f"POD_{t}_rain"), far(h, f).alias(f"FAR_{t}_rain"), ts(h, m, f).alias(f"TS_{t}_rain"), bias(h, m, f).alias(f"BIAS_{t}_rain")]
    return out


LOSS_BANDS = {"light": 0.1, "moderate": 5.0, "heavy": 15.0}   # fixed values: lower ends of the classes in the loss, open


def by_band(c: Column, light, moderate, heavy, none):
    """One of four values by the loss's bands; NaN has none."""
    over = lambda k: c > edge(c, LOSS_BANDS[k])
    return F.when(F.isnan(c), none).when(over("heavy"), heavy).when(over("moderate"), moderate).when(over("light"), light).otherwise(none)


def absolute_weight(label: Column) -> Column:
    """Weight of a cell's absolute error in the loss, by the rain class of its label."""
    return by_band(label, 6.0, 4.0, 3.0, 1.0)


def squared_weight(label: Column) -> Column:
    """Weight of a cell's squared error in the loss."""
    return by_band(label, 4.0, 3.0, 2.0, 1.0)


def loss_class(c: Column) -> Column:
    """Rain class by the loss's bands, open below; NaN has none."""
    return by_band(c, "light", "moderate", "heavy", "none")


def score_class(c: Column) -> Column:
    """Rain class by the scores' thresholds, closed below; NaN has none."""
    light, moderate, heavy = THRESHOLDS.values()
    return F.when(event(c, heavy), "heavy").when(event(c, moderate), "moderate").when(event(c, light), "light").otherwise("none")
