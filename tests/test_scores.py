import math

from pyspark.sql import functions as F

from pluvia.operators import clean, verify


def pairs(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, sample_id string, pred double, label double")


def test_no_event_and_constant_prediction(spark):
    r = verify.sample_scores(pairs(spark, [(0, "a", 0.0, 0.0), (0, "a", 0.0, 0.05)])).first()
    assert (r.POD_light_rain, r.FAR_light_rain, r.TS_light_rain, r.BIAS_light_rain, r.CC) == (1.0, 1.0, 1.0, 1.0, 0.0)


def test_predicted_without_observed_is_infinite_bias(spark):
    r = verify.sample_scores(pairs(spark, [(0, "a", 0.1, 0.0), (0, "a", 0.0, 0.0)])).first()
    assert math.isinf(r.BIAS_light_rain) and r.TS_light_rain == 0.0


def test_empty_report_has_zeros(spark):
    rows = verify.verification_report(pairs(spark, [])).collect()
    assert len(rows) == 16 and all(r.value == 0 for r in rows)


def test_sequential_fill(spark):
    rows = [("f", "TAIR", 10.0), ("f", "TAIR", 9999.0), ("f", "TAIR", -9999.0), ("f", "TAIR", 20.0)]
    got = sorted(r.value for r in clean.sentinel_fill(spark.createDataFrame(rows, "file string, variable string, value double")).collect())
    f0 = (10 + 9999 - 9999 + 20) / 4
    assert got == sorted([10.0, 20.0, f0, (30 + f0 - 9999) / 4])


def test_constant_variable(spark):
    df = spark.createDataFrame([("f", "UWIN", 2.0)] * 3, "file string, variable string, value double")
    assert abs(clean.global_stats(df).select(F.col("std")).first()[0] - 0.001) < 1e-12
