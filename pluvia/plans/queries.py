"""Registered queries of the forecast library and their SQL."""
from pyspark.sql import functions as F

from pluvia.functions import scores as S
from pluvia.operators import clean as C
from pluvia.operators import verify as V
from pluvia.sources.views import CELLS_DUCK, PAIRS_SQL, cells_long, pairs, table

Q, SQL = {}, {}
PAIRS_CTE = f"WITH p0 AS ({PAIRS_SQL}), idx AS (SELECT sample_id, CAST((row_number() OVER (ORDER BY sample_id)-1)//8 AS BIGINT) AS batch_id FROM (SELECT DISTINCT sample_id FROM p0)), pairs AS (SELECT p0.*, batch_id FROM p0 JOIN idx USING (sample_id))"
CELLS_CTE = f"WITH cells AS ({CELLS_DUCK})"


def q(name, sql=None):
    def deco(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return deco


def r6(c, name):
    return F.round(c, 6).alias(name)


q("score_rmse", PAIRS_CTE + " SELECT sample_id, round(sqrt(avg((pred-label)*(pred-label))),6) AS rmse FROM pairs GROUP BY 1")(
    lambda s, d: V.sample_scores(pairs(s, d)).select("sample_id", r6(F.col("RMSE"), "rmse")))
q("score_mae", PAIRS_CTE + " SELECT sample_id, round(avg(abs(pred-label)),6) AS mae FROM pairs GROUP BY 1")(
    lambda s, d: V.sample_scores(pairs(s, d)).select("sample_id", r6(F.col("MAE"), "mae")))
CC_SQL = ("CASE WHEN stddev_samp(pred)>1e-12*max(abs(pred)) AND stddev_samp(label)>1e-12*max(abs(label)) "
          "THEN greatest(-1.0,least(1.0,covar_pop(pred,label)/stddev_samp(pred)/stddev_samp(label))) ELSE 0.0 END")
q("score_cc", PAIRS_CTE + f" SELECT sample_id, round({CC_SQL},6) AS cc FROM pairs GROUP BY 1")(
    lambda s, d: V.sample_scores(pairs(s, d)).select("sample_id", r6(F.col("CC"), "cc")))
CONF = ", ".join(f"count(*) FILTER (pred>={t} AND label>={t}) AS h_{k}, count(*) FILTER (NOT pred>={t} AND label>={t}) AS m_{k}, count(*) FILTER "
  f"(pred>={t} AND NOT label>={t}) AS f_{k}, count(*) FILTER (NOT pred>={t} AND NOT label>={t}) AS c_{k}" for k, t in S.THRESHOLDS.items())


def _conf(s, d):
    p, y = F.col("pred"), F.col("label")
    return pairs(s, d).groupBy("sample_id").agg(*[c for k, t in S.THRESHOLDS.items() for c in S.contingency(p, y, t, k)])


q("confusion_matrix", PAIRS_CTE + f" SELECT sample_id, {CONF} FROM pairs GROUP BY 1")(_conf)
W_SQL = "avg(abs(pred-label)*(1+CASE WHEN label>0.1 AND label<=5 THEN 5 WHEN label>5 AND label<=15 THEN 3 WHEN label>15 THEN 2 ELSE 0 END)+(pred-label)*(pred-label)*(1+CASE WHEN label>0.1 AND label<=5 THEN 3 WHEN label>5 AND label<=15 THEN 2 WHEN label>15 THEN 1 ELSE 0 END))"
q("weighted_loss", PAIRS_CTE + f" SELECT batch_id, round({W_SQL},6) AS loss FROM pairs GROUP BY "
  f"1")(lambda s, d: V.weighted_loss(pairs(s, d), "batch_id").select("batch_id", r6(F.col("loss"), "loss")))
q("epoch_loss_train", PAIRS_CTE + f", b AS (SELECT batch_id, {W_SQL} AS loss FROM pairs GROUP BY 1) SELECT round(avg(loss),6) AS loss "
  f"FROM b")(lambda s, d: V.weighted_loss(pairs(s, d), "batch_id").agg(r6(F.avg("loss"), "loss")))
q("file_time_counts", CELLS_CTE + " SELECT file, count(DISTINCT time_idx) AS n_times FROM cells "
  "GROUP BY 1")(lambda s, d: cells_long(s, d).groupBy("file").agg(F.count_distinct("time_idx").alias("n_times")))
q("sentinel_flags", CELLS_CTE + " SELECT event_id, (NOT isnan(value) AND (abs(value-9999)<1e-3 OR abs(value+9999)<1e-3 OR abs(value-999999)<1e-3 "
  "OR abs(value+999999)<1e-3)) AS sentinel FROM cells")(
    lambda s, d: cells_long(s, d).select("event_id", (C.is_sentinel(F.col("value"), 9999.0) | C.is_sentinel(F.col("value"), -9999.0) | C.is_sentinel(F.col("value"), 999999.0) | C.is_sentinel(F.col("value"), -999999.0)).alias("sentinel")))
q("range_violations", CELLS_CTE + " SELECT file, variable, count(*) FILTER (NOT isnan(value) AND CASE variable WHEN 'TAIR' THEN value<0 "
  "WHEN 'UWIN' THEN abs(value)>100 WHEN 'VWIN' THEN abs(value)>100 ELSE value<0 OR value>100 END) AS n_out FROM cells GROUP BY 1,2")(
    lambda s, d: cells_long(s, d).groupBy("file", "variable").agg(F.count_if(C.out_of_range(F.col("value"), F.col("variable"))).alias("n_out")))


q("rain_class", PAIRS_CTE + " SELECT CASE WHEN label>15 THEN 'heavy' WHEN label>5 THEN 'moderate' WHEN label>0.1 THEN 'light' "
  "ELSE 'none' END AS loss_class, CASE WHEN label>=25 THEN 'heavy' WHEN label>=10 THEN 'moderate' WHEN label>=0.1 THEN 'light' "
  "ELSE 'none' END AS score_class, count(*) AS n FROM pairs GROUP BY 1,2")(
    lambda s, d: pairs(s, d).groupBy(S.loss_class(F.col("label")).alias("loss_class"), S.score_class(F.col("label")).alias("score_class")).agg(F.count("*").alias("n")))
