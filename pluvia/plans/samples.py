"""Frame and sequence samples, batching, sinks' tables, losses and confusion counts, each with its SQL."""
from pyspark.sql import functions as F

from pluvia import catalog
from pluvia.functions import losses as L
from pluvia.operators import clean as C
from pluvia.operators import verify as V
from pluvia.plans.queries import CELLS_CTE, PAIRS_CTE, W_SQL, q, r6
from pluvia.registry import FORMATTERS, OUTPUTS
from pluvia.sources import sinks
from pluvia.sources.scratch import folder
from pluvia.sources.views import cells_long, pairs, table

VARS = ["TAIR", "UWIN", "VWIN", "PRE", "corrected_precip"]
STEPS, STRIDE = 4, 3
FINITE = "NOT isnan(value) AND NOT isinf(value)"


def finite(v="value"):
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def cells(s, d):
    return cells_long(s, d).select("event_id", "file", "time_idx", "y", "x", "variable", "value")


WIDE = CELLS_CTE + ", wide AS (SELECT file, time_idx, y, x, " + ", ".join(f"round(coalesce(avg(CASE "
  f"WHEN variable='{v}' AND {FINITE} THEN value END),0.0),6) AS {v}" for v in VARS) + " FROM cells GROUP BY 1,2,3,4)"


def wide_cells(long):
    """One row per cell and time; an absent variable is zero."""
    return long.groupBy("file", "time_idx", "y", "x").agg(*[F.round(F.coalesce(F.avg(F.when((F.col("variable") == v) & finite(), F.col("value"))), F.lit(0.0)), 6).alias(v) for v in VARS])


def wide(s, d):
    return wide_cells(cells(s, d))


q("feature_projection", WIDE + f" SELECT file, time_idx, y, x, {', '.join(VARS)} FROM wide")(wide)
q("nonfinite_zero", CELLS_CTE + f" SELECT event_id, CASE WHEN {FINITE} THEN value ELSE 0.0 END AS value FROM cells")(
    lambda s, d: cells(s, d).select("event_id", F.when(finite(), F.col("value")).otherwise(0.0).alias("value")))
q("format_nan_zero", CELLS_CTE + " SELECT event_id, CASE WHEN isnan(value) THEN 0.0 WHEN isinf(value) THEN sign(value)*CAST(3.4028235e38 AS "
  "DOUBLE) ELSE value END AS value FROM cells")(
    lambda s, d: cells(s, d).select("event_id", F.when(F.isnan("value"), 0.0).when(F.abs("value") == float("inf"), F.signum("value") * F.lit(3.4028235e38)).otherwise(F.col("value")).alias("value")))
q("near_zero_flags", CELLS_CTE + " SELECT event_id, NOT isnan(value) AND abs(value)<=1e-8 AS near_zero FROM cells")(
    lambda s, d: cells(s, d).select("event_id", (~F.isnan("value") & (F.abs("value") <= 1e-8)).alias("near_zero")))
q("infer_projection", PAIRS_CTE + " SELECT sample_id, l_orderkey, pred FROM "
  "pairs")(lambda s, d: pairs(s, d).select("sample_id", "l_orderkey", "pred"))


q("epoch_loss_valid", PAIRS_CTE + f", b AS (SELECT batch_id, count(DISTINCT sample_id) AS n, {W_SQL} AS loss FROM pairs GROUP BY 1) "
  f"SELECT round(sum(loss*n)/sum(n),6) AS loss FROM b")(
    lambda s, d: V.weighted_loss(pairs(s, d), "batch_id", size=True).agg(r6(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), "loss")))


q("stats_file_limit", CELLS_CTE + " SELECT variable, count(*) AS n FROM cells WHERE file IN (SELECT DISTINCT file FROM cells ORDER BY 1 LIMIT 50) "
  "GROUP BY 1")(
    lambda s, d: cells(s, d).join(cells(s, d).select("file").distinct().orderBy("file").limit(50), "file", "left_semi").groupBy("variable").agg(F.count("*").alias("n")))


@q("incremental_skip", CELLS_CTE + " SELECT file, count(*) AS n FROM cells WHERE file NOT IN (SELECT file FROM cells "
  "WHERE CAST(substr(file,12,2) AS INT) % 2 = 0) GROUP BY 1")
def _skip(s, d):
    """Even days' files are written first; the second call meets all files and writes the others, as the manifest says."""
    out, rows = folder(s, "processed"), cells(s, d)
    sinks.write_resumable(rows.where("cast(substr(file, 12, 2) as int) % 2 = 0"), lambda c: c, out, "first")
    sinks.write_resumable(rows, lambda c: c, out, "second")
    return sinks.finished(s, out).where("run = 'second'").select("file", F.col("rows").alias("n"))


q("pair_predictions", "WITH a AS (SELECT l_orderkey k, l_linenumber j, CAST(l_quantity AS DOUBLE) AS pred FROM lineitem), b "
  "AS (SELECT l_orderkey k, l_linenumber j, CAST(l_tax AS DOUBLE) AS label FROM lineitem) SELECT a.k AS order_id, round(sum(pred*label),6) AS s, "
  "count(*) AS n FROM a JOIN b ON a.k=b.k AND a.j=b.j GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS j", "cast(l_quantity as double) AS pred").join(
        table(s, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS j", "cast(l_tax as double) AS "
          "label"), ["k", "j"]).groupBy(F.col("k").alias("order_id")).agg(r6(F.sum(F.col("pred") * F.col("label")), "s"), F.count("*").alias("n")))

MULTI = "WITH m AS (SELECT l.quality AS y0, l.toxic AS y1, (n_chars % 97 + 1)/100.0 AS p0, (n_chars % 89 + 1)/100.0 AS p1 FROM labels l JOIN documents d ON l.doc_id=d.doc_id), t AS (SELECT 0 AS task, y0 AS y, CAST(p0 AS DOUBLE) AS p FROM m UNION ALL SELECT 1, y1, CAST(p1 AS DOUBLE) FROM m)"


def tasks(s, d):
    """One row per document and label: task, y, p."""
    m = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    row = lambda k, y, n: F.struct(F.lit(k).alias("task"), F.col(y).alias("y"), ((F.col("n_chars") % n + 1) / F.lit(100.0)).alias("p"))
    return m.select(F.explode(F.array(row(0, "quality", 97), row(1, "toxic", 89))).alias("r")).select("r.*")


def label_arrays(s, d):
    """p and y: probabilities and labels of both tasks for each document."""
    m = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = lambda n: (F.col("n_chars") % n + 1) / F.lit(100.0)
    return m.select(F.array(p(97), p(89)).alias("p"), F.array("quality", "toxic").alias("y"))


q("loss_bce_multilabel", MULTI + " SELECT round(sum(-y*ln(p)-(1-y)*ln(1-p))/(SELECT count(*) FROM m),6) AS loss FROM t")(
    lambda s, d: L.multi_label(label_arrays(s, d)).select(r6(F.col("loss"), "loss")))
q("multilabel_confusion", MULTI + " SELECT task, count(*) FILTER (y=1 AND p>=0.5) AS tp, count(*) FILTER (y=0 AND p>=0.5) AS fp, count(*) FILTER "
  "(y=1 AND p<0.5) AS fn, count(*) FILTER (y=0 AND p<0.5) AS tn FROM t GROUP BY 1")(
    lambda s, d: confusion(s, d))


def confusion(s, d):
    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    return tasks(s, d).groupBy("task").agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))


PRF = ", c AS (SELECT task, count(*) FILTER (y=1 AND p>=0.5) AS tp, count(*) FILTER (y=0 AND p>=0.5) AS fp, count(*) FILTER (y=1 AND p<0.5) AS fn FROM t GROUP BY 1)"
q("prf_micro_macro", MULTI + PRF + " SELECT round(sum(tp)/sum(tp+fp),6) AS micro_p, round(sum(tp)/sum(tp+fn),6) AS micro_r, "
  "round(avg(tp/(tp+fp)),6) AS macro_p, round(avg(tp/(tp+fn)),6) AS macro_r, round(avg(2*tp/(2*tp+fp+fn)),6) AS macro_f1, "
  "round(2*sum(tp)/sum(2*tp+fp+fn),6) AS micro_f1 FROM c")(
    lambda s, d: L.prf(confusion(s, d)).select(*[r6(F.col(c), c) for c in L.PRF]))
q("list_parse", "SELECT doc_id, array_to_string(string_split(replace(lang || ', ' || source, ' ', ''), ','), '|') AS items FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.split(F.replace(F.concat_ws(", ", "lang", "source"), F.lit(" "
      ""), F.lit("")), ","), "|").alias("items")))

# what the registries offer, by name
q("registry_source", CELLS_CTE + " SELECT variable, count(*) AS n FROM cells GROUP BY 1")(
    lambda s, d: kept_source(s, d).groupBy("variable").agg(F.count("*").alias("n")))
q("registry_formatter", CELLS_CTE + " SELECT event_id, CASE WHEN isnan(value) THEN 0.0 WHEN isinf(value) THEN sign(value)*CAST(3.4028235e38 AS "
  "DOUBLE) ELSE value END AS value FROM cells")(
    lambda s, d: FORMATTERS["identity"](FORMATTERS["grid"](cells(s, d).select("event_id", "value", F.lit(1.0).alias("label")), "infer")))
q("registry_output", PAIRS_CTE + ", m AS (SELECT batch_id, avg(v) AS v FROM (SELECT batch_id, sample_id, avg(abs(pred-label)) AS v FROM pairs "
  "GROUP BY 1,2) GROUP BY 1) SELECT 'MAE' AS metric, round(round(avg(v),9),3) AS value FROM m")(
    lambda s, d: OUTPUTS["report"](pairs(s, d)).where("metric = 'MAE'").union(OUTPUTS["null"](pairs(s, d))))


def kept_source(s, d):
    """Cells in Parquet, read by the registered source and kept in memory and on disk; valid falls back on train."""
    out = folder(s, "cells")
    cells(s, d).write.parquet(out)
    return catalog.source(s, {"train": {"type": "parquet", "root": out, "keep": True}, "valid": None}, "valid")


PREDICTED = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 3 AS pred FROM lineitem"


@q("predictions_json", "SELECT '{\"l_linenumber\":' || l_linenumber || ',\"l_orderkey\":' || l_orderkey || ',\"pred\":' || pred || '}' AS line "
  "FROM (" + PREDICTED + ")")
def _predictions(s, d):
    """Predictions as JSON lines with sorted keys."""
    out = folder(s, "predictions")
    sinks.write_predictions(s.sql(PREDICTED.replace("FROM lineitem", "FROM {t}"), t=table(s, d, "lineitem")), out)
    return s.read.text(out).select(F.col("value").alias("line"))
