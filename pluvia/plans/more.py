"""Losses, classification scores, splits and report functions."""
from pyspark.sql import functions as F

from pluvia.functions import losses as L
from pluvia.plans.queries import q
from pluvia.sources.views import table

LOGITS = ("WITH l AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding[1:10]] AS z FROM embeddings), n AS (SELECT vec_id, label, "
          "list_max(z) + ln(list_sum([exp(x-list_max(z)) FOR x IN z])) - z[label+1] AS nll, list_position(z, list_max(z)) - 1 AS pred FROM l)")
TASKS = ("WITH z AS (SELECT label, [CAST(x AS DOUBLE) FOR x IN embedding[1:4]] AS z FROM embeddings), t "
  "AS (SELECT 0 AS task, label % 2 AS y, z[1] AS a, z[2] AS b FROM z "
         "UNION ALL SELECT 1, CASE WHEN label>=5 THEN 1 ELSE 0 END, z[3], z[4] FROM z), n AS (SELECT task, y, "
         "greatest(a,b)+ln(exp(a-greatest(a,b))+exp(b-greatest(a,b)))-CASE WHEN y=1 THEN b ELSE a END AS nll FROM t)")


def nll(s, d):
    """vec_id, label, nll, pred (largest logit, lowest index on ties)."""
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(s, d, "embeddings").select("vec_id", "label", z.alias("z"))
    return rows.select("vec_id", "label", L.cross_entropy(F.col("z"), F.col("label")).alias("nll"), (F.array_position("z", F.array_max("z")) - 1).alias("pred"))


def task_logits(s, d):
    """Two tasks of two logits each for every vector."""
    z = [F.element_at("embedding", k).cast("double") for k in (1, 2, 3, 4)]
    return table(s, d, "embeddings").select(F.array(F.array(z[0], z[1]), F.array(z[2], z[3])).alias("logits"), F.array((F.col("label") % 2).cast("int"), (F.col("label") >= 5).cast("int")).alias("y"))


q("loss_cross_entropy", LOGITS + " SELECT round(avg(nll),6) AS loss FROM n")(lambda s, d: nll(s, d).agg(F.round(F.avg("nll"), 6).alias("loss")))
q("loss_multitask_ce", TASKS + ", w AS (SELECT task, sum(CASE WHEN y=1 THEN 2.0 ELSE 1.0 END*nll)/sum(CASE WHEN y=1 THEN 2.0 ELSE 1.0 END) AS l "
  "FROM n GROUP BY 1) SELECT round(sum(l),6) AS loss FROM w")(
    lambda s, d: L.multi_task(task_logits(s, d), ratio=2.0).select(F.round("loss", 6).alias("loss")))
q("loss_focal", LOGITS + " SELECT round(avg(pow(1-exp(-nll),2)*nll),6) AS loss FROM "
  "n")(lambda s, d: L.focal(nll(s, d), gamma=2.0).select(F.round("loss", 6).alias("loss")))
q("loss_focal_alpha_sum", LOGITS + " SELECT round(sum((CASE WHEN label<5 THEN 0.25 ELSE 0.75 END)*pow(1-exp(-nll),1.5)*nll),4) AS loss FROM n")(
    lambda s, d: L.focal(nll(s, d), gamma=1.5, alpha=[0.25] * 5 + [0.75] * 5, mean=False).select(F.round("loss", 4).alias("loss")))


@q("class_confusion", LOGITS + ", c AS (SELECT DISTINCT label AS k FROM n) SELECT k AS class, count(*) FILTER (label=k AND pred=k) AS tp, "
  "count(*) FILTER (label<>k AND pred=k) AS fp, count(*) FILTER (label=k AND pred<>k) AS fn, count(*) FILTER (label<>k AND pred<>k) AS tn "
  "FROM c, n GROUP BY 1")
def _confusion(s, d):
    return L.class_confusion(nll(s, d)).where("tp + fn > 0")


q("format_duration", "SELECT event_id, printf('%2d:%02d', CAST(event_id % 7200 // 60 AS INT), CAST(event_id % 60 AS INT)) AS t FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.format_string("%2d:%02d", F.expr("cast(event_id % 7200 div 60 as "
      "int)"), F.expr("cast(event_id % 60 as int)")).alias("t")))
