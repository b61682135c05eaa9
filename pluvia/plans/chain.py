"""Cleaning chain and verification scores, each with its SQL."""
from pyspark.sql import functions as F

from pluvia import catalog
from pluvia.functions import scores as S
from pluvia.operators import clean as C
from pluvia.operators import verify as V
from pluvia.plans.queries import CC_SQL, CELLS_CTE, CONF, PAIRS_CTE, q, r6
from pluvia.sources import sinks
from pluvia.sources.scratch import folder, written
from pluvia.sources.views import cells_long, pairs

PRECIP = "variable IN ('PRE','corrected_precip')"
SENTINELS = ("9999", "-9999", "999999", "-999999")


def hit(k: int) -> str:
    return f"(NOT isnan(value) AND abs(value-({SENTINELS[k]}))<1e-3)"


def step(k: int) -> str:
    """One sentinel's fill value, and the sum that the next one sees."""
    return (f", f{k} AS (SELECT *, CASE WHEN {PRECIP} THEN 0.0 ELSE s/nullif(n,0) END AS v{k} FROM t{k}), "
            f"t{k + 1} AS (SELECT * EXCLUDE (s), CASE WHEN c{k}>0 THEN s-q{k}+c{k}*v{k} ELSE s END AS s FROM f{k})")


FILL = (CELLS_CTE + ", t0 AS (SELECT file, variable, sum(value) FILTER (NOT isnan(value)) AS s, count(*) FILTER (NOT isnan(value)) AS n, "
        + ", ".join(f"count(*) FILTER ({hit(k)}) AS c{k}, coalesce(sum(value) FILTER ({hit(k)}),0) AS q{k}" for k in range(4))
        + " FROM cells GROUP BY 1,2)" + "".join(step(k) for k in range(4))
        + ", filled AS (SELECT c.* EXCLUDE (value), CASE " + " ".join(f"WHEN {hit(k)} THEN v{k}" for k in range(4)) + " ELSE value END AS value "
          "FROM cells c JOIN t4 USING (file, variable))")
OUT = "CASE variable WHEN 'TAIR' THEN value<0 WHEN 'UWIN' THEN abs(value)>100 WHEN 'VWIN' THEN abs(value)>100 ELSE value<0 OR value>100 END"
CLEAN = (FILL + f", ranged AS (SELECT * REPLACE (CASE WHEN NOT isnan(value) AND {OUT} THEN 0.0 ELSE value END AS value) FROM filled)"
         f", logged AS (SELECT * REPLACE (CASE WHEN {PRECIP} THEN ln(1+value) ELSE value END AS value) FROM ranged)"
         ", cleaned AS (SELECT * REPLACE (CASE WHEN isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS value) FROM logged)")
STATS = (CLEAN + f", st AS (SELECT variable, count(v) AS n, sum(v) AS s, sum(v*v) AS q FROM (SELECT variable, CASE "
  f"WHEN NOT {PRECIP} OR abs(value)>1e-8 THEN value END AS v "
         "FROM cleaned WHERE file IN (SELECT DISTINCT file FROM cleaned ORDER BY 1 LIMIT 50)) GROUP BY 1)"
         ", stats AS (SELECT variable, n, coalesce(s/nullif(n,0),0.0) AS mean, CASE WHEN n>0 THEN sqrt(greatest(q/n-(s/n)*(s/n),1e-6)) "
         "ELSE 1.0 END AS std FROM st)")
NORMAL = STATS + " SELECT event_id, file, variable, round((value-mean)/std,4) AS value FROM cleaned JOIN stats USING (variable)"
KEYS = ("event_id", "file", "variable")


def shown(c, digits=6):
    """NaN as null, so that results can be compared."""
    return F.when(~F.isnan(c), F.round(c, digits))


q("sentinel_fill", FILL + " SELECT event_id, CASE WHEN NOT isnan(value) THEN round(value,6) END AS value FROM filled")(
    lambda s, d: C.sentinel_fill(cells_long(s, d)).select("event_id", shown(F.col("value")).alias("value")))
q("clean_cells", CLEAN + " SELECT event_id, round(value,6) AS value FROM cleaned")(
    lambda s, d: C.clean(cells_long(s, d)).select("event_id", r6(F.col("value"), "value")))
q("global_stats", STATS + " SELECT variable, n, round(mean,6) AS mean, round(std,4) AS std FROM stats")(
    lambda s, d: C.global_stats(C.clean(cells_long(s, d))).select("variable", "n", r6(F.col("mean"), "mean"), F.round("std", 4).alias("std")))
q("zscore_normalize", NORMAL)(lambda s, d: C.preprocess(cells_long(s, d)).select(*KEYS, F.round("value", 4).alias("value")))
q("stats_wide", STATS + " SELECT " + ", ".join(f"round(max(CASE WHEN variable='{v}' THEN {c} END),4) AS "
  f"{v}_{c}" for v in C.LIMITS for c in ("mean", "std")) + " FROM stats")(
    lambda s, d: C.wide_stats(C.global_stats(C.clean(cells_long(s, d)))).select(*[F.round(f"{v}_{c}", 4).alias(f"{v}_{c}") for v in C.LIMITS for c in ("mean", "std")]))


@q("stats_by_file", STATS + " SELECT variable, n, round(mean,6) AS mean, round(std,4) AS std FROM stats")
def _by_file(s, d):
    """Moments of the first fifteen days' files are kept, then those of later files beside them; the statistics are written
    and read, their counts come from the moments."""
    out, day = folder(s, "moments"), F.substring("file", 12, 2).cast("int")
    for part in (day <= 15, day > 15):
        sinks.add_moments(C.file_moments(C.clean(cells_long(s, d).where(part))), out)
    stats = C.stats_of(sinks.read_moments(s, out))
    sinks.write_stats(stats, f"{out}-stats")
    return sinks.read_stats(s, f"{out}-stats").join(stats.select("variable", "n"), "variable").select("variable", "n", r6(F.col("mean"), "mean"), F.round("std", 4).alias("std"))


@q("preprocess_resumed", NORMAL)
def _resumed(s, d):
    """Files are written in waves of eight; the first call ends after two of them, a later one does what is left."""
    out, cells = folder(s, "processed"), cells_long(s, d)
    stats = written(C.global_stats(C.clean(cells)))
    process = lambda c: C.zscore(C.clean(c), stats)
    sinks.write_resumable(cells, process, out, "first", 8, waves=2)
    sinks.write_resumable(cells, process, out, "second", 8)
    return sinks.read_processed(s, out).select("event_id", F.col("file").cast("string").alias("file"), "variable", F.round("value", 4).alias("value"))


@q("preprocess_full", NORMAL)
def _full(s, d):
    """Processed grids are written by file and read again."""
    out = folder(s, "processed")
    sinks.write_processed(C.preprocess(cells_long(s, d)), out)
    return sinks.read_processed(s, out).select("event_id", F.col("file").cast("string").alias("file"), "variable", F.round("value", 4).alias("value"))


q("range_zero", CELLS_CTE + f" SELECT event_id, CASE WHEN isnan(value) THEN NULL WHEN {OUT} THEN 0.0 ELSE value END AS value FROM cells")(
    lambda s, d: C.range_zero(cells_long(s, d), C.limits_table(s)).select("event_id", F.when(~F.isnan("value"), F.col("value")).alias("value")))
q("log1p_precip", CELLS_CTE + f" SELECT event_id, CASE WHEN isnan(value) OR value<=-1 THEN NULL ELSE round(ln(1+value),6) END AS value FROM cells "
  f"WHERE {PRECIP}")(
    lambda s, d: cells_long(s, d).where(F.col("variable").isin(*C.PRECIP)).select("event_id", F.when(~F.isnan("value") & (F.col("value") > -1), F.round(F.log1p("value"), 6)).alias("value")))
q("file_nanmean", CELLS_CTE + " SELECT file, variable, round(avg(value) FILTER (NOT isnan(value)),6) AS mean FROM cells GROUP BY 1,2")(
    lambda s, d: cells_long(s, d).groupBy("file", "variable").agg(r6(F.avg(F.when(~F.isnan("value"), F.col("value"))), "mean")))

# scores: every threshold, and the batch and final means of all sixteen
FORMS = {"pod": ("CASE WHEN h+m>0 THEN h/(h+m) ELSE 1.0 END", lambda h, m, f: S.pod(h, m)), "far": ("CASE WHEN h+f>0 THEN f/(h+f) "
  "ELSE 1.0 END", lambda h, m, f: S.far(h, f)),
         "ts": ("CASE WHEN h+m+f>0 THEN h/(h+m+f) ELSE 1.0 END", S.ts), "est": ("CASE WHEN h+m+f>0 THEN h/(h+m+f) ELSE 1.0 END", S.ts),
         "mar": ("CASE WHEN h+m>0 THEN m/(h+m) ELSE 1.0 END", lambda h, m, f: S.mar(h, m)),
         "bias": ("CASE WHEN h+m>0 THEN (h+f)/(h+m) WHEN h+f>0 THEN CAST('Infinity' AS DOUBLE) ELSE 1.0 END", S.bias)}


def named(sql: str, t: str) -> str:
    """The formula over the counts of one threshold."""
    return "".join(f"{c}_{t}" if c in "hmf" and not (sql[i - 1:i].isalpha() or sql[i + 1:i + 2].isalpha()) else c for i, c in enumerate(sql))


for _k, (_sql, _f) in FORMS.items():
    q(f"score_{_k}", PAIRS_CTE + f", c AS (SELECT sample_id, {CONF} FROM pairs GROUP BY 1) "
      f"SELECT sample_id, " + ", ".join(f"round({named(_sql, t)},6) AS {_k}_{t}" for t in S.THRESHOLDS) + " FROM c")(
        lambda s, d, _k=_k, _f=_f: V.counts(pairs(s, d)).select("sample_id", *[r6(_f(*(F.col(f"{x}_{t}") for x in "hmf")), f"{_k}_{t}") for t in S.THRESHOLDS]))


def part(num: str, den: str) -> str:
    return f"CASE WHEN abs({den})<1e-8 THEN CASE WHEN abs({num})<1e-8 THEN 1.0 ELSE 0.0 END ELSE ({num})/({den}) END"


KGE_SQL = f"CASE WHEN n=1 THEN 1.0 ELSE greatest(-1.0,least(1.0,1-sqrt((CC-1)*(CC-1)+power({part('sp', 'sy')}-1,2)+power({part('mp', 'my')}-1,2)))) END"
SCORES = (PAIRS_CTE + f", a AS (SELECT batch_id, sample_id, count(*) AS n, sqrt(avg((pred-label)*(pred-label))) AS RMSE, avg(abs(pred-label)) AS "
  f"MAE, {CC_SQL} AS CC, "
          f"stddev_samp(pred) AS sp, stddev_samp(label) AS sy, avg(pred) AS mp, avg(label) AS my, {CONF} FROM pairs GROUP BY 1,2)"
          f", scores AS (SELECT batch_id, sample_id, RMSE, MAE, CC, {KGE_SQL} AS KGE, "
          + ", ".join(f"{named(FORMS[m.lower()][0], t)} AS {m}_{t}_rain" for t in S.THRESHOLDS for m in ("POD", "FAR", "TS", "BIAS")) + " FROM a)")
BATCH = SCORES + ", b AS (SELECT batch_id, " + ", ".join(f"avg({m}) AS {m}" for m in S.METRICS) + " FROM scores GROUP BY 1)"
REPORT = BATCH + ", r AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(round(avg({m}),9),3) AS value FROM b" for m in S.METRICS) + ")"
q("score_kge", SCORES + " SELECT sample_id, round(KGE,6) AS kge FROM "
  "scores")(lambda s, d: V.sample_scores(pairs(s, d)).select("sample_id", r6(F.col("KGE"), "kge")))
q("batch_scores", BATCH + " SELECT batch_id, " + ", ".join(f"round({m},6) AS {m}" for m in S.METRICS) + " FROM b")(
    lambda s, d: V.batch_scores(pairs(s, d)).select("batch_id", *[r6(F.col(m), m) for m in S.METRICS]))
q("metric_report", REPORT + ", md AS (SELECT batch_id, avg(m) AS m FROM (SELECT batch_id, sample_id, median(abs(pred-label)) AS m FROM pairs "
  "GROUP BY 1,2) GROUP BY 1) SELECT * FROM r UNION ALL SELECT 'MEDAE', round(round(avg(m),9),3) FROM md")(
    lambda s, d: catalog.metric_report(pairs(s, d), catalog.SIXTEEN | {"MEDAE": ("MEDAE", None)}))
q("verification_report", REPORT + " SELECT * FROM r")(lambda s, d: V.verification_report(pairs(s, d)))
