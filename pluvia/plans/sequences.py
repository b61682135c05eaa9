"""Frame and sequence samples over cells, batches, row numbers and the model jobs."""
from pyspark.sql import functions as F

from pluvia.functions import scores as S
from pluvia.operators import clean as C
from pluvia.operators import correct as M
from pluvia.operators import external
from pluvia.operators import samples as A
from pluvia.plans.chain import CLEAN
from pluvia.plans.queries import PAIRS_CTE, q, r6
from pluvia.plans.samples import WIDE, wide, wide_cells
from pluvia.sources import files as I
from pluvia.sources import sinks
from pluvia.sources.scratch import folder, numbered, written
from pluvia.sources.views import cells_long, pairs, table

TIME = "to_timestamp(concat(substr(file, 6, 8), lpad(time_idx, 2, '0')), 'yyyyMMddHH')"
INDEX = (WIDE + ", fr AS (SELECT DISTINCT file, time_idx, strptime(substr(file,6,8),'%Y%m%d') + time_idx * INTERVAL 1 HOUR AS time FROM wide)"
         ", idx AS (SELECT *, row_number() OVER (ORDER BY time, file, time_idx)-1 AS pos FROM fr), last AS (SELECT max(pos) AS m FROM idx)")


def windows_sql(steps: int, stride: int) -> str:
    return (INDEX + f", w AS (SELECT s.pos AS start, CAST(i.pos-s.pos AS INT) AS step, i.file, i.time_idx FROM idx s "
      f"JOIN idx i ON i.pos BETWEEN s.pos AND s.pos+{steps - 1} "
            f"WHERE s.pos % {stride}=0 AND s.pos<=(SELECT m FROM last)-{steps - 1}), sc AS (SELECT start, step, y, x, TAIR, UWIN, VWIN, PRE, "
            f"corrected_precip FROM w JOIN wide USING (file, time_idx))")


def index(s, d):
    frames = wide(s, d).select("file", "time_idx").distinct().withColumn("time", F.expr(TIME).cast("timestamp_ntz"))
    return A.global_time_index(frames)


def indexed(s, d):
    """Cells, and the index of their frames."""
    cells = written(wide(s, d))
    frames = cells.select("file", "time_idx").distinct().withColumn("time", F.expr(TIME).cast("timestamp_ntz"))
    return cells, written(A.global_time_index(frames))


def sequence(s, d, steps=A.STEPS, stride=A.STRIDE):
    return A.sequence_cells(*indexed(s, d), steps, stride)


SEQ = windows_sql(A.STEPS, A.STRIDE)
q("global_time_index", INDEX + " SELECT file, time_idx, pos FROM idx")(lambda s, d: index(s, d).select("file", "time_idx", "pos"))
q("frame_samples", INDEX + " SELECT pos AS sample_id, file, time_idx FROM idx")(lambda s, d: A.frame_samples(index(s, d)))
q("shuffle_samples", INDEX + " SELECT pos AS sample_id, file, time_idx FROM idx")(lambda s, d: A.shuffled(A.frame_samples(index(s, d)), 7))
q("sequence_samples", SEQ + " SELECT * FROM sc")(sequence)
q("sequence_windows_stride", windows_sql(A.STEPS, A.CODE_STRIDE) + " SELECT start, step, file, time_idx "
  "FROM w")(lambda s, d: A.windows(index(s, d), stride=A.CODE_STRIDE).select("start", "step", "file", "time_idx"))
q("sequence_label", SEQ + " SELECT start, y, x, corrected_precip AS label FROM sc WHERE step=3")(
    lambda s, d: sequence(s, d).where(F.col("step") == A.STEPS - 1).select("start", "y", "x", F.col(A.TARGET).alias("label")))
q("sequence_tensor", SEQ + " SELECT start, y, x, " + ", ".join(f"coalesce(max(CASE WHEN step={k} THEN {v} END),0.0) AS "
  f"{v}_{k}" for k in range(A.STEPS) for v in A.FEATURES)
  + ", coalesce(max(CASE WHEN step=3 THEN corrected_precip END),0.0) AS label FROM sc GROUP BY 1,2,3")(
    lambda s, d: A.stacked(*indexed(s, d)).select("start", "y", "x", *[F.col("data")[k][i].alias(f"{v}_{k}") for k in range(A.STEPS) for i, v in enumerate(A.FEATURES)], "label"))

TENSOR = SEQ + ", st AS (SELECT start, y, x, " + ", ".join(f"coalesce(max(CASE WHEN step={k} THEN PRE END),0.0) AS "
  f"p{k}" for k in range(A.STEPS)) + " FROM sc GROUP BY 1,2,3)"
TREND = (0.1, 0.2, 0.3, 0.4)   # weights of the four steps' precipitation


def trend():
    """A model in numpy: the weighted mean of the steps' precipitation."""
    import numpy as np
    return lambda x: x[:, :, A.FEATURES.index("PRE")] @ np.array(TREND)


@q("external_predictions", TENSOR + " SELECT start, y, x, round(" + "+".join(f"{w}*p{k}" for k, w in enumerate(TREND)) + ",4) AS pred FROM st")
def _external(s, d):
    """Predictions of a numpy model over the arrays of sequence samples, written as JSON and read again."""
    out = folder(s, "predictions")
    sinks.write_predictions(external.predict(A.stacked(*indexed(s, d)).drop("label"), trend, A.STEPS, len(A.FEATURES)), out)
    return s.read.schema("start long, y int, x int, pred double").json(out).select("start", "y", "x", F.round("pred", 4).alias("pred"))


@q("epoch_order", INDEX + ", n AS (SELECT CAST(m+1 AS BIGINT) AS n FROM last), e AS (SELECT unnest([0,1]) AS epoch), b "
  "AS (SELECT epoch, CAST(unnest(range(n//8)) AS BIGINT) AS batch_id FROM e, n) SELECT epoch, batch_id, 8 AS n, CAST(28+64*batch_id AS BIGINT) AS "
  "places FROM b")
def _epochs(s, d):
    """Two epochs' batches of eight: each holds eight samples, at eight places that follow each other."""
    samples = A.frame_samples(index(s, d))
    total = samples.count()
    epochs = [A.epoch_batches(samples, total, 8, seed).withColumn("epoch", F.lit(seed)) for seed in (0, 1)]
    return epochs[0].union(epochs[1]).groupBy("epoch", "batch_id").agg(F.count_distinct("sample_id").cast("int").alias("n"), F.sum("place").alias("places"))


BATCH = PAIRS_CTE + ", n AS (SELECT DISTINCT sample_id FROM pairs), k AS (SELECT sample_id, CAST((row_number() OVER (ORDER BY sample_id)-1)//6 AS BIGINT) AS batch_id FROM n)"
q("batch_assign", BATCH + " SELECT * FROM k WHERE batch_id IN (SELECT batch_id FROM k GROUP BY 1 HAVING "
  "count(*)=6)")(lambda s, d: A.batches(pairs(s, d).select("sample_id").distinct(), 6))
q("batch_assign_test", BATCH + " SELECT * FROM k")(lambda s, d: A.batches(pairs(s, d).select("sample_id").distinct(), 6, "test"))

FILES = "WITH c AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY 1), iv AS (SELECT file, n, CAST(sum(n) OVER (ORDER BY file) AS BIGINT)-n AS lo, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS hi FROM c)"


def by_file(s, d):
    return table(s, d, "documents").select("doc_id", F.col("source").alias("file"))


q("file_prefix_counts", FILES + " SELECT file, n, lo, hi FROM iv")(lambda s, d: A.prefix_counts(by_file(s, d)))


def json_files(s, d):
    """Files of JSON lines by source and part, lines by doc_id."""
    out = folder(s, "json")
    rows = table(s, d, "documents").select("doc_id", "text", "source", F.format_string("%06d", F.expr("doc_id div 5000")).alias("part"))
    rows.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").write.partitionBy("source", "part").json(out)
    return out


def source_of(name):
    return F.regexp_extract("file", "source=([^/]*)/", 1).alias(name)


@q("global_row_number", "SELECT doc_id, source AS file, row_number() OVER (ORDER BY source, doc_id)-1 AS row FROM documents")
def _rows(s, d):
    return I.line_rows(s, f"{json_files(s, d)}/*/*", "doc_id long").select("doc_id", source_of("file"), "row")


@q("line_counts", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def _line_counts(s, d):
    return I.line_counts(s, f"{json_files(s, d)}/*/*").groupBy(source_of("source")).agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))


q("row_to_file_range_join", FILES + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id)-1 AS row FROM documents) "
  "SELECT doc_id, row, file FROM r JOIN iv ON row>=lo AND row<hi")(
    lambda s, d: A.rows_to_files(numbered(by_file(s, d), "file", "doc_id", name="row").select("doc_id", "row"), A.prefix_counts(by_file(s, d)).select("file", "lo", "hi")))


# model jobs
def split(rows, name):
    day = F.substring("file", 12, 2).cast("int")
    return rows.where({"train": day <= 20, "valid": day.between(21, 25), "test": day > 25}[name])


def cleaned(s, d):
    """Cells by their cleaned variables, not normalised."""
    return wide_cells(C.clean(cells_long(s, d)))


def fitted(s, d, kind="linear"):
    """Cleaned cells and a model that was saved and loaded again."""
    rows, out = written(cleaned(s, d)), folder(s, "model")
    M.save(M.MODELS[kind](split(rows, "train")), out)
    return rows, M.load(out)


@q("fit_correction")
def _fit(s, d):
    """feature, weight, of the linear correction; the intercept has no feature."""
    m = fitted(s, d)[1].stages[-1]
    return s.createDataFrame([*zip(A.FEATURES, map(float, m.coefficients)), ("intercept", float(m.intercept))], "feature string, weight double")


DAY = "CAST(substr(file,12,2) AS INT)"
CLEANED = CLEAN + ", cw AS (SELECT file, time_idx, y, x, " + ", ".join(f"coalesce(avg(CASE "
  f"WHEN variable='{v}' THEN value END),0.0) AS {v}" for v in [*A.FEATURES, A.TARGET]) + " FROM cleaned GROUP BY 1,2,3,4)"


@q("fit_correction_optimum", CLEANED + f" SELECT unnest(['TAIR','UWIN','VWIN','PRE','intercept']) AS feature, CAST(0.0 AS DOUBLE) AS slope, n "
  f"FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM cw WHERE {DAY}<=20)")
def _optimum(s, d):
    """At the least weighted squared error its slope along each weight is zero; it is shown as a share of what its terms sum
    to without their signs."""
    rows, m = fitted(s, d)
    got = M.predict(m, split(rows, "train"))
    step = S.squared_weight(F.col(A.TARGET)) * (F.col("pred") - F.col(A.TARGET))
    slope = lambda x: F.abs(F.round(F.coalesce(F.try_divide(F.sum(step * x), F.sum(F.abs(step * x))), F.lit(0.0)), 6))
    one = got.agg(*[slope(F.col(f)).alias(f) for f in A.FEATURES], slope(F.lit(1.0)).alias("intercept"), F.count("*").alias("n"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("slope")) for f in [*A.FEATURES, "intercept"]])).alias("r"), "n").select("r.*", "n")


@q("fit_correction_combined")
def _combined(s, d):
    """feature, weight, of the linear correction with the least combined loss, and that loss."""
    w, b, loss = M.combined_weights(split(cleaned(s, d), "train"))
    return s.createDataFrame([*zip(A.FEATURES, map(float, w)), ("intercept", b), ("loss", loss)], "feature string, weight double")


@q("fit_correction_seq")
def _fit_seq(s, d):
    """The test split's predictions by a model of the last four places of each cell."""
    cells = written(cleaned(s, d))
    frames = cells.select("file", "time_idx").distinct().withColumn("time", F.expr(TIME).cast("timestamp_ntz"))
    rows, names = M.lagged(cells.join(A.global_time_index(frames).select("file", "time_idx", "pos"), ["file", "time_idx"]), A.STEPS)
    rows = written(rows)
    return M.predict(M.fit_linear(split(rows, "train"), names), split(rows, "test"), non_negative=True).select("file", "time_idx", "y", "x", r6(F.col("pred"), "pred"))


@q("validate_correction")
def _validate(s, d):
    rows, m = fitted(s, d)
    return M.validate(m, split(rows, "valid"), F.col("file"), F.concat_ws("-", "file", "time_idx"))


@q("test_predictions")
def _predictions(s, d):
    """Predictions of the test split, written as JSON with sorted keys and read again."""
    rows, m = fitted(s, d, "trees")
    out = folder(s, "predictions")
    sinks.write_predictions(M.predict(m, split(rows, "test"), non_negative=True).select("file", "time_idx", "y", "x", "pred"), out)
    return s.read.schema("file string, pred double, time_idx int, x int, y int").json(out)
