"""File sources, text functions, reports and streams over data that Spark derives from the given tables."""
from pyspark.sql import functions as F

from pluvia import catalog
from pluvia.functions import scores as S
from pluvia.functions import text as X
from pluvia.operators import clean as C
from pluvia.operators import verify as V
from pluvia.plans.chain import BATCH, KEYS, NORMAL, SCORES
from pluvia.plans.queries import CELLS_CTE, q, r6
from pluvia.plans.samples import VARS, WIDE, wide
from pluvia.plans.sequences import TIME
from pluvia.sources import files as I
from pluvia.sources import grid as G
from pluvia.sources import sinks
from pluvia.sources.scratch import folder, written
from pluvia.sources.views import cells_long, pairs, table
from pluvia.streaming import preprocess, scores

RECORD = "doc_id long, text string, label int"
TEXTS = "SELECT doc_id, text, quality AS label FROM documents LEFT JOIN labels USING (doc_id)"


def texts(s, d):
    return table(s, d, "documents").select("doc_id", "text", "source").join(table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id", "left")


@q("json_lines_scan", TEXTS)
def _lines(s, d):
    out = folder(s, "lines")
    texts(s, d).write.partitionBy("source").json(out)
    return I.json_lines(s, f"{out}/*", RECORD)


@q("json_array_scan", TEXTS)
def _arrays(s, d):
    """Files of one array of at most 200 records each."""
    out = folder(s, "arrays")
    part = F.floor(F.col("doc_id") / 200)
    rows = texts(s, d).groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "label"))).alias("value"))
    rows.repartition(F.col("part")).write.partitionBy("part").text(out)
    return I.json_arrays(s, f"{out}/*", RECORD)


def tree(s, d):
    """A folder of folders with one file for each text's language and source."""
    out = folder(s, "tree")
    table(s, d, "documents").select("lang", "source", F.col("doc_id").cast("string")).repartition("lang", "source").write.partitionBy("lang", "source").text(out)
    return out


def inside(df, root):
    return df.select(F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/[^/]*$", 1).alias("lang"), F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/[^/]*$", 2).alias("source"))


@q("file_listing_recursive", "SELECT DISTINCT lang, source FROM documents")
def _listing(s, d):
    out = tree(s, d)
    return inside(I.file_listing(s, out, pattern="part-*"), out)


@q("file_listing_multi_root", "SELECT DISTINCT lang, source FROM documents WHERE lang IN ('de','en') UNION ALL SELECT DISTINCT lang, source "
  "FROM documents WHERE lang='en'")
def _roots(s, d):
    out = tree(s, d)
    return inside(I.multi_root_listing(s, f"{out}/lang=en, {out}/lang=de,{out}/lang=en").where("path LIKE '%/part-%'"), out)


HOURS = 6   # frames of a grid file
NAME = f"replace(file,'.nc','') || '-' || (time_idx//{HOURS}) || '.npz'"
HOURLY = "replace(file,'.nc','') || '-' || lpad(CAST(time_idx AS VARCHAR),2,'0') || '.npz'"
DAY = "CAST(substr(file,12,2) AS INT)"


def encoded(rows, hours=HOURS):
    """name, content: a grid file of the points of so many frames each, of which each has as many cells as the grid at most.
    Names end with the file's place in its day, all in as many digits as the last one's."""
    digits = len(str((24 - 1) // hours))

    def encode(key, pdf):
        import pandas as pd
        frame = pdf.sort_values(["time_idx", "y", "x"])
        arrays = {c: frame[c].to_numpy(dtype="datetime64[us]" if c == "time" else None) for c in ("time_idx", "time", "y", "x", *VARS)}
        return pd.DataFrame({"name": [f"{key[0][:-3]}-{key[1]:0{digits}}.npz"], "content": [G.encode(arrays)]})
    return rows.withColumn("time", F.expr(TIME).cast("timestamp_ntz")).groupBy("file", F.expr(f"time_idx div "
      f"{hours}")).applyInPandas(encode, "name string, content binary")


def grids(s, d, hours=HOURS):
    """A folder of grid files, written by Spark's tasks."""
    out = folder(s, "grids")
    sinks.write_files(encoded(wide(s, d), hours), out)
    return out


@q("grid_file_listing", CELLS_CTE + f" SELECT DISTINCT {HOURLY} AS path FROM cells")
def _grid_listing(s, d):
    """A file for each hour."""
    return I.file_listing(s, grids(s, d, 1), False, "*.npz").select(F.substring_index("path", "/", -1).alias("path")).orderBy("path")


q("grid_decode_npz", WIDE + f" SELECT {NAME} AS file, time_idx, y, x, {', '.join(VARS)} FROM wide")(
    lambda s, d: G.good_cells(G.scan(s, grids(s, d))).select("file", "time_idx", "y", "x", *VARS))


@q("grid_time_slice", WIDE + f" SELECT {NAME} AS file, time_idx, y, x, TAIR, PRE FROM wide "
  f"WHERE {DAY}=7 AND time_idx BETWEEN 5 AND 17 OR {DAY}=8 AND time_idx=0")
def _grid_slice(s, d):
    """Two variables over two stretches of time; other files are opened for their headers alone."""
    root = grids(s, d)
    parts = [G.scan(s, root, variables=["TAIR", "PRE"], since=a, until=z) for a, z in (("2024-01-07T05:00", "2024-01-07T17:00"), ("2024-01-08T00:00", "2024-01-08T00:59"))]
    return G.good_cells(parts[0].union(parts[1])).select("file", "time_idx", "y", "x", "TAIR", "PRE")


@q("bad_file_quarantine", CELLS_CTE + f", f AS (SELECT DISTINCT {HOURLY} AS file, time_idx FROM cells) SELECT file FROM f WHERE time_idx % 7=0")
def _bad(s, d):
    """Every seventh hour's file of a day has lost its end."""
    out, hour = folder(s, "grids"), F.regexp_extract("name", r"-(\d+)\.npz$", 1).cast("int")
    files = encoded(wide(s, d), 1).select("name", F.when(hour % 7 == 0, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")).alias("content"))
    sinks.write_files(files, out)
    return G.bad_files(G.scan(s, out)).select("file")


@q("split_scan", WIDE + f", n AS (SELECT CASE WHEN {DAY}<=20 THEN 'train' ELSE 'valid' END AS split, count(*) AS n FROM wide WHERE {DAY}<=25 "
  f"GROUP BY 1) SELECT split, n FROM n UNION ALL SELECT 'test', n FROM n WHERE split='train'")
def _splits(s, d):
    """Each split has a folder of grid files; test names none of its own and takes that of train."""
    base, rows, specs = folder(s, "splits"), written(wide(s, d)), {}
    for name, (a, z) in {"train": (1, 20), "valid": (21, 25)}.items():
        sinks.write_files(encoded(rows.where(F.substring("file", 12, 2).cast("int").between(a, z))), f"{base}/{name}")
        specs[name] = {"type": "grid", "root": f"{base}/{name}", "variables": ["PRE"]}
    count = lambda m: catalog.source(s, specs, m).agg(F.lit(m).alias("split"), F.count("*").alias("n"))
    return count("train").union(count("valid")).union(count("test"))


@q("image_manifest_join", "SELECT 'page-' || (doc_id*2) AS path, lang AS label, octet_length(encode(html)) AS bytes FROM documents LEFT "
  "JOIN pages ON page_id=doc_id*2")
def _manifest(s, d):
    """Manifest files and image files are written, then read; half of the manifest's images don't exist."""
    base = folder(s, "images")
    images = table(s, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), F.encode("html", "UTF-8").alias("content"))
    sinks.write_files(images, f"{base}/img")
    rows = table(s, d, "documents").select(F.concat(F.lit("page-"), F.col("doc_id") * 2).alias("path"), F.col("lang").alias("label"), F.floor(F.col("doc_id") / 200).alias("part"))
    rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("path", "label"))).alias("value")).repartition("part").write.partitionBy("part").text(f"{base}/manifest")  # 200 a file
    got = catalog.source(s, {"train": {"type": "images", "manifests": f"{base}/manifest/*", "prefix": f"{base}/img"}}, "train")
    return got.select("path", "label", F.octet_length("content").cast("long").alias("bytes"))


@q("json_lines_malformed", "SELECT doc_id % 10 = 3 AS bad, count(*) AS n, count(CASE WHEN doc_id % 10 <> 3 THEN doc_id END) AS ids FROM documents "
  "GROUP BY 1")
def _malformed(s, d):
    """Every tenth line has lost its second half."""
    out = folder(s, "lines")
    line = F.to_json(F.struct("doc_id", "lang", "source"))
    half = F.when(F.col("doc_id") % 10 == 3, F.substr(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    table(s, d, "documents").select(half.alias("value")).write.text(out)
    got = I.json_lines(s, out, "doc_id long, lang string, source string", malformed=True)
    return got.groupBy(F.col("malformed").isNotNull().alias("bad")).agg(F.count("*").alias("n"), F.count(F.when(F.col("malformed").isNull(), F.col("doc_id"))).alias("ids"))


# cleaning and samples whose definition has a default for what is absent
LONG = WIDE + f", l AS (UNPIVOT wide ON {', '.join(VARS)} INTO NAME variable VALUE value)"
q("missing_variable_zero", LONG + " SELECT file, time_idx, y, x, variable, value FROM "
  "l")(lambda s, d: wide(s, d).unpivot(["file", "time_idx", "y", "x"], VARS, "variable", "value"))
SHOWN = "CASE WHEN {n}=0 THEN 'all_nan' WHEN isinf({v}) THEN 'Infinity' ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END"
LEAST, MOST = "min(pred) FILTER (NOT isnan(pred))", "max(pred) FILTER (NOT isnan(pred))"
ERRORS = ("WITH p AS (SELECT CAST(l_shipdate AS DATE) AS sample_id, CASE WHEN l_orderkey % 997=0 THEN CAST('NaN' AS DOUBLE) "
  "WHEN l_orderkey % 991=0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS pred, CAST(l_linenumber AS DOUBLE) AS label "
  "FROM lineitem), "
          "a AS (SELECT sample_id, count(*) AS n, count(*) FILTER (isnan(pred)) AS nan_, count(*) FILTER (isinf(pred)) AS inf_, count(*) FILTER "
          "(NOT isnan(pred)) AS m, " + LEAST + " AS lo, " + MOST + " AS hi, "
          "min(CASE WHEN isnan(pred) OR isinf(pred) THEN 0.0 ELSE pred END) AS clo, CAST(min(label) AS BIGINT) AS label_min, CAST(max(label) AS "
          "BIGINT) AS label_max FROM p GROUP BY 1)")


@q("error_samples", ERRORS + " SELECT sample_id, 'nan_inf_values' AS error, nan_>0 AS has_nan, inf_>0 AS has_inf, "
  "" + SHOWN.format(n="m", v="lo") + " AS lo, " + SHOWN.format(n="m", v="hi") + " AS hi, label_min, label_max, CAST(n AS BIGINT) AS n_cells "
  "FROM a WHERE nan_+inf_>0 "
   "UNION ALL SELECT sample_id, 'nan_std', false, false, " + SHOWN.format(n="1", v="clo") + ", " + SHOWN.format(n="1", v="clo") + ", label_min, "
   "label_max, CAST(n AS BIGINT) FROM a WHERE n=1")
def _errors(s, d):
    """Samples in error and their cells, written and read again."""
    key, out = F.col("l_orderkey"), folder(s, "errors")
    rows = table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("sample_id"), F.when(key % 997 == 0, float("nan")).when(key % 991 == 0, float("inf")).otherwise(F.col("l_quantity").cast("double")).alias("pred"), F.col("l_linenumber").cast("double").alias("label"))
    errors = written(V.error_samples(rows))
    sinks.write_errors(errors, V.error_values(rows, errors), out)
    shown = lambda c: F.when(F.col(c).isNull(), "all_nan").when(F.col(c) == float("inf"), "Infinity").otherwise(F.col(c).cast("long").cast("string"))
    cells = s.read.parquet(f"{out}/values").groupBy("sample_id", "error").agg(F.count("*").alias("n_cells"))
    got = s.read.parquet(f"{out}/summary").join(cells, ["sample_id", "error"])
    return got.select("sample_id", F.col("error").cast("string").alias("error"), F.col("pred_contains_nan").alias("has_nan"), F.col("pred_contains_inf").alias("has_inf"), shown("pred_min").alias("lo"), shown("pred_max").alias("hi"),
                      F.col("label_min").cast("long").alias("label_min"), F.col("label_max").cast("long").alias("label_max"), "n_cells")


# metric history, reports
HISTORY = (BATCH + ", h AS (" + " UNION ALL ".join(f"SELECT 'step' AS granularity, '{m}' AS tag, batch_id AS step, round({m},6) AS value "
  f"FROM b" for m in S.METRICS)
           + " UNION ALL " + " UNION ALL ".join(f"SELECT 'epoch' AS granularity, '{m}' AS tag, 0 AS step, round(avg({m}),6) AS value "
             f"FROM b" for m in S.METRICS) + ")")


def history(s, d):
    """Scores of every batch, and their means as those of the epoch."""
    b = written(V.batch_scores(pairs(s, d)))
    every = sinks.history_rows(b, "batch_id", S.METRICS, "run", "valid", "step")
    means = b.agg(*[F.avg(m).alias(m) for m in S.METRICS]).withColumn("epoch", F.lit(0))
    return every.union(sinks.history_rows(means, "epoch", S.METRICS, "run", "valid", "epoch")).withColumn("value", F.round("value", 6))


@q("metric_history_long", HISTORY + " SELECT 'run' AS run, 'valid' AS split, granularity, tag, step, value FROM h")
def _history(s, d):
    out = folder(s, "history")
    sinks.write_history(history(s, d), out)
    return s.read.parquet(out).select(F.col("run").cast("string"), F.col("split").cast("string"), "granularity", "tag", "step", "value")


q("metric_decimation", HISTORY + " SELECT tag, step, value FROM h WHERE granularity='step' AND (step+1) % "
  "10=0")(lambda s, d: history(s, d).where("granularity = 'step' AND (step + 1) % 10 = 0").select("tag", "step", "value"))
q("metric_display", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{X.DISPLAY.get(m, m)}')" for m in S.METRICS) + ") v(tag, shown) "
  "WHERE (SELECT count(*) FROM lineitem)>0")(
    lambda s, d: history(s, d).select("tag").distinct().select("tag", X.display_tag(F.col("tag")).alias("shown")))
FIELDS = ["CAST(step AS VARCHAR)", "'valid'", *[f"CAST(round(round({m},9),3) AS VARCHAR)" for m in ("RMSE", "MAE", "TS")]]


def line_sql(fields):
    line = "''"
    for f, end in zip(fields, X.COLUMNS):
        line = f"({line} || {f})"
        line = f"(CASE WHEN length({line})<{end} THEN rpad({line},{end},' ') ELSE {line} END)"
    return f"replace({line},' ','_')"


q("report_line", BATCH + f", v AS (SELECT batch_id AS step, RMSE, MAE, TS_light_rain AS TS FROM b) SELECT step, {line_sql(FIELDS)} AS line FROM v")(
    lambda s, d: V.batch_scores(pairs(s, d)).select(F.col("batch_id").alias("step"), X.report_line(
        [F.col("batch_id"), F.lit("valid"), *[V.short(F.col(c)).cast("string") for c in ("RMSE", "MAE", "TS_light_rain")]], sign="_").alias("line")))
NUMBER = "CASE WHEN isinf({m}) THEN '\"Infinity\"' ELSE CAST(round(round({m},9),3)+0.0 AS VARCHAR) END"
q("report_json", BATCH + " SELECT batch_id, '{' || " + " || ',' || ".join(f"'\"{m}\":' || " + NUMBER.format(m=m) for m in sorted(S.METRICS)) + " "
  "|| '}' AS line FROM b")(
    lambda s, d: V.batch_scores(pairs(s, d)).select("batch_id", F.to_json(F.struct(*[V.short(F.col(m)).alias(m) for m in sorted(S.METRICS)])).alias("line")))

# text
LOWERED = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
TOKENS = f"list_concat(['[CLS]'], string_split({LOWERED},' '))"
q("token_pad", f"SELECT doc_id, array_to_string(list_concat({TOKENS}, ['[PAD]' FOR i IN range(512)])[1:512], '|') AS tokens FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(X.pad(X.tokens(F.col("text")), 512), "|").alias("tokens")))
q("token_ids", f"WITH w AS (SELECT unnest(string_split({LOWERED},' ')) AS token FROM documents), v "
  f"AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token)+2 AS id FROM w GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 5000), "
  f"t AS (SELECT doc_id, list_concat({TOKENS}, ['[PAD]' FOR i IN range(64)])[1:64] AS l FROM documents), e "
  f"AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l,1) AS k FROM t), "
  "i AS (SELECT doc_id, k, CASE token WHEN '[PAD]' THEN 0 WHEN '[UNK]' THEN 1 WHEN '[CLS]' THEN 2 ELSE coalesce(id,1) END AS id FROM e LEFT "
  "JOIN v USING (token)) "
  "SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS ids FROM i GROUP BY 1")(
    lambda s, d: X.token_ids(table(s, d, "documents"), X.vocabulary(table(s, d, "documents"), 5000), 64).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))
q("time_decode", "SELECT event_id, TIMESTAMP '2020-01-01 00:00:00' + (event_id % 9000) * INTERVAL 90 MINUTE AS time FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", X.time_decode(F.col("event_id") % 9000 * 1.5, "hours since 2020-01-01 "
      "00:00:00").alias("time")))


# streams
PAIR = ["CAST(l_shipdate AS DATE) AS sample_id", "CAST(l_quantity AS DOUBLE) * CAST(l_discount AS DOUBLE) * 10 AS pred", "CAST(l_quantity AS "
  "DOUBLE) * CAST(l_tax AS DOUBLE) * 10 AS label"]


@q("stream_scores", SCORES + " SELECT sample_id, round(RMSE,6) AS RMSE, round(CC,6) AS CC, round(KGE,6) AS KGE, round(TS_light_rain,6) AS "
  "TS_light_rain, round(BIAS_heavy_rain,6) AS BIAS_heavy_rain FROM scores")
def _stream_scores(s, d):
    """Pairs arrive in five files that each hold some cells of every sample, two files a batch."""
    base = folder(s, "stream")
    rows = table(s, d, "lineitem").select("l_shipdate", "l_quantity", "l_discount", "l_tax", "l_orderkey")
    rows.repartition(5, "l_orderkey").write.parquet(f"{base}/in")
    got = scores.stream_scores(s, f"{base}/in", [F.expr(p) for p in PAIR], rows.schema, f"{base}/table", f"{base}/state", files_at_once=2)
    return got.select("sample_id", *[r6(F.col(m), m) for m in ("RMSE", "CC", "KGE", "TS_light_rain", "BIAS_heavy_rain")])


@q("stream_preprocess", NORMAL)
def _stream_preprocess(s, d):
    """Cells arrive in four files that each hold a part of every grid file, one a batch."""
    base = folder(s, "stream")
    cells = cells_long(s, d)
    cells.repartition(4, "event_id").write.parquet(f"{base}/cells")
    got = preprocess.stream_preprocess(s, f"{base}/cells", C.global_stats(C.clean(cells)), f"{base}/out", f"{base}/state", files_at_once=1)
    return got.select("event_id", "file", "variable", F.round("value", 4).alias("value"))
