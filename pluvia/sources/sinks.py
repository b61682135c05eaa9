"""Sinks: processed grids, files of given contents, predictions, metric history."""
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import clean
from pluvia.sources.scratch import numbered, sent_if_small, written


def write_files(contents: DataFrame, root: str) -> int:
    """contents (name, content) as files under root, each put in place when it is complete; gives their number. A task that
    is repeated writes the same files again."""
    def put(batches):
        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                folder, _, short = f"{base}/{name}".rpartition("/")
                system.create_dir(folder)
                part = f"{folder}/.{short}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, f"{folder}/{short}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])
    return contents.select("name", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_processed(cells: DataFrame, out: str) -> None:
    """One folder for each input file; files that are written again replace their own folder only."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)


def read_processed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


MANIFEST = "_manifest"   # a name that readers of the table around it pass over


def fingerprints(cells: DataFrame) -> DataFrame:
    """file, mark, rows: a digest of the rows of each file, whatever their order."""
    row = F.xxhash64(*sorted(c for c in cells.columns if c != "file"))
    return cells.groupBy("file").agg(F.concat_ws("-", F.bit_xor(row), F.sum(F.shiftrightunsigned(row, 20)), F.count("*")).alias("mark"), F.count("*").alias("rows"))


def finished(spark: SparkSession, out: str) -> DataFrame:
    """file, mark, rows, run of the files that were written as a whole."""
    return spark.read.schema("file string, mark string, rows long, run string").parquet(f"{out}/{MANIFEST}")


def write_resumable(cells: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, run: str, files_at_once: int = 1000, waves: int | None = None) -> int:
    """process(cells) by file under out, for the files that aren't finished with these very cells; gives the number of waves
    that are left. `files_at_once` files make a wave: their folders are replaced, then the manifest gets their names, marks
    and rows, in one write that is seen whole or not at all. So files of a wave that was broken off are written again, and
    finished ones never are. With `waves` that many are done in this call."""
    spark = cells.sparkSession
    finished_mark(spark, out)
    marks = written(fingerprints(cells))
    todo = numbered(marks.join(finished(spark, out).select("file", "mark"), ["file", "mark"], "left_anti"), "file", name="at")
    todo = written(todo.withColumn("wave", F.floor(F.col("at") / files_at_once)))
    total = (todo.agg(F.max("wave")).first()[0] or 0) + 1 if not todo.isEmpty() else 0
    now = total if waves is None else min(waves, total)
    for k in range(now):
        part = todo.where(F.col("wave") == k)
        write_processed(process(cells.join(sent_if_small(part.select("file")), "file", "left_semi")), out)
        part.select("file", "mark", "rows", F.lit(run).alias("run")).coalesce(1).write.mode("append").parquet(f"{out}/{MANIFEST}")
    return total - now


def finished_mark(spark: SparkSession, out: str) -> None:
    """An empty manifest where there is none yet."""
    spark.createDataFrame([], "file string, mark string, rows long, run string").write.mode("append").parquet(f"{out}/{MANIFEST}")


def add_moments(moments: DataFrame, out: str) -> None:
    """Moments (file, variable, n, s, q) of new files beside those that are there; a file's own are replaced."""
    moments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)


def read_moments(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("variable string, n long, s double, q double, file string").parquet(out)


def write_stats(stats: DataFrame, out: str) -> None:
    """Statistics as one JSON row of <variable>_mean and <variable>_std, keys sorted."""
    wide = clean.wide_stats(stats)
    wide.select(*sorted(wide.columns)).coalesce(1).write.mode("overwrite").json(out)


def read_stats(spark: SparkSession, out: str) -> DataFrame:
    """variable, mean, std of what write_stats wrote."""
    names = list(clean.LIMITS)
    wide = spark.read.schema(", ".join(f"{v}_{c} double" for v in names for c in ("mean", "std"))).json(out)
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_mean").alias("mean"), F.col(f"{v}_std").alias("std")) for v in names])
    return wide.select(F.explode(each).alias("r")).select("r.*").where("mean IS NOT NULL")


def write_predictions(pred: DataFrame, out: str, **options) -> None:
    """One JSON object for each row, keys sorted."""
    pred.select(*sorted(pred.columns)).write.options(**options).json(out)


def history_rows(scores: DataFrame, step: str, metrics: list[str], run: str, split: str, granularity: str) -> DataFrame:
    """scores (step, one column for each metric) -> run, split, granularity, tag, step, value."""
    return scores.select(F.col(step).cast("long").alias("step"), *metrics).unpivot("step", metrics, "tag", "value").select(
        F.lit(run).alias("run"), F.lit(split).alias("split"), F.lit(granularity).alias("granularity"), "tag", "step", "value")


def write_history(rows: DataFrame, out: str) -> None:
    rows.write.mode("append").partitionBy("run", "split").parquet(out)


def write_errors(errors: DataFrame, values: DataFrame, out: str) -> None:
    """Summaries and cells of error samples, added to those that are there."""
    errors.write.mode("append").partitionBy("error").parquet(f"{out}/summary")
    values.write.mode("append").partitionBy("error").parquet(f"{out}/values")
