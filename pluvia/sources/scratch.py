"""The shared folder of the session, and tables and row numbers that rest on it."""
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset and all runs on one machine, as in tests, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pluvia-")
    return base


_MADE: list[str] = []   # folders of this process that are not cleared yet


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. What is written there stays, as checkpoints do, until that folder is cleared, or the
    block of `cleared` ends in which it was made."""
    _MADE.append(f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextlib.contextmanager
def cleared(spark: SparkSession, keep: tuple[str, ...] = ()):
    """Removes the folders that are made in this block, but those to keep, when it ends well: what was read from them must
    have been written elsewhere by then. After an error they stay for a look at them."""
    before = len(_MADE)
    yield
    made, _MADE[before:] = _MADE[before:], []
    for path in made:
        if path in keep:
            _MADE.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df by way of a Parquet table in the shared folder, so that they are computed once. The shuffle files that
    it took are removed when the table is written; else they would stay on the executors' disks until the driver happens to
    collect its garbage."""
    spark, out = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(out)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(out)


SMALL = 200_000   # rows that a single task numbers or sums, at most; more are done range by range, with the same result


def _ranges(df: DataFrame, order: tuple, total) -> tuple[DataFrame, DataFrame]:
    """The rows of df in sorted ranges, with their place (_at) and range (_part), and for each range what all earlier ones
    sum to (_before)."""
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33).cast("long"))
    begin, starts = 0, []
    for r in sorted(rows.groupBy("_part").agg(total.alias("n")).collect(), key=lambda r: r["_part"]):  # one row for each range
        starts.append((r["_part"], begin))
        begin += r["n"] or 0
    return rows, F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _before long"))


def numbered(df: DataFrame, *order: str, name: str = "pos", small: int = SMALL) -> DataFrame:
    """df with the number of each row (from 0) in the given order, which must be total for a definite result. The rows are
    counted; up to `small` of them are numbered by one window, more are sorted into ranges of which each is numbered by
    itself."""
    if df.count() <= small:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    rows, before = _ranges(df, order, F.count("*"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(before, "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_before")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "end", small: int = SMALL) -> DataFrame:
    """df with the sum of `value` over all rows up to each one, itself included, in the given order, which must be total."""
    if df.count() <= small:
        return df.withColumn(name, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    rows, before = _ranges(df, order, F.sum(value))
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, "_part").withColumn(name, (F.col("_before") + inner).cast("long")).drop("_at", "_part", "_before")


BROADCAST_ROWS = 200_000   # rows of a side that is sent to every task, at most


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df by way of a table and counted; up to `rows` rows are broadcast where it is joined."""
    df = written(df)
    return F.broadcast(df) if df.count() <= rows else df
