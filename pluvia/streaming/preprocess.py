"""Cleaning of newly arrived cells as a stream, with statistics fixed beforehand. A file may arrive in several parts.

A file's fill values rest on sums over all of its cells, so each part changes what its earlier parts were filled with. Cells
that are no sentinel are final when they arrive (`kept`). Sentinel cells stay as they came (`sentinels`), and so do each
part's sums (`sums`); the files that a part touches are filled anew from all their sums so far (`filled`), file by file.
Every table is written by part or by file and replaced as such, so a part that is taken twice changes nothing."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pluvia.operators import clean
from pluvia.sources.scratch import sent_if_small, written


def _put(df: DataFrame, out: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(out)


def _parts(spark: SparkSession, out: str, schema: StructType, upto: int) -> DataFrame:
    return spark.read.schema(StructType(schema.fields).add("part", "long")).parquet(out).where(F.col("part") <= upto)


def take_part(cells: DataFrame, part: int, stats: DataFrame, out: str) -> None:
    """Cells (file, variable, value, ...) of any files into the tables under out. Parts are numbered in the order in which
    they are taken."""
    spark, once = cells.sparkSession, written(cells)
    hit = F.coalesce(clean.any_sentinel(F.col("value")), F.lit(False))
    tag = F.lit(part).cast("long").alias("part")
    sums = written(clean.fill_sums(once))
    _put(clean.zscore(clean.finish(once.where(~hit)), stats).select(*once.columns, tag), f"{out}/kept", "part")
    _put(once.where(hit).select("*", tag), f"{out}/sentinels", "part")
    _put(sums.select("*", tag), f"{out}/sums", "part")
    touched = sent_if_small(sums.select("file").distinct())
    so_far = _parts(spark, f"{out}/sums", sums.schema, part).join(touched, "file", "left_semi")
    total = so_far.groupBy("file", "variable").agg(*[F.sum(c).alias(c) for c in clean.SUMS])
    raw = _parts(spark, f"{out}/sentinels", once.schema, part).join(touched, "file", "left_semi").select(*once.columns)
    _put(clean.zscore(clean.finish(clean.filled(raw, clean.fill_values(total))), stats).select(*once.columns), f"{out}/filled", "file")


def read(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The cleaned cells of all parts so far; schema is that of the cells."""
    names = schema.fieldNames()
    kept = spark.read.schema(schema).parquet(f"{out}/kept").select(*names)
    return kept.union(spark.read.schema(schema).parquet(f"{out}/filled").select(*names))


def stream_preprocess(spark: SparkSession, source: str, stats: DataFrame, out: str, checkpoint: str, files_at_once: int | None = None) -> DataFrame:
    """Cells (Parquet files under source) that have not been taken yet are cleaned, normalised and written; the stream ends
    when all that is there is taken. What was taken is kept in the checkpoint. Gives the cleaned cells so far."""
    schema = spark.read.parquet(source).schema
    stats = written(stats)
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_at_once:
        src = src.option("maxFilesPerTrigger", files_at_once)
    job = (src.parquet(source).writeStream.foreachBatch(lambda cells, part: take_part(cells, part, stats, out))
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    job.awaitTermination()
    return read(spark, out, schema)
