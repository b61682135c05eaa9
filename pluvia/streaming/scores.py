"""Running verification scores as pairs arrive, by moments in a table.

The table holds the moments of each sample as rows by batch: a batch writes rows only for the samples that it touches,
each merged with that sample's newest row of an earlier batch. The rows of a batch are replaced as a whole, so a batch
that is taken again changes nothing."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pluvia.functions import moments as M
from pluvia.sources.scratch import sent_if_small


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*M.NAMES), "batch").alias("r")).select(key, "r.*")


def _table(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(out)


def take_batch(pairs: DataFrame, batch: int, out: str, key: str = "sample_id") -> None:
    """pairs (key, pred, label) into the table; batches are numbered in the order in which they are taken."""
    new = sent_if_small(M.moments(pairs, key))
    if batch:
        # the first write makes the folder; what an earlier, broken try of this batch left doesn't count
        new = M.merged(new, _newest(_table(pairs.sparkSession, out, new.schema).where(F.col("batch") < batch).join(new.select(key), key, "left_semi"), key), key)
    new.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)


def read(spark: SparkSession, out: str, key: str = "sample_id") -> DataFrame:
    """key and the sixteen scores of each sample so far."""
    return M.scores(_newest(spark.read.parquet(out), key), key)


def stream_scores(spark: SparkSession, source: str, columns: list, schema, out: str, checkpoint: str, files_at_once: int | None = None) -> DataFrame:
    """Files under source become pairs (sample_id, pred, label) by `columns`. All that is there is taken, then the stream
    ends. Gives the scores so far."""
    src = spark.readStream.schema(schema)
    if files_at_once:
        src = src.option("maxFilesPerTrigger", files_at_once)
    job = (src.parquet(source).select(*columns).writeStream.foreachBatch(lambda pairs, batch: take_batch(pairs, batch, out))
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    job.awaitTermination()
    return read(spark, out)
