"""Views over the given tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources.scratch import numbered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CELLS_SQL = """SELECT event_id, 'grid-' || {fmt} || '.nc' AS file, CAST({hour} AS INT) AS time_idx,
 CAST({div} AS INT) AS y, CAST(user_id % 15 AS INT) AS x,
 CASE event_type WHEN 'error' THEN 'TAIR' WHEN 'click' THEN 'UWIN' WHEN 'view' THEN 'VWIN' WHEN 'signup' THEN 'PRE' ELSE 'corrected_precip' END AS variable,
 CASE WHEN event_id % 101 = 0 THEN 9999.0 WHEN event_id % 103 = 0 THEN -9999.0 WHEN event_id % 107 = 0 THEN 999999.0 WHEN event_id % 109 = 0 THEN -999999.0
 WHEN event_id % 113 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 127 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 131 = 0 THEN -value ELSE value END AS value FROM events"""
CELLS_SPARK = CELLS_SQL.format(fmt="date_format(ts,'yyyyMMdd')", hour="hour(ts)", div="user_id div 15").replace(" FROM events", " FROM {events}")
CELLS_DUCK = CELLS_SQL.format(fmt="strftime(ts,'%Y%m%d')", hour="hour(ts)", div="user_id // 15")
PAIRS_SQL = """SELECT CAST(l_shipdate AS DATE) AS sample_id, CAST(l_quantity AS DOUBLE) * CAST(l_discount AS DOUBLE) * 10 AS pred,
 CAST(l_quantity AS DOUBLE) * CAST(l_tax AS DOUBLE) * 10 AS label, l_orderkey FROM lineitem"""


def cells_long(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CELLS_SPARK, events=table(spark, d, "events")).withColumn("value", F.col("value").cast("double"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """batch_id numbers eight samples each, by the order of the distinct samples."""
    li = spark.sql(PAIRS_SQL.replace("FROM lineitem", "FROM {t}"), t=table(spark, d, "lineitem"))
    idx = numbered(li.select("sample_id").distinct(), "sample_id").select("sample_id", F.floor(F.col("pos") / 8).cast("long").alias("batch_id"))
    return li.join(idx, "sample_id")
