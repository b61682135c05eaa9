"""Shared helpers of the training-data operators."""
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from pluvia.sources.scratch import shared, written  # noqa: F401  Parquet columns of one kind take far less room than checkpointed rows


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def map_texts(df: DataFrame, compute: Callable, added: str, column: str = "text", keep: bool = False) -> DataFrame:
    """The columns of df, `column` only with keep, and those that compute(list of values) gives for each row, in the
    order of `added`, which replace columns of the same name. Other columns pass as Arrow arrays, so that a large id
    beside a null stays whole."""
    new = StructType.fromDDL(added)
    kept = [f for f in df.schema if (keep or f.name != column) and f.name not in new.names]
    kinds = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in kept] + new.names

    def run(it):
        for b in it:
            got = compute(b.column(column).to_pylist())
            own = [pa.array(v, type=t) for v, t in zip(got, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + own, names)
    return df.mapInArrow(run, StructType(kept + list(new)))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


IDS = 5_000_000   # ids (of 8 bytes) that are sent to every task, at most


def sent_if_few(ids: DataFrame) -> DataFrame:
    """The ids, counted first: up to IDS of them are broadcast, so that the rows they are joined to needn't be shuffled."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= IDS else ids


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads files, so that each reading gives the same rows in the same partitions."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def few(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """Fewer partitions where so many rows don't need all of them."""
    return df.coalesce(1 + rows // each)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): contraction by smallest neighbour; each round maps every node that has a
    smaller neighbour to it, so edges shrink by a factor and rounds are logarithmic. No edges: empty result."""
    e = cut(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    n = e.count()
    label = few(e.selectExpr("a AS node").union(e.selectExpr("b AS node")).distinct().withColumn("root", F.col("node")), 2 * n)
    while n:
        up = few(e.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")), n)
        further = up.selectExpr("x AS y", "y AS z")
        up = cut(few(up.join(further, "y", "left").selectExpr("x", "coalesce(z, y) AS y"), n))
        label = few(label.join(up, label.root == up.x, "left").selectExpr("node", "coalesce(y, root) AS root"), 2 * n)   # read once, at the end
        ua, ub = up.selectExpr("x AS a", "y AS ra"), up.selectExpr("x AS b", "y AS rb")
        e = cut(few(e.join(ua, "a", "left").join(ub, "b", "left").selectExpr("coalesce(ra, a) AS p", "coalesce(rb, b) AS q")
                    .where("p <> q").selectExpr("least(p, q) AS a", "greatest(p, q) AS b").distinct(), n))
        n = e.count()
    return cut(label)


FOLD = 512   # items that a fold gathers before it puts them beside the earlier ones


def folded(items: Column, state: Column, none: Column, step: Callable) -> Column:
    """What step(state, item) -> (state, array of results) gives over the items of an array, one after the other. Results are
    gathered FOLD items at a time: an array that grows by each item is copied each time, which takes hours over 10^6 items."""
    def some(acc: Column, chunk: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            new, got = step(a["state"], x)
            return F.struct(new.alias("state"), F.concat(a["out"], got).alias("out"))
        inner = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return once(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def over(z: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD).cast("int")), lambda k: F.slice(z, k * FOLD + 1, F.lit(FOLD)))
        init = F.struct(state.alias("state"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out"))
        return F.when(F.size(z) > 0, F.aggregate(chunks, init, some, lambda acc: F.flatten(acc["out"]))).otherwise(none)
    return once(items, over)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


CHUNK = 512   # code points of a piece of text


def chunked(text: Column) -> Column:
    """The text in pieces, in which a place is reached without passing over all that stands before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, the latter not included."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, held.substr(start - first * CHUNK + 1, end - start)).otherwise("")
