"""Text functions: tokens, ids, padding, report lines, times."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pluvia.sources.scratch import BROADCAST_ROWS, written

# fixed values
CLS, PAD, UNK = "[CLS]", "[PAD]", "[UNK]"
COLUMNS = (7, 14, 25, 40, 48)   # where the fields of a report line end
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DISPLAY = {"RMSE": "RMSE", "MAE": "MAE", "CC": "CC", "TS_light_rain": "TS_light", "TS_moderate_rain": "TS_moderate", "TS_heavy_rain": "TS_heavy"}


def tokens(text: Column) -> Column:
    """A-Z lower-cased, split at single spaces, [CLS] in front; a null text is an empty one."""
    return F.concat(F.array(F.lit(CLS)), F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), " ", -1))


def pad(items: Column, n: int) -> Column:
    """Cut or filled with [PAD] to n."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(PAD), n)), 1, n)


def vocabulary(texts: DataFrame, size: int) -> DataFrame:
    """token, id: the special tokens, then the `size` most frequent tokens, ties by the token."""
    top = texts.select(F.explode(F.slice(tokens(F.col("text")), 2, 2**31 - 2)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    rest = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))).alias("t")).select(F.posexplode("t").alias("id", "t"))  # `size` rows
    special = texts.sparkSession.createDataFrame([(PAD, 0), (UNK, 1), (CLS, 2)], "token string, id int")
    return special.union(rest.select("t.token", (F.col("id") + 3).cast("int")))


def token_ids(texts: DataFrame, vocab: DataFrame, n: int, small: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, ids: the first n tokens' ids, padded; a token that isn't in vocab has the id of [UNK]. vocab (token, id) is
    counted: up to `small` rows go to every task and nothing is shuffled; a larger one is joined by token."""
    rows = texts.select("doc_id", pad(tokens(F.col("text")), n).alias("tokens"))
    vocab = written(vocab.select("token", F.col("id").cast("int").alias("id")))
    if vocab.count() > small:
        return _joined_ids(rows, vocab)
    known = vocab.toArrow()   # `small` rows at most
    sent = texts.sparkSession.sparkContext.broadcast((known.column("token").to_pylist(), known.column("id").to_pylist()))

    def look_up(batches):
        names, ids = pa.array(sent.value[0], pa.string()), pa.array(sent.value[1], pa.int32())
        for b in batches:
            t = b.column("tokens")
            found = ids.take(pc.index_in(t.flatten(), value_set=names)).fill_null(1)   # 1: the id of [UNK]
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, n * b.num_rows + 1, n), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "ids"])
    return rows.mapInArrow(look_up, StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))]))


def _joined_ids(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """As token_ids, for a vocabulary of any size: a token is joined once for each partition and row that hold it."""
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()))
    t = rows.select("doc_id", "rid", F.posexplode("tokens").alias("at", "token"))
    ids = t.join(vocab, "token", "left").select("rid", "doc_id", F.struct("at", F.coalesce("id", F.lit(1)).alias("id")).alias("v"))
    return ids.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list("v")).alias("v")).select("doc_id", F.transform("v", lambda x: x["id"]).alias("ids"))  # n entries a row


def report_line(fields: list[Column], columns=COLUMNS, sign: str = " ") -> Column:
    """Each field is filled with spaces up to its column, never cut; the spaces become `sign`."""
    line = F.lit("")
    for f, end in zip(fields, columns):
        line = F.concat(line, f.cast("string"))
        line = F.when(F.length(line) < end, F.rpad(line, end, " ")).otherwise(line)
    return F.replace(line, F.lit(" "), F.lit(sign))


def time_decode(offset: Column, units: str) -> Column:
    """Times of a coordinate in '<seconds|minutes|hours|days> since <timestamp>'."""
    unit, _, since = units.partition(" since ")
    size = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}.get(unit.strip())
    if size is None or not since:
        raise ValueError(f"unknown time units {units!r}")
    micros = F.round(offset * size * 1_000_000).cast("long")
    return (F.lit(since).cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz")


def display_tag(tag: Column) -> Column:
    """The name under which a metric is shown; others keep theirs."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in DISPLAY.items() for v in kv]), tag), tag)
