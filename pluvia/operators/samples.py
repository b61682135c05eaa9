"""Samples of gridded cells: frames, sliding sequences, labels, stacked features, batches."""
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.sources.scratch import numbered, running_sum, written

FEATURES, TARGET = ["TAIR", "UWIN", "VWIN", "PRE"], "corrected_precip"
STEPS, STRIDE, CODE_STRIDE = 4, 1, 3   # as configured, and the stride of the code's default


def global_time_index(frames: DataFrame) -> DataFrame:
    """frames (file, time_idx, time), one row for each -> with pos, their place in time; equal times by file, then time_idx."""
    return numbered(frames, "time", "file", "time_idx")


def frame_samples(index: DataFrame) -> DataFrame:
    """Every frame is a sample."""
    return index.select(F.col("pos").alias("sample_id"), "file", "time_idx")


def windows(index: DataFrame, steps: int = STEPS, stride: int = STRIDE) -> DataFrame:
    """start, step, pos, file, time_idx: windows of `steps` places that begin at every `stride`-th one, gaps in time or not; a
    frame is expanded into the windows that hold it, so nothing is joined."""
    last = index.agg(F.max("pos")).first()[0]
    if last is None or last + 1 < steps:
        return index.select(F.col("pos").alias("start"), F.lit(0).alias("step"), "pos", "file", "time_idx").where("false")
    inside = index.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("start", F.col("pos") - F.col("step"))
    return inside.where((F.col("start") >= 0) & (F.col("start") % stride == 0) & (F.col("start") <= last - steps + 1)).select("start", "step", "pos", "file", "time_idx")


def _placed(cells: DataFrame, index: DataFrame) -> DataFrame:
    """cells with their frame's place in time."""
    return cells.join(index.select("file", "time_idx", "pos"), ["file", "time_idx"])


def sequence_cells(cells: DataFrame, index: DataFrame, steps: int = STEPS, stride: int = STRIDE) -> DataFrame:
    """start, step, y, x and the variables of each cell of each window. A cell is joined with its place once and repeated for
    its windows afterwards, so the repeated rows are not shuffled."""
    last = index.agg(F.max("pos")).first()[0]
    rows = _placed(cells, index).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("start", F.col("pos") - F.col("step"))
    inside = F.lit(False) if last is None else (F.col("start") >= 0) & (F.col("start") % stride == 0) & (F.col("start") <= last - steps + 1)
    return rows.where(inside).select("start", "step", "y", "x", *FEATURES, TARGET)


RANGE = 64   # places of a range of frames


def stacked(cells: DataFrame, index: DataFrame, steps: int = STEPS, stride: int = STRIDE, features: list[str] = FEATURES, places: int = RANGE) -> DataFrame:
    """start, y, x, data (steps x features, zeros where the cell is absent) and label, the target of the last step; a row for
    each window and cell that is there in one of its steps.

    Frames are dealt to ranges of `places`, and the first steps - 1 frames of a range once more to the one before, whose
    windows reach into it; so 1 + (steps - 1) / places copies of a cell are shuffled, not one for each window. A task takes
    the sorted rows of a cell and range and fills its windows; it holds a batch and one such group of rows."""
    last = index.agg(F.max("pos")).first()[0]
    low = F.floor(F.greatest(F.col("pos") - (steps - 1), F.lit(0)) / places)
    ranged = _placed(cells, index).select(F.explode(F.sequence(low, F.floor(F.col("pos") / places))).alias("g"), "y", "x", "pos", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*features, TARGET]])
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a task makes `steps` times what it reads: small parts aren't merged
    rows = ranged.repartition(tasks, "g", "y", "x").sortWithinPartitions("g", "y", "x", "pos")
    names = ["g", "y", "x", "pos"]

    def windows_of(t: pa.Table) -> pa.RecordBatch:
        g, y, x, pos = (t.column(c).to_numpy() for c in names)
        values = np.column_stack([t.column(c).to_numpy() for c in features])
        group = np.cumsum(np.r_[False, (np.diff(g) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)]) if len(g) else np.zeros(0, dtype=np.int64)
        row = np.tile(np.arange(len(g)), steps)
        step = np.repeat(np.arange(steps), len(g))
        start = pos[row] - step
        ok = (start >= g[row] * places) & (start < (g[row] + 1) * places) & (start % stride == 0) & (start <= last - steps + 1)
        row, step, start = row[ok], step[ok], start[ok]
        key, first, at = np.unique(group[row] * (2 * places) + start - g[row] * places, return_index=True, return_inverse=True)
        data = np.zeros((len(key), steps, len(features)))
        data[at, step] = values[row]
        label = np.zeros(len(key))
        end = step == steps - 1
        label[at[end]] = t.column(TARGET).to_numpy()[row[end]]
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, data.size + 1, len(features)), pa.int32()), pa.array(data.reshape(-1)))
        outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(key) * steps + 1, steps), pa.int32()), inner)
        return pa.RecordBatch.from_arrays([pa.array(start[first], pa.int64()), pa.array(y[row[first]], pa.int32()), pa.array(x[row[first]], pa.int32()), outer, pa.array(label)], ["start", "y", "x", "data", "label"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = [t.column(c).to_numpy() for c in names[:3]]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1]) if t.num_rows else np.zeros(0, dtype=bool)
            done = int(np.argmax(same)) if len(same) else 0   # rows are sorted: the last group begins there
            held = t.slice(done).combine_chunks()
            if done:
                yield windows_of(t.slice(0, done))
        if held is not None and held.num_rows:
            yield windows_of(held)
    schema = "start long, y int, x int, data array<array<double>>, label double"
    if last is None:
        return cells.sparkSession.createDataFrame([], schema)
    return rows.select(F.col("g").cast("long").alias("g"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("pos").cast("long").alias("pos"), *features, TARGET).mapInArrow(run, schema)


def batches(samples: DataFrame, size: int, mode: str = "train", order: str = "sample_id") -> DataFrame:
    """samples, one row for each, with batch_id; an incomplete last batch stays in test mode only."""
    rows = numbered(samples, order, name="_n").withColumn("batch_id", F.floor(F.col("_n") / size).cast("long"))
    if mode != "test":
        whole = (rows.agg(F.max("_n")).first()[0] or -1) + 1
        rows = rows.where(F.col("_n") < whole - whole % size)
    return rows.drop("_n")


def permuted(number: Column, total: int, seed: int, rounds: int = 6) -> Column:
    """Another place for each number from 0 to total - 1: a permutation given by the seed, computed row by row. Numbers are
    pairs of digits of two radices, each round adds a hash of one digit to the other; what leaves the range goes round again."""
    b = max(1, math.isqrt(max(total - 1, 0)) + 1)
    a = max(1, -(-total // b))
    outside = 1 - total / (a * b) if total else 0.0
    again = 0 if outside <= 0 else math.ceil(-100 / math.log2(outside))   # so that 2 ** -100 of them would remain outside

    def once(v: Column) -> Column:
        left, right = F.floor(v / b), F.pmod(v, F.lit(b))
        for k in range(rounds):
            shift = lambda c, n: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(k)), F.lit(n))  # noqa: E731, B023
            if k % 2:
                right = F.pmod(right + shift(left, b), F.lit(b))
            else:
                left = F.pmod(left + shift(right, a), F.lit(a))
        return (left * b + right).cast("long")
    first = once(number.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(again)), first, lambda v, _: F.when(v < total, v).otherwise(once(v))) if again else first


def epoch_batches(samples: DataFrame, total: int, size: int, seed: int, mode: str = "train", number: str = "sample_id") -> DataFrame:
    """samples, numbered from 0 to total - 1, with place and batch_id of an epoch's random order; an incomplete last batch
    stays in test mode only. Nothing is sorted or shuffled: the place of a sample follows from its number and the seed."""
    rows = samples.withColumn("place", permuted(F.col(number), total, seed)).withColumn("batch_id", F.floor(F.col("place") / size).cast("long"))
    return rows if mode == "test" else rows.where(F.col("place") < total - total % size)


def shuffled(samples: DataFrame, seed: int, key: str = "sample_id") -> DataFrame:
    """The same order for the same seed."""
    return samples.orderBy(F.xxhash64(key, F.lit(seed)), key)


def rows_to_files(rows: DataFrame, files: DataFrame, bucket: int = 4096) -> DataFrame:
    """rows (row, ...) with the file whose half-open interval (lo, hi) of files holds the row number. Intervals are cut at
    multiples of `bucket`, so that this is a join by equality whose size is that of the rows and of the cut intervals."""
    cut = files.where("hi > lo").withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    return rows.withColumn("b", F.floor(F.col("row") / bucket)).join(cut, "b").where("row >= lo AND row < hi").drop("b", "lo", "hi")


def prefix_counts(rows: DataFrame, file: str = "file") -> DataFrame:
    """file, n and the half-open interval (lo, hi) of its row numbers; files by name."""
    sums = running_sum(written(rows.groupBy(file).agg(F.count("*").alias("n"))), "n", file, name="hi")
    return sums.select(file, "n", (F.col("hi") - F.col("n")).cast("long").alias("lo"), "hi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
