"""File sources: listings, JSON text, image manifests, the source of a split."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.sources.scratch import SMALL, numbered, running_sum, sent_if_small, written


def file_listing(spark: SparkSession, root: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """path of every file under root, or right in it; contents are not read. A root without a file gives an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(root).select("path")
    if df.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {root}")
    return df


def multi_root_listing(spark: SparkSession, roots: str, recursive: bool = True) -> DataFrame:
    """path of the files of comma-separated roots, spaces dropped; a file in two roots is listed twice; sorted by path."""
    parts = [file_listing(spark, r, recursive) for r in roots.replace(" ", "").split(",") if r]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("path")


CORRUPT = "_malformed"


def json_lines(spark: SparkSession, paths, schema: str, encoding: str = "UTF-8", malformed: bool = False) -> DataFrame:
    """One record in each line of many files. A line that is no such record gives a row of nulls; with `malformed` the line
    itself stands in a column of that name, null in good rows."""
    if not malformed:
        return spark.read.schema(schema).option("encoding", encoding).json(paths)
    rows = spark.read.option("encoding", encoding).text(paths).select("value", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return rows.select("r.*", F.when(bad, F.col("value")).alias("malformed")).drop(CORRUPT)


def json_arrays(spark: SparkSession, paths, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Each file holds one array of records."""
    return spark.read.schema(schema).option("encoding", encoding).option("multiLine", True).json(paths)


def global_rows(records: DataFrame, *line: str, file: str = "file", name: str = "row") -> DataFrame:
    """records with their number over all files, by file and then by the columns that order the lines of a file."""
    return numbered(records, file, *line, name=name)


def text_lines(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """The lines of files, and how many lines each split of a file has. A file may be read in several splits; a line belongs
    to the split in which it begins, and a task reads the lines of a split one after the other."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                          F.monotonically_increasing_id().alias("_at"))
    return lines, written(lines.groupBy("file", "block").agg(F.min("_at").alias("first"), F.count("*").alias("n")))


def line_rows(spark: SparkSession, paths, schema: str | None = None, name: str = "row", small: int = SMALL) -> DataFrame:
    """file, value and the number of each line over all files (from 0), files by path, lines as they stand: the splits are
    counted, their sums say where each begins. With schema the record of each JSON line, null fields where it is none."""
    lines, splits = text_lines(spark, paths)
    starts = sent_if_small(running_sum(splits, "n", "file", "block", small=small))
    row = (F.col("end") - F.col("n") + F.col("_at") - F.col("first")).cast("long").alias(name)
    got = lines.join(starts, ["file", "block"])
    return got.select("file", row, "value") if schema is None else got.select("file", row, F.from_json("value", schema).alias("r")).select("file", name, "r.*")


def line_counts(spark: SparkSession, paths, small: int = SMALL) -> DataFrame:
    """file, n and the half-open interval (lo, hi) of its line numbers."""
    _, splits = text_lines(spark, paths)
    sums = running_sum(splits.groupBy("file").agg(F.sum("n").alias("n")), "n", "file", name="hi", small=small)
    return sums.select("file", "n", (F.col("hi") - F.col("n")).cast("long").alias("lo"), "hi")


def image_manifest(manifest: DataFrame, images: DataFrame, prefix: str = "") -> DataFrame:
    """manifest (path, label) with the content of prefix/path; a missing image leaves it null, the row stays."""
    return manifest.withColumn("_full", F.concat(F.lit(f"{prefix}/" if prefix else ""), "path")).join(
        images.select(F.col("path").alias("_full"), "content"), "_full", "left").drop("_full")


def image_source(spark: SparkSession, manifests, prefix: str, label: str = "string") -> DataFrame:
    """path, label, content: manifests are files of one JSON array of {path, label} each, images lie under prefix."""
    rows = json_arrays(spark, manifests, f"path string, label {label}")
    base = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", prefix).rstrip("/") + "/"
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix)
    return image_manifest(rows, images.select(F.substr("path", F.locate(base, "path") + F.lit(len(base))).alias("path"), "content"))


def split_spec(specs: dict, mode: str):
    """The source of a split; valid and test fall back on that of train."""
    got = specs.get(mode)
    return specs["train"] if got is None else got
