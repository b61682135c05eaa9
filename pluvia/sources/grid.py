"""Gridded files as a data source of Spark: input partitions of (file, time slab), planned from the files' headers.

A file holds named arrays whose leading axis is time: `time` itself, and variables over (time, y, x), or, for scattered
points, one value a row beside `time_idx`, `y` and `x`. Only the headers and the time coordinate are read to plan; a task
reads its slab of the wanted variables and nothing else, so memory is bounded by `slab_bytes` however long a file is.
Slabs outside the wanted times are not planned. A file that can't be read gives one row with `error`. As only ranges are
read, checksums over whole arrays are not checked.

Files are opened through pyarrow's file systems, so a root may be a local path or a URI that these know."""
import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

VARS = ["TAIR", "UWIN", "VWIN", "PRE", "corrected_precip"]
SLAB_BYTES = 16 << 20   # of a task's variables at once
OPEN_BYTES = 64 << 10   # what opening a file counts as, where small slabs share a task
OPENED = 16             # files whose headers are read at once while planning
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
POINT = ("time_idx", "y", "x")


class Npz:
    """Arrays of an .npz archive, read by ranges of their leading axis."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist()}

    def _open(self, name: str):
        f = self.zip.open(f"{name}.npy")
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if dtype.hasobject or fortran and len(shape) > 1:
            raise ValueError(f"{name}: arrays of objects or in column order can't be read by ranges")
        return f, shape, dtype

    def shape(self, name: str) -> tuple[int, ...]:
        f, shape, _ = self._open(name)
        f.close()
        return shape

    def read(self, name: str, lo: int, hi: int) -> np.ndarray:
        """Places lo to hi, the latter not included, of the leading axis."""
        f, shape, dtype = self._open(name)
        with f:
            row = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
            f.seek(lo * row, io.SEEK_CUR)
            data = f.read((hi - lo) * row)
        if len(data) < (hi - lo) * row:
            raise EOFError(f"{name}: {len(data)} of {(hi - lo) * row} bytes")
        return np.frombuffer(data, dtype=dtype).reshape(hi - lo, *shape[1:])


#: By name: opens a file and offers names, shape(name) and read(name, lo, hi). `nc` is registered by who has a library for it.
DECODERS: dict = {"npz": Npz}


def decoder(name: str):
    if name not in DECODERS:
        raise ValueError(f"unknown grid decoder {name!r}: {sorted(DECODERS)}")
    return DECODERS[name]


@dataclass
class Slab:
    path: str
    lo: int
    hi: int
    grid: tuple | None = None   # y and x sizes; None for scattered points
    error: str | None = None

    def cells(self) -> int:
        return (self.hi - self.lo) * (self.grid[0] * self.grid[1] if self.grid else 1)


@dataclass
class Pack(InputPartition):
    """Slabs that one task reads one by one: a single one, or small ones that come to the size of one."""
    slabs: list


def columns(variables: list[str]) -> str:
    return "file string, time_idx int, time timestamp_ntz, y int, x int, " + ", ".join(f"`{v}` double" for v in variables) + ", error string"


def _micros(t) -> np.datetime64 | None:
    return None if t is None else np.datetime64(t, "us")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.kind = options.get("decoder", "npz")
        self.variables = options.get("variables", ",".join(VARS)).split(",")
        self.slab_bytes = int(options.get("slab_bytes", SLAB_BYTES))
        self.since, self.until = _micros(options.get("since")), _micros(options.get("until"))
        self.only: set | None = None   # names of files
        decoder(self.kind)

    def partitions(self) -> list[Pack]:
        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root))
        paths = sorted(f.path for f in found if f.is_file and f.base_name.endswith(f".{self.kind}"))
        if not paths:
            raise FileNotFoundError(f"no *.{self.kind} in {self.root}")
        if self.only is not None:
            paths = [p for p in paths if p.rsplit("/", 1)[-1] in self.only]
        with ThreadPoolExecutor(OPENED) as pool:
            slabs = [s for found in pool.map(lambda p: self.plan(system, p), paths) for s in found]
        packs, held = [Pack([])], 0   # one at least: for none Spark would call read() without a partition
        for s in slabs:
            n = s.cells() * 8 * len(self.variables) + OPEN_BYTES
            if packs[-1].slabs and held + n > self.slab_bytes:
                packs.append(Pack([]))
                held = 0
            packs[-1].slabs.append(s)
            held += n
        return packs

    def plan(self, system, path: str) -> list[Slab]:
        try:
            with system.open_input_file(path) as f:
                g = decoder(self.kind)(f)
                n = g.shape("time")[0]
                time = g.read("time", 0, n).astype("datetime64[us]")
                grid = None
                if "time_idx" not in g.names:
                    full = [s for s in (g.shape(v) for v in sorted(g.names - {"time"})) if len(s) == 3]
                    if not full or full[0][0] != n:
                        raise ValueError("no variable over (time, y, x)")
                    grid = full[0][1:]
        except Exception as e:  # decoders have errors of their own; the file is set aside, the others go on
            return [Slab(path, 0, 0, None, type(e).__name__)]
        each = max(1, self.slab_bytes // (8 * len(self.variables) * (grid[0] * grid[1] if grid else 1)))
        wanted = np.ones(n, dtype=bool)
        if self.since is not None:
            wanted &= time >= self.since
        if self.until is not None:
            wanted &= time <= self.until
        out = []
        for lo in range(0, n, each):
            at = np.flatnonzero(wanted[lo:lo + each])
            if len(at):
                out.append(Slab(path, lo + int(at[0]), lo + int(at[-1]) + 1, grid))
        return out

    def read(self, part: Pack) -> Iterator[pa.RecordBatch]:
        return (self.batch(s) for s in part.slabs)

    def batch(self, part: Slab) -> pa.RecordBatch:
        name = part.path.rsplit("/", 1)[-1]
        kinds = [pa.string(), pa.int32(), pa.timestamp("us"), pa.int32(), pa.int32(), *[pa.float64()] * len(self.variables), pa.string()]
        names = ["file", "time_idx", "time", "y", "x", *self.variables, "error"]

        def bad(error: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], kinds[0]), *(pa.nulls(1, k) for k in kinds[1:-1]), pa.array([error], kinds[-1])], names)
        if part.error:
            return bad(part.error)
        try:
            got = self.slab(part)
        except Exception as e:  # as in plan()
            return bad(type(e).__name__)
        n = len(got[0])
        return pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(n, dtype=np.int64))), *(pa.array(a, k) for a, k in zip(got, kinds[1:-1])), pa.nulls(n, kinds[-1])], names)

    def slab(self, part: Slab) -> list[np.ndarray]:
        """time_idx, time, y, x and the variables of each cell of a slab."""
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(part.path) as f:
            g = decoder(self.kind)(f)
            lo, hi = part.lo, part.hi
            time = g.read("time", lo, hi).astype("datetime64[us]")
            if part.grid is None:
                t, y, x = (g.read(c, lo, hi).astype(np.int32) for c in POINT)
                cells = hi - lo
            else:
                h, w = part.grid
                cells = (hi - lo) * h * w
                t = np.repeat(np.arange(lo, hi, dtype=np.int32), h * w)
                y, x = np.tile(np.repeat(np.arange(h, dtype=np.int32), w), hi - lo), np.tile(np.arange(w, dtype=np.int32), (hi - lo) * h)
                time = np.repeat(time, h * w)
            values = [g.read(v, lo, hi).reshape(-1).astype(np.float64) if v in g.names else np.zeros(cells) for v in self.variables]
        if any(len(v) != cells for v in values):
            raise ValueError("variables of different sizes")
        return [t, time, y, x, *values]


class PushingReader(Reader):
    """Takes comparisons of `time` and `file` with constants into the plan; Spark still applies them to the rows."""

    def pushFilters(self, filters):
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("time",) and value is not None:
                t = _micros(value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = t if self.since is None else max(self.since, t)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = t if self.until is None else min(self.until, t)
            elif name == ("file",) and isinstance(f, EqualTo):
                self.only = {value} if self.only is None else self.only & {value}
            yield f


class Grid(DataSource):
    """spark.read.format("pluvia_grid"): options path, decoder, variables (comma-separated), since, until, slab_bytes."""

    @classmethod
    def name(cls) -> str:
        return "pluvia_grid"

    def schema(self) -> str:
        return columns(self.options.get("variables", ",".join(VARS)).split(","))

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options))


def scan(spark: SparkSession, root: str, kind: str = "npz", variables: list[str] | None = None, since=None, until=None, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """A row for each cell of the grid files right in root, and a row with `error` for each slab or file that can't be read.
    Only `variables` are read; absent ones are zero. since and until are inclusive."""
    decoder(kind)
    spark.dataSource.register(Grid)
    options = {"decoder": kind, "slab_bytes": str(slab_bytes), "pushdown": spark.conf.get(PUSHDOWN, "false")}
    options |= {k: str(v) for k, v in (("since", since), ("until", until)) if v is not None}
    options |= {"variables": ",".join(variables)} if variables else {}
    return spark.read.format("pluvia_grid").options(**options).load(root)


def good_cells(scanned: DataFrame) -> DataFrame:
    """Cells of the slabs that could be read."""
    return scanned.where("error IS NULL").drop("error")


def bad_files(scanned: DataFrame) -> DataFrame:
    """file, error: one row for each that has a slab which can't be read."""
    return scanned.where("error IS NOT NULL").groupBy("file").agg({"error": "min"}).withColumnRenamed("min(error)", "error")


def encode(arrays: dict[str, np.ndarray]) -> bytes:
    """One grid file."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()

