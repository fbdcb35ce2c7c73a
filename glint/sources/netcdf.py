"""Classic netCDF files (CDF-1, CDF-2 and CDF-5) as a Spark data source: ``spark.read.format("netcdf")`` after ``register``.

A row is one step along the row dimension (the record dimension; without one, option ``dimension`` or the first dimension of the first
variable). Columns are ``file``, ``row`` and the variables that have this dimension first, as numbers or nested arrays; option
``variables`` names those wanted, so that others aren't decoded and, unless they share records with wanted ones, not read. A file
is read in ranges of at most ``rows`` rows (option, 10000), each a partition of its own.

Values equal to a variable's ``_FillValue`` are NaN (null for integers). netCDF-4 files are HDF5, another format, and raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Fixed values of the file format: tags of lists, and of each type its number, how numpy reads it, and its column type.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES, _STREAMING = 0x0A, 0x0B, 0x0C, 0xFFFFFFFF
_TYPES: dict[int, tuple[str, DataType]] = {
    1: ("i1", ByteType()), 2: ("S1", StringType()), 3: (">i2", ShortType()), 4: (">i4", IntegerType()), 5: (">f4", FloatType()), 6: (">f8", DoubleType()),
    7: ("u1", ShortType()), 8: (">u2", IntegerType()), 9: (">u4", LongType()), 10: (">i8", LongType()), 11: (">u8", DoubleType()),
}
ROWS = 10_000


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]  # of one row, for a variable of the row dimension
    kind: int
    begin: int
    record: bool
    fill: float | None

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(_TYPES[self.kind][0])

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) * self.dtype.itemsize


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    row: str
    rows: int
    record_bytes: int
    variables: dict[str, Variable]  # those of the row dimension


class _Bytes:
    """Numbers and names of a header, read on demand."""

    def __init__(self, file, wide: bool):
        self.file, self.wide = file, wide

    def take(self, n: int) -> bytes:
        got = self.file.read(n)
        if len(got) < n:
            raise ValueError("the header is cut off")
        return got

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "big")

    def count(self) -> int:
        return self.number(8 if self.wide else 4)

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def list_of(self, tag: int) -> range:
        found, n = self.number(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header is not of a netCDF file")
        return range(n)

    def attributes(self) -> dict[str, object]:
        out = {}
        for _ in self.list_of(_ATTRIBUTES):
            name, kind = self.name(), self.number()
            n = self.count()
            kind_of = np.dtype(_TYPES[kind][0])
            raw = self.padded(n * kind_of.itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, kind_of)
        return out


def header(file, size: int, dimension: str | None = None) -> Header:
    """The header of an open file of ``size`` bytes."""
    magic = file.read(4)
    if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02", b"\x05"):
        raise ValueError("netCDF-4 (HDF5) files can't be read" if magic[1:4] == b"HDF" else "not a classic netCDF file")
    version = magic[3]
    b = _Bytes(file, version == 5)
    records = b.count()
    dims = [(b.name(), b.count()) for _ in b.list_of(_DIMENSIONS)]
    b.attributes()
    found = []
    for _ in b.list_of(_VARIABLES):
        name = b.name()
        ids = [b.count() for _ in range(b.count())]
        attributes, kind = b.attributes(), b.number()
        b.count()  # the size that the file states overflows for large variables
        found.append((name, ids, attributes, kind, b.number(4 if version == 1 else 8)))
    unlimited = next((i for i, (_, n) in enumerate(dims) if n == 0), None)
    of = lambda ids: bool(ids) and ids[0] == unlimited
    if unlimited is None and dimension is None and found:
        dimension = next((dims[ids[0]][0] for _, ids, *_ in found if ids), None)
    row = dims[unlimited][0] if unlimited is not None and dimension is None else dimension or ""
    made = {}
    for name, ids, attributes, kind, begin in found:
        if ids and dims[ids[0]][0] == row:
            fill = attributes.get("_FillValue")
            made[name] = Variable(name, tuple(dims[i][0] for i in ids), tuple(dims[i][1] for i in ids[1:]), kind, begin, of(ids), None if fill is None or isinstance(fill, str) else float(fill[0]))
    sizes = [int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * np.dtype(_TYPES[kind][0]).itemsize for _, ids, _, kind, _ in found if of(ids)]
    record_bytes = sizes[0] if len(sizes) == 1 else sum(n + -n % 4 for n in sizes)  # a lone record variable isn't padded
    begins = [begin for _, ids, _, _, begin in found if of(ids)]
    if records == _STREAMING or (b.wide and records == 2**64 - 1):
        records = (size - min(begins)) // record_bytes if begins and record_bytes else 0
    rows = records if unlimited is not None and row == dims[unlimited][0] else dict(dims).get(row, 0)
    return Header(dict(dims), row, rows, record_bytes, made)


def column_type(v: Variable) -> DataType:
    out, shape = _TYPES[v.kind][1], v.shape[:-1] if v.kind == 2 else v.shape
    for _ in shape:
        out = ArrayType(out)
    return out


def values(file, h: Header, v: Variable, lo: int, hi: int, block: bytes | None, base: int) -> pa.Array:
    """Rows lo to hi of a variable; ``block`` holds the records from ``base`` on."""
    n = hi - lo
    if v.record:
        # a row's values stand together, rows are a record apart
        raw = np.ndarray((n, v.row_bytes), np.uint8, block, v.begin - base, (h.record_bytes, 1)) if n else np.zeros((0, v.row_bytes), np.uint8)
        x = np.ascontiguousarray(raw).view(v.dtype).reshape((n, *v.shape))
    else:
        file.seek(v.begin + lo * v.row_bytes)
        raw = file.read(n * v.row_bytes)
        if len(raw) < n * v.row_bytes:
            raise ValueError(f"{v.name} is cut off")
        x = np.frombuffer(raw, v.dtype).reshape((n, *v.shape))
    if v.kind == 2:
        flat = x.reshape(-1, v.shape[-1] if v.shape else 1)
        out = pa.array([r.tobytes().rstrip(b"\0").decode(errors="replace") for r in flat], pa.string())
        shape = v.shape[:-1]
    else:
        x = x.astype(x.dtype.newbyteorder("="))
        gone = None if v.fill is None else x == np.asarray(v.fill).astype(x.dtype)
        kind = _ARROW[_TYPES[v.kind][1].typeName()]
        if x.dtype.kind == "f":
            out = pa.array((x if gone is None else np.where(gone, np.asarray(np.nan, x.dtype), x)).ravel(), kind)
        else:
            out = pa.array(x.ravel(), mask=None if gone is None else gone.ravel()).cast(kind)
        shape = v.shape
    for k in range(len(shape) - 1, -1, -1):
        rows = n * int(np.prod(shape[:k], dtype=np.int64))
        out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * shape[k], pa.int32()), out)
    return out


_ARROW = {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def _opened(path: str):
    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store, inside


def files(path: str) -> list[str]:
    """The file, or the .nc files below the folder, in order."""
    store, inside = _opened(path)
    if store.get_file_info(inside).type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File and f.extension == "nc")


def _header_of(path: str, dimension: str | None) -> Header:
    store, inside = _opened(path)
    with store.open_input_file(inside) as f:
        return header(f, f.size(), dimension)


@dataclass
class Stretch(InputPartition):
    path: str
    lo: int
    hi: int


class Source(DataSource):
    """Options: path, variables (names with commas), dimension, rows."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _wanted(self, h: Header) -> list[Variable]:
        named = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        if missing := [v for v in named if v not in h.variables]:
            raise ValueError(f"no such variables along {h.row}: {missing}")
        return [h.variables[v] for v in named] or list(h.variables.values())

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no .nc files in {self.options['path']}")
        own = self._wanted(_header_of(found[0], self.options.get("dimension")))
        return StructType([StructField("file", StringType()), StructField("row", LongType()), *[StructField(v.name, column_type(v)) for v in own]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("dimension"), int(self.options.get("rows", ROWS)), schema)


class Reader(DataSourceReader):
    def __init__(self, path: str, dimension: str | None, rows: int, schema: StructType):
        self.path, self.dimension, self.rows, self.names = path, dimension, max(1, rows), [f.name for f in schema][2:]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files(self.path):
            n = _header_of(path, self.dimension).rows
            out += [Stretch(path, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, inside = _opened(partition.path)
        lo, hi = partition.lo, partition.hi
        with store.open_input_file(inside) as f:
            h = header(f, f.size(), self.dimension)
            if missing := [v for v in self.names if v not in h.variables]:
                raise ValueError(f"{partition.path} has no {missing}")
            own = [h.variables[v] for v in self.names]
            block, base = None, 0
            if together := [v for v in own if v.record]:
                # from the first wanted variable of the first record to the last one of the last record
                base = min(v.begin for v in together)
                length = (hi - lo - 1) * h.record_bytes + max(v.begin + v.row_bytes for v in together) - base
                f.seek(base + lo * h.record_bytes)
                block = f.read(length)
                if len(block) < length:
                    raise ValueError(f"{partition.path} is cut off")
            columns = [pa.array([partition.path] * (hi - lo)), pa.array(np.arange(lo, hi)), *[values(f, h, v, lo, hi, block, base) for v in own]]
        yield pa.RecordBatch.from_arrays(columns, ["file", "row", *self.names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Source)
