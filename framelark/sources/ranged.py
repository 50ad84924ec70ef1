"""Sources that read byte ranges of large binary files: point clouds, tensor headers and raw grey frames.

A file is cut into ranges of whole records, and a task asks the store for its ranges alone; many short ones are dealt to few tasks.
Paths are plain, file:, or of a store that pyarrow knows (hdfs, s3, gs); a folder means the files directly below it, names with
* and ? are patterns in the last part of a path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelark.session import ship_package

#: File scalar types of the PLY format, as NumPy names.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
_SPARK_TYPES = {"i1": T.ShortType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_ARROW_TYPES = {T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64()}
#: Most rows of a task, rows of a batch, first bytes asked for a point file's header, and the longest one.
TASK_ROWS, BATCH_ROWS, HEAD_BYTES, HEADER_BYTES = 1 << 20, 1 << 16, 1 << 12, 1 << 20
#: Up to so many tasks each has one file or range; of more, some are one task's, as they are too short to be worth one each.
TASKS = 192
#: Most headers of a task.
FILES = 1 << 12


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path within it."""
    if path.startswith("file:"):
        return stores.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path means, by name."""
    fs, at = opened(path)
    folder, _, last = at.rstrip("/").rpartition("/")
    if re.search(r"[*?]", last):
        found = [f for f in fs.get_file_info(stores.FileSelector(folder or "/")) if fnmatchcase(f.base_name, last)]
    else:
        (one,) = fs.get_file_info([at])
        if one.type == stores.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else fs.get_file_info(stores.FileSelector(at))
    scheme = path[: path.find(at)]
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def part(path: str, start: int, length: int) -> bytes:
    """length bytes of a file from start on; an error if there are fewer."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        got = f.read(length)
    if len(got) < length:
        raise ValueError(f"{path}: {length} bytes expected from byte {start} on, there are {len(got)}")
    return got


@dataclass
class Several(InputPartition):
    """Files or ranges that one task reads, one after the other."""

    each: list


def dealt(each: list, size: Callable[[object], int], most: int) -> list[Several]:
    """Runs of files or ranges: each one alone if there are no more than TASKS; else an equal share of their sizes, but no more than most unless one alone is."""
    share = 1 if len(each) <= TASKS else -(-sum(map(size, each)) // TASKS)
    out, held = [], 0
    for one in each:
        if not out or held >= share or held + size(one) > most:
            out.append(Several([]))
            held = 0
        out[-1].each.append(one)
        held += size(one)
    return out


@dataclass
class Element:
    """A run of equal records in a point file."""

    name: str
    count: int
    fields: list[tuple[str, str]] = field(default_factory=list)
    start: int = 0

    @property
    def kind(self) -> np.dtype:
        return np.dtype([(n, "<" + k) for n, k in self.fields])

    def ordered(self) -> list[tuple[str, str]]:
        """The fields in file order, but numbered ones (f_rest_2, f_rest_10) by number at the place of the first of them."""
        stem = lambda n: re.sub(r"\d+$", "", n)
        first: dict[str, int] = {}
        for at, (n, _) in enumerate(self.fields):
            first.setdefault(stem(n), at)
        number = lambda n: int(re.search(r"(\d+)$|$", n)[1] or -1)
        return sorted(self.fields, key=lambda f: (first[stem(f[0])], number(f[0])))


def point_layout(path: str, size: int) -> dict[str, Element]:
    """Elements of a binary little-endian PLY file by name, from its header alone. Property lists are an error."""
    head = part(path, 0, min(size, HEAD_BYTES))
    stop = head.find(b"end_header\n")
    if stop < 0 and head.startswith(b"ply\n") and size > len(head):
        head = part(path, 0, min(size, HEADER_BYTES))
        stop = head.find(b"end_header\n")
    lines = head[:stop].decode("ascii").split("\n") if stop >= 0 else []
    if lines[:2] != ["ply", "format binary_little_endian 1.0"]:
        raise ValueError(f"{path}: not a binary little-endian PLY file")
    elements: list[Element] = []
    for words in map(str.split, lines):
        if words[:1] == ["element"]:
            elements.append(Element(words[1], int(words[2])))
        elif words[:1] == ["property"]:
            if words[1] not in PLY_TYPES:
                raise ValueError(f"{path}: property {words[1]} is not read")
            elements[-1].fields.append((words[2], PLY_TYPES[words[1]]))
    at = stop + len(b"end_header\n")
    for e in elements:
        e.start, at = at, at + e.count * e.kind.itemsize
    if at > size:
        raise ValueError(f"{path}: {at} bytes announced, there are {size}")
    return {e.name: e for e in elements}


@dataclass
class _Rows(InputPartition):
    path: str
    lo: int
    hi: int
    elements: list[Element]


def _length(p: _Rows) -> int:
    return p.hi - p.lo


class PointReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], rows: int, fields: list[tuple[str, str]]):
        self.path, self.names, self.rows, self.fields = path, names, rows, fields

    def partitions(self) -> list[Several]:
        out = []
        for path, size in listed(self.path):
            elements = _asked(path, point_layout(path, size), self.names)
            if sum((e.ordered() for e in elements), []) != self.fields:
                raise ValueError(f"{path}: other fields than the first file's")
            n = elements[0].count
            out += [_Rows(path, lo, min(n, lo + self.rows), elements) for lo in range(0, n, self.rows)]
        return dealt(out, _length, TASK_ROWS) or [Several([])]

    def read(self, some: Several) -> Iterator[pa.RecordBatch]:
        for p in some.each:
            yield from self.rows_of(p)

    def rows_of(self, p: _Rows) -> Iterator[pa.RecordBatch]:
        kinds = [_ARROW_TYPES[_SPARK_TYPES[k]] for _, k in self.fields]
        for lo in range(p.lo, p.hi, BATCH_ROWS):
            n = min(p.hi - lo, BATCH_ROWS)
            found = {}
            for e in p.elements:
                rows = np.frombuffer(part(p.path, e.start + lo * e.kind.itemsize, n * e.kind.itemsize), e.kind)
                found |= {name: rows[name] for name in rows.dtype.names or ()}
            cols = [pa.array([p.path] * n), pa.array(np.arange(lo, lo + n)), *[pa.array(np.ascontiguousarray(found[f])).cast(k) for (f, _), k in zip(self.fields, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "id", *[f for f, _ in self.fields]])


def _asked(path: str, layout: dict[str, Element], names: list[str]) -> list[Element]:
    missing = [n for n in names if n not in layout]
    if missing:
        raise ValueError(f"{path}: no element {missing}; there are {sorted(layout)}")
    found = [layout[n] for n in names]
    if len({e.count for e in found}) > 1:
        raise ValueError(f"{path}: elements {names} have different numbers of rows {[e.count for e in found]}")
    return found


class PointSource(DataSource):
    """Options path, elements (comma-separated; those beside the first have as many rows), rows of a task."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def _fields(self) -> list[tuple[str, str]]:
        files = listed(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no point files at {self.options['path']}")
        return sum((e.ordered() for e in _asked(files[0][0], point_layout(*files[0]), self._names())), [])

    def _names(self) -> list[str]:
        return self.options.get("elements", "vertex").split(",")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("id", T.LongType()), *[T.StructField(n, _SPARK_TYPES[k]) for n, k in self._fields()]])

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self.options["path"], self._names(), int(self.options.get("rows", TASK_ROWS)), self._fields())


@dataclass
class _File(InputPartition):
    path: str
    size: int


class TensorReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Several]:
        return dealt([_File(*f) for f in listed(self.path)], lambda f: 1, FILES) or [Several([])]

    def read(self, some: Several) -> Iterator[tuple]:
        for p in some.each:
            yield from self.entries(p)

    def entries(self, p: _File) -> Iterator[tuple]:
        length = int.from_bytes(part(p.path, 0, 8), "little")
        if 8 + length > p.size:
            raise ValueError(f"{p.path}: the header is cut off")
        for key, spec in json.loads(part(p.path, 8, length)).items():
            if key != "__metadata__":
                yield p.path, key, spec["dtype"], spec["shape"], *spec["data_offsets"]


class TensorSource(DataSource):
    """Headers of safetensors files: eight bytes of little-endian length, then JSON; nothing behind them is read."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "file string, key string, dtype string, shape array<long>, first_byte long, last_byte long"

    def reader(self, schema: T.StructType) -> TensorReader:
        return TensorReader(self.options["path"])


class FrameReader(DataSourceReader):
    def __init__(self, path: str, width: int, height: int, step: int, scale: int, frames: int):
        self.path, self.width, self.height, self.step, self.scale, self.frames = path, width, height, step, scale, frames

    def partitions(self) -> list[Several]:
        out = []
        for path, size in listed(self.path):
            n = size // (self.width * self.height)  # what is left of a frame at the end is none
            chosen = -(-n // self.step)
            out += [_Rows(path, lo, min(chosen, lo + self.frames), []) for lo in range(0, chosen, self.frames)]
        return dealt(out, _length, TASK_ROWS) or [Several([])]

    def read(self, some: Several) -> Iterator[tuple]:
        for p in some.each:
            yield from self.frames_of(p)

    def frames_of(self, p: _Rows) -> Iterator[tuple]:
        size, s = self.width * self.height, self.scale
        h, w = self.height // s, self.width // s
        for k in range(p.lo, p.hi):
            grey = np.frombuffer(part(p.path, k * self.step * size, size), np.uint8).reshape(self.height, self.width)
            blocks = grey[: h * s, : w * s].reshape(h, s, w, s).astype(np.uint32).sum((1, 3))
            yield p.path, k * self.step, h, w, ((2 * blocks + s * s) // (2 * s * s)).astype(np.uint8).tobytes()


class FrameSource(DataSource):
    """Every step-th frame of files of raw grey frames, at 1/scale by means of whole blocks (halves up): options path, width, height, step, scale, frames of a task."""

    @classmethod
    def name(cls) -> str:
        return "grey_frames"

    def schema(self) -> str:
        return "file string, frame long, height int, width int, pixels binary"

    def reader(self, schema: T.StructType) -> FrameReader:
        number = {k: int(self.options.get(k, v)) for k, v in (("width", 0), ("height", 0), ("step", 1), ("scale", 1), ("frames", 256))}
        if min(number.values()) < 1 or number["scale"] > min(number["width"], number["height"]):
            raise ValueError(f"width, height, step, scale and frames must be 1 or more, and scale no larger than a frame: {number}")
        return FrameReader(self.options["path"], **number)


def _source(spark: SparkSession, kind: type[DataSource], path: str, **options: object) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(path=path, **options).load()


def read_points(spark: SparkSession, path: str, *elements: str, rows: int = TASK_ROWS) -> DataFrame:
    """file, id (from 0) and the fields of one element of point files (vertex, if none is named), and of others that have as many rows."""
    return _source(spark, PointSource, path, elements=",".join(elements or ("vertex",)), rows=rows)


def read_tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """Tensor catalog: file, key, dtype, shape, first_byte, last_byte (from the end of the header), n_params."""
    from pyspark.sql import functions as F

    found = _source(spark, TensorSource, path)
    return found.withColumn("n_params", F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x))


def read_grey_frames(spark: SparkSession, path: str, width: int, height: int, step: int = 1, scale: int = 1, frames: int = 256) -> DataFrame:
    """file, frame, height, width, pixels of every step-th frame; frames: how many a task reads."""
    return _source(spark, FrameSource, path, width=width, height=height, step=step, scale=scale, frames=frames)
