"""Writers of binary files by tasks: point files and archives of arrays.

Every task writes files of its own under names that no other attempt uses; the commit names those that count in _files.json and
removes what other attempts left. A target that holds files is an error unless force is set.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framelark.operators.points import CHUNK
from framelark.session import ship_package
from framelark.sources.ranged import PLY_TYPES, opened

MANIFEST = "_files.json"
#: File types of the columns of a point file.
_KINDS = {pa.int16(): "uchar", pa.int32(): "int", pa.int64(): "uint", pa.float32(): "float", pa.float64(): "double"}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Writes runs of rows with one value in the first column as a file each; subclasses make the bytes."""

    suffix = ""

    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def save(self, out, batches: Iterator[pa.Table]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, runs = [], _runs(iterator)
        fs, folder = opened(self.folder)
        for value, batches in runs:
            name = f"part-{value:06d}-{uuid.uuid4().hex}{self.suffix}"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                self.save(out, batches)
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        count = set(names)
        fs, folder = opened(self.folder)
        fs.create_dir(folder)
        for f in fs.get_file_info(stores.FileSelector(folder)):  # of attempts that were run again
            if f.is_file and f.base_name.startswith("part-") and f.base_name not in count:
                fs.delete_file(f.path)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.folder)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{folder}/{name}")


def _runs(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of equal values in the first column of sorted batches, each with its rows as they come."""
    held: list[pa.RecordBatch] = []

    def rows(value: int) -> Iterator[pa.RecordBatch]:
        while True:
            if not held:
                one = next(iterator, None)
                if one is None:
                    return
                if not one.num_rows:
                    continue
                held.append(one)
            b = held.pop()
            first = b.column(0).to_numpy()
            n = int(np.searchsorted(first, value, "right"))
            if n < b.num_rows:
                held.append(b.slice(n))
            if n:
                yield b.slice(0, n)
            if n < b.num_rows:
                return

    while True:
        while not held:
            one = next(iterator, None)
            if one is None:
                return
            if one.num_rows:
                held.append(one)
        value = held[0].column(0)[0].as_py()
        mine = rows(value)
        yield value, mine
        for _ in mine:
            pass


class PointWriter(FileWriter):
    """Binary little-endian PLY: elements chunk (columns min_... and max_..., from every 256th row), vertex, and sh (f_rest_...), as far as there are such columns; without chunks all are the vertex's."""

    suffix = ".ply"

    def save(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(list(batches)).drop_columns(["part", "id"])  # the rows of one file
        of = lambda n: "chunk" if n.startswith(("min_", "max_")) else "sh" if n.startswith("f_rest_") else "vertex"
        chunked = any(of(n) == "chunk" for n in rows.column_names)
        head, bodies = ["ply", "format binary_little_endian 1.0"], []
        for element in ("chunk", "vertex", "sh") if chunked else ("vertex",):
            names = [n for n in rows.column_names if not chunked or of(n) == element]
            if not names:
                continue
            some = rows.select(names)
            some = some.take(np.arange(0, rows.num_rows, CHUNK)) if element == "chunk" else some
            types = [_KINDS[some.schema.field(n).type] for n in names]
            body = np.empty(some.num_rows, [(n, "<" + PLY_TYPES[k]) for n, k in zip(names, types, strict=True)])
            for n in names:
                body[n] = some[n].to_numpy()
            head += [f"element {element} {len(body)}", *[f"property {k} {n}" for n, k in zip(names, types, strict=True)]]
            bodies.append(body)
        out.write(("\n".join([*head, "end_header"]) + "\n").encode())
        for body in bodies:
            out.write(body.tobytes())


class BytesWriter(FileWriter):
    """The bytes of (part, at, data), one after another."""

    suffix = ".bin"

    def save(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        for b in batches:
            for data in b.column("data"):
                out.write(data.as_buffer())


class ArchiveWriter(FileWriter):
    """One npz archive for each value of the first column, of rows (archive, name, piece, dtype, shape, values): pieces go on as they come."""

    suffix = ".npz"

    def save(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        with zipfile.ZipFile(_Forward(out), "w") as z:
            name, entry, left = None, None, 0
            for b in batches:
                keys = b.column("name").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edges, edges[1:]):  # the pieces of one array
                    if keys[lo] != name:
                        _finished(name, entry, left)
                        name, kind, shape = keys[lo], np.dtype(b.column("dtype")[lo].as_py()), tuple(b.column("shape")[lo].as_py())
                        left = int(np.prod(shape, dtype=np.int64))
                        entry = z.open(f"{name}.npy", "w", force_zip64=True)
                        np.lib.format.write_array_header_2_0(entry, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
                    values = b.column("values").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).astype(kind)
                    left -= len(values)
                    entry.write(values.tobytes())
            _finished(name, entry, left)


def _finished(name: str | None, entry, left: int) -> None:
    if entry is not None:
        entry.close()
        if left:
            raise ValueError(f"array {name}: its pieces hold {abs(left)} values {'too few' if left > 0 else 'too many'} for its shape")


class _Forward:
    """A stream that only goes forward, as zipfile wants it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class _Sink(DataSource):
    writers = {"point_files": PointWriter, "array_archives": ArchiveWriter, "byte_files": BytesWriter}

    def schema(self) -> T.StructType:
        raise NotImplementedError

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return self.writers[self.name()](self.options["path"], schema)


class PointSink(_Sink):
    @classmethod
    def name(cls) -> str:
        return "point_files"


class ArchiveSink(_Sink):
    @classmethod
    def name(cls) -> str:
        return "array_archives"


class BytesSink(_Sink):
    @classmethod
    def name(cls) -> str:
        return "byte_files"


def _write(rows: DataFrame, sink: type[_Sink], path: str, force: bool) -> None:
    fs, at = opened(path)
    if not force and any(not f.base_name.startswith(".") for f in fs.get_file_info(stores.FileSelector(at, allow_not_found=True))):
        raise FileExistsError(f"{path} is not empty")
    fs.create_dir(at)
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(sink)
    rows.write.format(sink.name()).mode("append").options(path=path).save()


def write_points(points: DataFrame, path: str, part_rows: int = CHUNK << 10, force: bool = False) -> None:
    """points (id, dense from 0, and the fields of a file, shorts as bytes and longs as unsigned ints) as files of part_rows vertices, a multiple of 256; a task holds one file's rows."""
    if part_rows < CHUNK or part_rows % CHUNK:
        raise ValueError(f"part_rows must be a multiple of {CHUNK}")
    rows = points.withColumn("part", F.expr(f"id div {part_rows}"))
    rows = rows.select("part", *points.columns).repartition("part").sortWithinPartitions("part", "id")
    _write(rows, PointSink, path, force)


def write_arrays(pieces: DataFrame, path: str, force: bool = False) -> None:
    """An npz archive for each archive of (archive long, name, piece long, dtype, shape, values array<double>).

    The pieces of an array follow one another in order of piece, and must fill its shape (else an error); a task holds one piece at a time."""
    rows = pieces.select("archive", "name", "piece", "dtype", "shape", "values").repartition("archive").sortWithinPartitions("archive", "name", "piece")
    _write(rows, ArchiveSink, path, force)


def write_bytes(pieces: DataFrame, path: str, force: bool = False) -> None:
    """A file for each part of (part long, at long, data binary): its pieces in order of at."""
    _write(pieces.select("part", "at", "data").repartition("part").sortWithinPartitions("part", "at"), BytesSink, path, force)
