"""Selected frames as files frame_0001.jpg and on, a folder for each group, in place of those that were there before.

Every call writes a take: a folder of its own below the target, which counts once the commit has named it in _take.json. The takes before it are removed
then, whole, so no frame of an earlier selection is left and a call that fails before that leaves the earlier one as it was.

Files are many and short, so tasks list, read and remove them, group by group, and the driver holds no list of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framelark.operators.packing import running
from framelark.session import ship_package
from framelark.sources.ranged import opened

POINTER, TAKE = "_take.json", "take-"
#: Files of a group that one task writes, and files and bytes of a batch that is read (one file alone may be longer).
RUN_FILES, BATCH_FILES, BATCH_BYTES = 1 << 10, 1 << 10, 1 << 22


class FrameFiles(DataSourceArrowWriter):
    """A file for each row (name, data). An attempt that is run again replaces the files of the one before, which hold the same bytes."""

    def __init__(self, folder: str, take: str):
        self.folder, self.take = folder, take

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = opened(self.folder)
        made = set()
        for b in iterator:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                target = f"{folder}/{self.take}/{name}"
                home = target.rpartition("/")[0]
                if home not in made:
                    fs.create_dir(home)
                    made.add(home)
                passing = f"{home}/.{uuid.uuid4().hex}"  # so that a file is whole as soon as it has its name; one folder for all would be fought over
                with fs.open_output_stream(passing) as out:
                    out.write(data.as_buffer())
                fs.move(passing, target)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = opened(self.folder)
        fs.create_dir(f"{folder}/{self.take}")
        with fs.open_output_stream(f"{folder}/{POINTER}") as out:
            out.write(json.dumps(self.take).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = opened(self.folder)
        if fs.get_file_info(f"{folder}/{self.take}").type == stores.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.take}")


class FrameSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> T.StructType:
        raise NotImplementedError

    def writer(self, schema: T.StructType, overwrite: bool) -> FrameFiles:
        return FrameFiles(self.options["path"], self.options["take"])


def write_frame_files(selected: DataFrame, path: str, group: str, order: str, data: str, suffix: str = ".jpg") -> None:
    """selected (group, order, data binary) as <group>/frame_0001<suffix> and on, numbered from 1 in order within each group; rows without data are left out.

    order names a row of its group. Numbers are counted by blocks, so a large group is not one task's work."""
    rows = selected.where(F.col(data).isNotNull() & F.col(group).isNotNull() & F.col(order).isNotNull())
    numbered = running(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(data).alias("data"), F.lit(1).cast("long").alias("one")), ["g"], "o", {"n": "one"})
    name = F.concat(F.col("g").cast("string"), F.lit("/frame_"), F.when(F.col("n") < 10000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string")), F.lit(suffix))
    spark = selected.sparkSession
    dealt = numbered.repartition(_tasks(spark), "g", F.expr(f"n div {RUN_FILES}"))
    fs, at = opened(path)
    fs.create_dir(at)
    ship_package(spark)
    spark.dataSource.register(FrameSink)
    take = f"{TAKE}{uuid.uuid4().hex}"
    dealt.select(name.alias("name"), "data").write.format("frame_files").mode("append").options(path=path, take=take).save()
    for f in fs.get_file_info(stores.FileSelector(at)):
        if f.base_name.startswith(TAKE) and f.base_name != take:
            _remove(spark, f"{path}/{f.base_name}")


def _tasks(spark: SparkSession) -> int:
    """Tasks that groups and files are dealt to. Their rows are short and the work is not, so a number by bytes would be too few."""
    return 8 * spark.sparkContext.defaultParallelism


def _below(spark: SparkSession, folder: str) -> DataFrame:
    """(path, is_file) of what is directly below a folder, within its store: the groups of a take. One task lists them, the rows are dealt to many."""

    def run(batches):
        fs, at = opened(folder)
        for b in batches:
            if b.num_rows:
                found = fs.get_file_info(stores.FileSelector(at))
                yield pa.record_batch([pa.array([f.path for f in found], pa.string()), pa.array([f.is_file for f in found], pa.bool_())], ["path", "is_file"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "path string, is_file boolean").repartition(_tasks(spark), "path")


def _remove(spark: SparkSession, take: str) -> None:
    def run(rows):
        fs, _ = opened(take)
        for r in rows:
            kind = fs.get_file_info(r.path).type  # an attempt before may have removed it
            if kind == stores.FileType.Directory:
                fs.delete_dir(r.path)
            elif kind == stores.FileType.File:
                fs.delete_file(r.path)

    _below(spark, take).foreachPartition(run)
    fs, at = opened(take)
    fs.delete_dir(at)


def current_take(path: str) -> str:
    """The folder of the frames that count; an error if none were written."""
    fs, at = opened(path)
    with fs.open_input_stream(f"{at}/{POINTER}") as f:
        return f"{path}/{json.loads(f.read())}"


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """(group string, name, content) of the frames that count.

    A task lists whole groups, another reads files of any: the list of a group's files is one task's work, their contents are not."""
    take = current_take(path)

    def listed(batches):
        fs, _ = opened(take)
        for b in batches:
            for p, is_file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = [p] if is_file else [f.path for f in fs.get_file_info(stores.FileSelector(p, recursive=True)) if f.is_file]
                yield pa.record_batch([pa.array([n for n in names if n.rpartition("/")[2].startswith("frame_")], pa.string())], ["path"])

    def read(batches):
        fs, _ = opened(take)
        batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["group", "name", "content"])
        rows, held = [], 0
        for b in batches:
            for p in b.column(0).to_pylist():
                with fs.open_input_stream(p, compression=None) as f:  # as it is, whatever its suffix
                    content = f.read()
                folder, _, name = p.rpartition("/")
                rows.append((folder.partition(f"/{take.rpartition('/')[2]}/")[2], name, content))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    ship_package(spark)
    files = _below(spark, take).mapInArrow(listed, "path string").repartition(_tasks(spark), "path")
    return files.mapInArrow(read, "group string, name string, content binary")
