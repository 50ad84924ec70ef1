"""Readers of other files: descriptors, tagged logs, memory probes, arrays and file catalogs.

All go through Spark's own readers, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values of arrays that are sent on together, in whole arrays.
HELD_VALUES = 1 << 17


def read_json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON under a stated schema, so that no pass is spent on inferring one."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def read_tagged(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Per file, the record of the last line that starts with the tag (tag, then JSON): file, record. Files without one are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.filter(F.split("value", r"\r\n|\r|\n"), lambda x: F.startswith(x, F.lit(f"{tag} ")))
    last = F.try_element_at(lines, F.lit(-1))
    found = text.select("file", F.substring(last, len(tag) + 2, 2**31 - 1).alias("j")).where("j is not null")
    return found.select("file", F.from_json("j", schema).alias("record"))


def read_memory_info(spark: SparkSession, path: str) -> DataFrame:
    """Lines `Name:   123 kB` as (file, name, gb), where a GB is a million kB; other lines are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    kb = F.regexp_extract("value", r"^[^:]+:\s*(\d+) kB\s*$", 1)
    return lines.withColumn("kb", kb).where("kb <> ''").select("file", F.regexp_extract("value", r"^([^:]+):", 1).alias("name"), (F.col("kb").cast("double") / 1e6).alias("gb"))


def read_arrays(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """Arrays of .npz files: file, name, dtype, shape, and the values as doubles, row by row (texts as text instead).

    path is a file, a pattern, or, where there are many files, a folder whose files that fit the pattern names are read: it is listed once, and
    a pattern in path costs a listing for each file. A file is one task's work, an array one row; pickled objects are refused."""
    schema = "file string, name string, dtype string, shape array<long>, values array<double>, texts array<string>"

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string())]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "name", "dtype", "shape", "values", "texts"])
        rows, held = [], 0
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as found:
                    for name in found.files:
                        a = found[name]
                        texts = a.dtype.kind in "US"
                        rows.append((file.as_py(), name, a.dtype.str, list(a.shape), None if texts else a.astype("f8").ravel(), a.astype(str).ravel().tolist() if texts else None))
                        held += a.size
                        if held >= HELD_VALUES:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", names) if names else files
    return files.load(path).select("path", "content").mapInArrow(run, schema)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """File catalog below a folder, without contents: path, modified, length, step (number in the pattern's first group).

    Spark's reader of whole files leaves out empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    step = F.regexp_extract("path", pattern, 1)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.when(step != "", step.cast("long")).alias("step"))


def newest_file(files: DataFrame, key: str) -> DataFrame:
    """Per key the file modified last; ties go to the smaller path."""
    w = Window.partitionBy(key).orderBy(F.desc("modified"), "path")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
