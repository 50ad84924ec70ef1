"""Shared helpers of the corpus operators: tables, lineage cuts, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.session import ship_package

#: A word is a run of bytes that are neither space nor \t..\r; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
FLUSH_ROWS = 250_000
#: Rows of a few numbers that make a task of their own worth while.
ROWS_A_TASK = 20_000
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000
#: A counted table of up to so many bytes is broadcast.
BROADCAST_BYTES = 8 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep the batches that go to Python small: rows may hold long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is named and master is local (as in tests) one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp("-ckpt"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet files, which are smaller than a checkpoint, and their folder, which the caller deletes."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df of about that many small rows in no more tasks than they are worth; it never adds any."""
    return df.coalesce(max(8, -(-rows // ROWS_A_TASK)))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, of a counted number of rows, to be broadcast if they are few enough; else Spark deals both sides of the join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def sealed(docs: DataFrame, **roles: str) -> DataFrame:
    """The columns named by roles under the roles' names, and all others within one struct, own: no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in roles.values()]
    own = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("boolean").alias("none"))
    return docs.select(own.alias("own"), *[F.col(f"`{c}`").alias(role) for role, c in roles.items()])


def opened(df: DataFrame, columns: list[str], roles: dict[str, Column], *added: Column) -> DataFrame:
    """The columns as they were before sealed(), those in roles (by column name) with a value of their own, then the added ones."""
    return df.select(*[roles[c].alias(c) if c in roles else F.col("own")[c].alias(c) for c in columns], *added)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (an input column of that name gives way)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def numbered(names: list[str]) -> list[Column]:
    """The columns under names without dots, which the Arrow functions need of their input."""
    return [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]


def map_docs(df: DataFrame, fn: Callable[..., Iterable], inputs: list[str], added: str, keep: list[str] | None = None) -> DataFrame:
    """Append columns that fn computes for each Arrow batch from the inputs (lists of Python values).

    fn(*lists) returns one sequence for each added column. keep: columns passed through (all by default).
    """
    new = T._parse_datatype_string(added)
    keep = [c for c in (keep or df.columns) if c not in new.names]
    rows = df.select(*numbered(keep), *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    kinds = [_arrow(f.dataType) for f in new.fields]
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = fn(*[b.column(k + i).to_pylist() for i in range(len(inputs))])
                cols = [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def emit(df: DataFrame, fn: Callable[..., Iterator[tuple]], inputs: list[str], schema: str) -> DataFrame:
    """Rows of numbers from texts: fn(*lists) yields tuples of equally long numpy arrays, sent on in bounded batches."""
    out = T._parse_datatype_string(schema)
    kinds = [_arrow(f.dataType) for f in out.fields]
    rows = df.select(*[F.col(f"`{c}`") for c in inputs])

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                for part in fn(*[c.to_pylist() for c in b.columns]):
                    parts.append(part)
                    n += len(part[0])
                    if n >= FLUSH_ROWS:
                        yield batch(parts)
                        parts, n = [], 0
        if parts:
            yield batch(parts)

    return rows.mapInArrow(run, out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, from the words' hashes; none for fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    done, power, out = 0, h, None
    # Horner over powers of two: the hash of 2k words comes from two hashes of k words.
    size, left = 1, n
    while left:
        if left & 1:
            part = power[done : done + m]
            out = part.copy() if out is None else mixed(out * _MULT + part)
            done += size
        left >>= 1
        if left:
            power = mixed(power[:-size] * _MULT + power[size:]) if len(power) > size else power[:0]
            size *= 2
    return mixed(out + np.uint64(n))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    size, m = 1, a
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
