"""A keyed store of results: what was computed once, for a key with version and parameters, is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.session import cut


def cache_key(version: object, *parts: Column | object) -> Column:
    """16 hexadecimal digits of the SHA-256 of version and parts, joined by bars (a null part is a word of its own)."""
    text = [F.lit(str(version)), *[F.coalesce(p.cast("string"), F.lit("\0null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]]
    return F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 16)


def _store(rows: DataFrame, path: str, columns: list[str]) -> DataFrame | None:
    try:
        held = rows.sparkSession.read.parquet(f"{path}/*")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    # A folder for each run, since Spark takes two reads of one path for the same, whatever has been added between them.
    # Two runs at once may both have computed a key; the results of one key are alike, and one of them is enough.
    return held.select("_key", *columns).dropDuplicates(["_key"])


def cached(rows: DataFrame, key: Column, path: str, compute: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """rows with the columns that compute adds, and hit: whether the store at path (Parquet, a folder for each run) held them before.

    compute gets one row for each key that the store lacks, with all columns and _key, and gives back a row for each with
    _key and the columns; they are added to the store before anything is read from it, by Spark's own commit, so a lost task or
    a stopped run leaves whole files or none. A null key is an error."""
    keyed = rows.withColumn("_key", F.coalesce(key, F.raise_error(F.lit("a key of the score cache is null"))))
    before = _store(rows, path, columns)
    new = keyed if before is None else keyed.join(before.select("_key"), "_key", "left_anti")
    # The keys that are new are fixed before the store grows.
    fresh = cut(compute(new.dropDuplicates(["_key"])).select("_key", *columns))
    fresh.write.parquet(f"{path}/run-{uuid.uuid4().hex}")
    held = _store(rows, path, columns)
    known = fresh.select("_key", F.lit(True).alias("_new"))
    out = keyed.join(held, "_key", "left") if held is not None else keyed.withColumns({c: F.lit(None).cast(fresh.schema[c].dataType) for c in columns})
    return out.join(known, "_key", "left").select(*rows.columns, *columns, F.col("_new").isNull().alias("hit"))
