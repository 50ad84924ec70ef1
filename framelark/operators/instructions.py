"""Instructions as token ids of a fixed width with their mask."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.sources.wire import sliced


def line_ended(text: Column) -> Column:
    """The text with a line feed at its end; null is a line feed alone."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))


def tokenised(rows: DataFrame, text: str, vocabulary: str, width: int, pad: int = 0) -> DataFrame:
    """Adds tokens array<int> and mask array<boolean>, both of `width`: the ids of the whole line-ended text, cut or padded, and which of them are not padding.

    vocabulary is a tokenizers file on the driver, a few MB, which goes to the executors with the function."""
    if width < 1:
        raise ValueError("width must be 1 or more")
    names, spec = rows.columns, Path(vocabulary).read_text(encoding="utf-8")
    shared = rows.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file
    known: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        if "t" not in known:
            known["t"] = Tokenizer.from_str(shared.value)
        for b in sliced(batches):
            ids = [e.ids[:width] for e in known["t"].encode_batch(b.column(len(names)).to_pylist(), add_special_tokens=False)]
            tokens = pa.array([i + [pad] * (width - len(i)) for i in ids], pa.list_(pa.int32()))
            mask = pa.array([[True] * len(i) + [False] * (width - len(i)) for i in ids], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], tokens, mask], names=[*names, "tokens", "mask"])

    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], line_ended(F.col(f"`{text}`")).alias("line"))
    added = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.BooleanType()))]
    return plain.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
