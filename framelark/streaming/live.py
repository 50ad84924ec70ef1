"""Streams of frames: newest value per key, windowed reports, and a queue of planned actions.

Each operator takes a streaming DataFrame and returns one; `drain` runs a stream over all input that is
there now and returns the rows it ended with. Nothing is collected on the driver: every micro-batch is
written to the shared folder, and its checkpoint lets a lost job go on from the last whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.session import new_folder

QUEUE_STATE = "tick long, held double"


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files, with their schema; a time without zone becomes a timestamp (UTC sessions)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    s = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file as well as a folder
    for field in schema:
        if field.dataType.typeName() == "timestamp_ntz":  # a watermark needs a timestamp
            s = s.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return s


def latest(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of every key (largest by order); the backlog is dropped. Update mode."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return stream.groupBy(key).agg(newest).select(key, "r.*")


def reports(stream: DataFrame, ts: str, key: str, value: str, every: str, late: str) -> DataFrame:
    """Count and sum by window and key; rows whose window ended more than `late` before the newest row of the batches up
    to the last but one are left out (Spark judges lateness one batch behind), which is what bounds the state. Update mode."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def chunk_queue(stream: DataFrame, key: str, order: list[str], value: str, steps: int) -> DataFrame:
    """One action per call: a plan is made at every steps-th call of a key from the value seen then, and held until the next.

    Calls of one key arrive in order from batch to batch, and are ordered within a batch; a batch's calls of one key are
    in one worker's memory, so the trigger's size (files_per_batch) is its bound. A new key starts with an empty queue."""

    def run(_key, parts, state) -> Iterator:
        import pandas as pd

        calls = pd.concat(list(parts)).sort_values(order, kind="stable")
        tick, held = state.get if state.exists else (0, 0.0)
        ticks = range(tick, tick + len(calls))
        plan = []
        for t, v in zip(ticks, calls[value], strict=True):
            held = float(v) if t % steps == 0 else held
            plan.append(held)
        state.update((tick + len(calls), held))
        yield pd.DataFrame({key: calls[key].to_numpy(), order[-1]: calls[order[-1]].to_numpy(), "tick": ticks, "replan": [t % steps == 0 for t in ticks], "held": plan})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {order[-1]} {kinds[order[-1]]}, tick long, replan boolean, held double"
    s = stream.select(key, *order, value)
    return s.groupBy(key).applyInPandasWithState(run, out, QUEUE_STATE, "append", "NoTimeout")


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all input there is and returns its rows; in update mode the last row of each key."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    schema = T.StructType([*stream.schema, T.StructField("batch_no", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rows/batch=none")  # a stream without input has no batch

    def keep(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch_no", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")  # a batch that is run again replaces itself

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    if mode == "update":
        newest = Window.partitionBy(*keys).orderBy(F.desc("batch_no"))
        rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return rows.drop("batch_no")
