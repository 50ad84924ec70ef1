"""A dataset that grows by batches: frames are added, episodes are saved, and only saved ones are seen.

Below the target, frames/ has what each batch added and saved/ which episodes it saved, a folder for each batch's number. A batch that is
run again replaces its own folders and nothing else, so frames come once however often a batch is tried. Saving is the commit: an
episode is seen from the batch that saves it, with the frames of that batch and those before; frames added to it later are an
error when the dataset is read or finalised.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.sinks.datasets import write_dataset


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def create(spark: SparkSession, path: str, fps: float) -> None:
    """A new dataset; an error if there is one."""
    if fps <= 0:
        raise ValueError("fps must be above 0")
    spark.createDataFrame([(float(fps),)], "fps double").coalesce(1).write.parquet(f"{path}/info")


def add_frames(frames: DataFrame, path: str, batch: int) -> None:
    """Frames (ep, frame, ...) of a batch."""
    frames.write.mode("overwrite").parquet(f"{path}/frames/batch={batch}")


def save_episodes(episodes: DataFrame, path: str, batch: int) -> None:
    """Commits the episodes (ep) that end with this batch, after its frames were added."""
    episodes.select("ep").distinct().write.mode("overwrite").parquet(f"{path}/saved/batch={batch}")


def saved_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of saved episodes, as they were added; no rows without any."""
    frames, saved = _read(spark, f"{path}/frames"), _read(spark, f"{path}/saved")
    if frames is None or saved is None:
        raise ValueError(f"{path}: no batch has saved an episode yet")
    first = saved.groupBy("ep").agg(F.min("batch").alias("until"))
    late = F.raise_error(F.concat(F.lit("frames were added to episode "), F.col("ep").cast("string"), F.lit(" after it was saved")))
    seen = frames.join(first, "ep")
    return seen.withColumn("ep", F.when(F.col("batch") > F.col("until"), late.cast(seen.schema["ep"].dataType)).otherwise(F.col("ep"))).drop("batch", "until")


def finalize(spark: SparkSession, path: str, target: str, force: bool = False) -> None:
    """The saved episodes as a dataset of its own, numbered anew; an error if there are none."""
    frames = saved_frames(spark, path)
    if frames.isEmpty():
        raise ValueError(f"{path}: no episode is saved")
    write_dataset(frames, target, spark.read.parquet(f"{path}/info").first()["fps"], force)


def stream_episodes(stream: DataFrame, path: str, checkpoint: str, last: str):
    """A running query that adds every micro-batch of frames and saves the episodes that have their last frame (a boolean column) in it."""

    def keep(rows: DataFrame, number: int) -> None:
        rows.persist()
        add_frames(rows.drop(last), path, number)
        save_episodes(rows.where(last), path, number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
