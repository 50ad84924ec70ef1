"""Frame tables: one row per recorded frame (ep, frame, state, slew, move).

Test tables have no recordings, so `event_frames` maps the events table: an episode per user, frames in
time order, state = value, and two command channels, slew (clicks) and move (purchases), as value / 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet shards below a dataset folder."""
    return spark.read.option("recursiveFileLookup", "true").parquet(root)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    channel = lambda kind: F.when(F.col("event_type") == kind, F.col("value") / 100).otherwise(F.lit(0.0))
    return e.select(
        F.col("user_id").alias("ep"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "event_id", "ts",
        "event_type", F.col("value").alias("state"), channel("click").alias("slew"), channel("purchase").alias("move"),
    )


#: The same frames for the checking SQL.
FRAMES_SQL = """f AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, ts, event_type, value AS state,
  CASE WHEN event_type = 'click' THEN value / 100 ELSE 0.0 END AS slew, CASE WHEN event_type = 'purchase' THEN value / 100 ELSE 0.0 END AS move FROM events)"""


def with_gradient(frames: DataFrame, rows: int) -> DataFrame:
    """Each frame (a column frame) once for each row of a synthetic moving gradient: adds row and level, the same at every run."""
    f = frames.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    return f.withColumn("level", (F.col("frame") * 3 + F.col("row") * 5) % 256)


def gradient_frames(spark: SparkSession, frames: int, rows: int) -> DataFrame:
    """(frame, row, level) of a gradient of its own."""
    return with_gradient(spark.range(frames).select(F.col("id").alias("frame")), rows)


def real_or_gradient(spark: SparkSession, path: str, frames: int, rows: int) -> DataFrame:
    """The recorded frames at path; the synthetic ones if nothing is there. Other errors are raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return gradient_frames(spark, frames, rows)
