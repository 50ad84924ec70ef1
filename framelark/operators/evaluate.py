"""Fixed-horizon scoring of prediction runs against recorded truth, and checkpoint curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import nano, ratio6


def eval_points(episodes: DataFrame, need: int, stride: int) -> DataFrame:
    """(ep, start): every stride-th start with `need` frames after it; a start that fits exactly is left out."""
    return episodes.where(F.col("n") > need).select("ep", F.explode(F.expr(f"sequence(0L, n - {need} - 1, {stride}L)")).alias("start"))


def grid(points: DataFrame, frames: DataFrame, steps: int) -> DataFrame:
    """Truth at each point and step (ep, start, t, joint, gt): offsets are generated, then an equi-join, no range join."""
    at = points.select("ep", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t")).withColumn("frame", F.col("start") + F.col("t"))
    return at.join(frames, ["ep", "frame"]).selectExpr("ep", "start", "t", "stack(2, 'slew', slew, 'move', move) as (joint, gt)")


def score(pairs: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """pairs (keys, ep, start, t, joint, pred, gt) -> mae, disp_err (mean |sum of errors / rate| per point and joint), move_ratio."""
    e, p, g = nano(F.col("pred") - F.col("gt")), nano(F.col("pred")), nano(F.col("gt"))
    per = pairs.groupBy(*keys, "ep", "start", "joint").agg(F.sum(e).alias("e"), F.sum(F.abs(e)).alias("ae"), F.sum(F.abs(p)).alias("ap"), F.sum(F.abs(g)).alias("ag"), F.count("pred").alias("k"))
    s = per.groupBy(*keys).agg(F.sum("ae").alias("ae"), F.sum(F.abs("e")).alias("de"), F.sum("ap").alias("ap"), F.sum("ag").alias("ag"), F.sum("k").alias("k"), F.count("*").alias("n"))
    return s.select(*keys, ratio6("ae", "k * 1000000000").alias("mae"), ratio6("de", f"n * {rate} * 1000000000").alias("disp_err"), ratio6("ap", "ag").alias("move_ratio"), "n")


def best_checkpoint(curve: DataFrame, key: str, margin: float) -> DataFrame:
    """Per run: the step with the least error (first on ties), the final step, and whether it has overfit."""
    w = Window.partitionBy(key).orderBy("disp_err", "step")
    final = F.max_by("disp_err", "step").over(Window.partitionBy(key))
    return curve.withColumn("final_err", final).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, F.col("step").alias("best_step"), F.col("disp_err").alias("best_err"), "final_err", (F.col("final_err") - F.col("disp_err") > margin).alias("overfit"))
