"""Signal-driven trimming of episodes: find the moving part, plan, apply, report.

All per-frame work is one window pass per episode; the plan is one row per episode, and Spark
broadcasts it only under its own size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.operators.ranks import percentiles


def smoothed_speed(frames: DataFrame, fps: float, smooth: int) -> DataFrame:
    """Adds speed: |next state - state| * fps at each frame but the last, averaged over a centred window of
    `smooth` frames that counts missing neighbours as zero."""
    order = Window.partitionBy("ep").orderBy("frame")
    near = order.rowsBetween(-(smooth // 2), (smooth - 1) // 2)
    raw = frames.withColumn("__v", F.abs(F.lead("state").over(order) - F.col("state")) * fps)
    total = F.sum(F.coalesce("__v", F.lit(0.0))).over(near) / smooth
    return raw.withColumn("speed", F.when(F.col("__v").isNotNull(), total)).drop("__v")


def trim_plan(frames: DataFrame, fps: float = 1.0, command_above: float = 0.5, speed_above: float = 80.0, smooth: int = 5, exclude: tuple[int, ...] = ()) -> DataFrame:
    """(ep, n, start, stop, keep, reason): the moving part of each episode, inclusive.

    start is the first moving or slewing frame, else the first commanded one; stop the last commanded
    frame. Episodes without a command are `silent`; motion that starts after the last command gives a
    keep of zero or less, marked `degenerate`.
    """
    s = smoothed_speed(frames, fps, smooth)
    cmd = (F.abs("slew") > command_above) | (F.abs("move") > command_above)
    a = s.groupBy("ep").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("speed") > speed_above, F.col("frame"))).alias("m"), F.min(F.when(F.abs("slew") > command_above, F.col("frame"))).alias("s"),
        F.min(F.when(cmd, F.col("frame"))).alias("c0"), F.max(F.when(cmd, F.col("frame"))).alias("c1"),
    )
    out = F.col("ep").isin(list(exclude)) if exclude else F.lit(False)
    a = a.withColumn("reason", F.when(out, "excluded").when(F.col("c1").isNull(), "silent"))
    a = a.withColumn("start", F.when(F.col("reason").isNull(), F.coalesce(F.least("m", "s"), "c0")).otherwise(F.lit(0)))
    a = a.withColumn("stop", F.when(F.col("reason").isNull(), F.col("c1")).otherwise(F.col("n") - 1))
    a = a.withColumn("keep", F.when(F.col("reason").isNull(), F.col("stop") - F.col("start") + 1).otherwise(F.lit(0)))
    reason = F.coalesce("reason", F.when(F.col("keep") <= 0, "degenerate"), F.lit(""))
    return a.select("ep", "n", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("keep").cast("long").alias("keep"), reason.alias("reason"))


def survivors(plan: DataFrame, min_frames: int) -> DataFrame:
    """Kept episodes, renumbered densely, with the offset of their first row in the new table.

    The two running values are over plan rows, one per episode; ranges of episodes are summed first so
    that no window sees the whole plan.
    """
    alive = plan.where((F.col("keep") > 0) & (F.col("keep") >= min_frames)).withColumn("__b", F.expr("ep div 4096"))
    blocks = alive.groupBy("__b").agg(F.count("*").alias("k"), F.sum("keep").alias("r"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    order = Window.partitionBy("__b").orderBy("ep")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    j = alive.join(blocks, "__b")
    new = (F.col("k0") + F.row_number().over(order) - 1).cast("long")
    offset = (F.col("r0") + F.sum("keep").over(run) - F.col("keep")).cast("long")
    return j.select("ep", new.alias("new_ep"), "n", "start", "stop", "keep", offset.alias("from_index"), (offset + F.col("keep")).alias("to_index"))


def apply_trim(frames: DataFrame, plan: DataFrame, fps: float, min_frames: int) -> DataFrame:
    """Frames of the survivors with rebuilt bookkeeping: new_ep, new_frame, timestamp, index."""
    j = frames.join(survivors(plan, min_frames), "ep").where("frame between start and stop")
    nf = F.col("frame") - F.col("start")
    return j.withColumn("new_frame", nf).withColumn("timestamp", nf / F.lit(fps)).withColumn("index", F.col("from_index") + nf)


def report(plan: DataFrame, fps: float, min_frames: int) -> DataFrame:
    """One row: episodes, frames, what is cut at either end (medians and extremes over kept episodes), and the ids of those left out, which are one text each."""
    kept = F.col("keep") > 0
    head, tail = F.col("start"), F.col("n") - 1 - F.col("stop")
    ends = plan.where(kept).select(F.explode(F.array(F.struct(F.lit("head").alias("side"), head.alias("cut")), F.struct(F.lit("tail").alias("side"), tail.alias("cut")))).alias("x")).select("x.*")
    med = percentiles(ends, ["side"], "cut", {"med": 0.5}).groupBy().agg(*[F.max(F.when(F.col("side") == s, F.col("med"))).alias(f"{s}_median") for s in ("head", "tail")])
    ids = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("ep")))), ",")
    sums = plan.agg(
        F.count("*").alias("episodes"), F.count_if(kept).alias("kept"), F.count_if(F.col("keep") == 0).alias("dropped"),
        F.sum("n").alias("frames_before"), F.sum("keep").alias("frames_after"), F.round(100 * F.sum(F.col("n") - F.col("keep")) / F.sum("n"), 6).alias("cut_pct"),
        F.max(F.when(kept, head)).alias("head_max"), F.max(F.when(kept, tail)).alias("tail_max"),
        F.min(F.when(kept, F.col("keep"))).alias("shortest"), F.count_if(kept & (F.col("keep") < min_frames)).alias("below_min"),
        ids(F.col("reason") == "excluded").alias("excluded_ids"), ids(F.col("reason") == "silent").alias("silent_ids"),
    )
    return sums.crossJoin(med)  # one row each


def left_out(plan: DataFrame) -> DataFrame:
    """(reason, ep): a row for each episode that is excluded or silent."""
    return plan.where(F.col("reason").isin("excluded", "silent")).select("reason", "ep")
