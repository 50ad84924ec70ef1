"""Trim, statistics, resampling and split queries over event frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators.stats import feature_stats, long_features, r6
from framelark.operators.trim import apply_trim, left_out, report, survivors, trim_plan
from framelark.sources.frames import FRAMES_SQL, event_frames

FPS, MIN_FRAMES, EXCLUDE = 10.0, 20, (3, 7)
COMMAND, SPEED, SMOOTH = 0.5, 800.0, 5


def _plan(spark, d):
    return trim_plan(event_frames(spark, d), FPS, COMMAND, SPEED, SMOOTH, EXCLUDE)


PLAN_SQL = f"""{FRAMES_SQL},
v AS (SELECT *, abs(lead(state) OVER (PARTITION BY ep ORDER BY frame) - state) * {FPS} AS v FROM f),
sp AS (SELECT *, CASE WHEN v IS NOT NULL THEN sum(coalesce(v, 0)) OVER (PARTITION BY ep ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END AS speed FROM v),
ag AS (SELECT ep, count(*) AS n, min(CASE WHEN speed > {SPEED} THEN frame END) AS m, min(CASE WHEN slew > {COMMAND} THEN frame END) AS s,
  min(CASE WHEN slew > {COMMAND} OR move > {COMMAND} THEN frame END) AS c0, max(CASE WHEN slew > {COMMAND} OR move > {COMMAND} THEN frame END) AS c1 FROM sp GROUP BY ep),
pl0 AS (SELECT ep, n, CASE WHEN ep IN {EXCLUDE} THEN 'excluded' WHEN c1 IS NULL THEN 'silent' END AS why, coalesce(least(m, s), c0) AS a, c1 FROM ag),
pl AS (SELECT ep, n, CASE WHEN why IS NULL THEN a ELSE 0 END AS start, CASE WHEN why IS NULL THEN c1 ELSE n - 1 END AS stop,
  CASE WHEN why IS NULL THEN c1 - a + 1 ELSE 0 END AS keep, CASE WHEN why IS NOT NULL THEN why WHEN c1 - a + 1 <= 0 THEN 'degenerate' ELSE '' END AS reason FROM pl0),
sv AS (SELECT ep, row_number() OVER (ORDER BY ep) - 1 AS new_ep, n, start, stop, keep,
  CAST(sum(keep) OVER (ORDER BY ep) - keep AS BIGINT) AS from_index, CAST(sum(keep) OVER (ORDER BY ep) AS BIGINT) AS to_index FROM pl WHERE keep > 0 AND keep >= {MIN_FRAMES})"""


def q_apply(spark, d):
    out = apply_trim(event_frames(spark, d), _plan(spark, d), FPS, MIN_FRAMES)
    return out.select("event_id", "new_ep", "new_frame", r6(F.col("timestamp")).alias("timestamp"), "index", "state")


def q_meta(spark, d):
    s = survivors(_plan(spark, d), MIN_FRAMES)
    video = F.col("ep") * 100.0  # where each episode's video starts
    return s.select("new_ep", "ep", F.col("keep").alias("length"), "from_index", "to_index", r6(video + F.col("start") / FPS).alias("video_from"), r6(video + F.col("n") / FPS - (F.col("n") - 1 - F.col("stop")) / FPS).alias("video_to"))


def q_idmap(spark, d):
    s = survivors(_plan(spark, d), MIN_FRAMES)
    return s.where("ep >= 5 and (ep - 5) % 10 = 0").select(F.col("ep").alias("old_ep"), "new_ep")


FEATURES = ["state", "slew", "move", "frame"]


def q_episode_stats(spark, d):
    return feature_stats(long_features(event_frames(spark, d), FEATURES, ["ep"]), ["ep", "feature"])


def q_global_stats(spark, d):
    fresh = feature_stats(long_features(event_frames(spark, d), FEATURES, []), ["feature"])
    kept = spark.createDataFrame([("image", 0.0, 1.0, 0.5, 0.25, 1000, 0.0, 0.1, 0.5, 0.9, 1.0)], fresh.schema)  # not in the frames: passed through
    return fresh.unionByName(kept.join(fresh, "feature", "left_anti"))


def _stats_sql(keys: str, src: str) -> str:
    q = ", ".join(f"round(quantile_cont(value, {v}), 6) AS {k}" for k, v in {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}.items())
    return f"SELECT {keys}, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count, {q} FROM {src} GROUP BY {keys}"


LONG_SQL = "l AS (" + " UNION ALL ".join(f"SELECT ep, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM f" for c in FEATURES) + ")"


def q_camera_variant(spark, d):
    """Project an episode table to kept cameras: drop the others' columns and map entries, tell what went."""
    e = event_frames(spark, d)
    ep = e.groupBy("ep").agg(F.count("*").alias("length"), *[F.min(F.when(F.col("event_type") == t, F.col("frame"))).alias(f"videos/{t}/from") for t in ("click", "view", "error")])
    keep = {"click"}
    names = F.create_map(*[x for t in ("click", "view", "error") for x in (F.lit(f"observation.images.{t}"), F.lit(t))], F.lit("action"), F.lit("action"))
    gone = [c for c in ep.columns if c.startswith("videos/") and c.split("/")[1] not in keep]
    out = ep.select(*[F.col(f"`{c}`") for c in ep.columns if c not in gone])
    left = F.map_filter(names, lambda k, v: ~k.startswith("observation.images.") | F.substring_index(k, ".", -1).isin(*keep))
    return out.select("ep", "length", F.col("`videos/click/from`").alias("click_from"), F.array_join(F.array_sort(F.map_keys(left)), "+").alias("features"), F.lit(len(gone)).cast("long").alias("dropped"))


def _resample(spark, d, how: str, k: int = 3):
    f = event_frames(spark, d).withColumn("w", F.expr(f"frame div {k}"))
    value = (lambda c: F.avg(c)) if how == "mean" else (lambda c: F.min_by(c, "frame"))
    g = f.groupBy("ep", "w").agg(F.count("*").alias("n"), r6(F.min_by("state", "frame")).alias("state"), r6(value("slew")).alias("slew"), r6(value("move")).alias("move"))
    return g.withColumnRenamed("w", "frame")


def q_zoh(spark, d, k: int = 3):
    """Decimate by k with means, hold each for k frames: the running integral per episode agrees at tile ends."""
    f = event_frames(spark, d)
    low = f.groupBy("ep", F.expr(f"frame div {k}").alias("w")).agg(F.avg("move").alias("held"), F.count("*").alias("n")).where(F.col("n") == k)
    j = f.withColumn("w", F.expr(f"frame div {k}")).join(low, ["ep", "w"])
    w = Window.partitionBy("ep").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    run = j.select("ep", "frame", r6(F.sum("move").over(w) / FPS).alias("integral"), r6(F.sum("held").over(w) / FPS).alias("held_integral"))
    return run


def q_split(spark, d):
    p = event_frames(spark, d).groupBy("ep").agg(F.count("*").alias("frames"))
    held = (F.col("ep") >= 5) & ((F.col("ep") - 5) % 10 == 0)
    return p.select("ep", "frames", F.when(held, "val").otherwise("train").alias("split"), F.col("ep").isin(3, 11, 19, 27).alias("fixed_val"))


def q_deadzone(spark, d):
    """Mean |move| within t seconds of either end against the middle (over 1.5 s from both), by block of episodes."""
    f = event_frames(spark, d)
    n = F.count("*").over(Window.partitionBy("ep"))
    f = f.withColumn("n", n).withColumn("block", F.expr("case when ep < 50 then 'a' when ep < 100 then 'b' else 'c' end"))
    last = F.col("n") - 1 - F.col("frame")
    a = F.abs("move")
    near = lambda t: F.avg(F.when((F.col("frame") < t * FPS) | (last < t * FPS), a))
    return f.groupBy("block").agg(r6(near(0.5)).alias("edge_05"), r6(near(1.0)).alias("edge_10"), r6(near(1.5)).alias("edge_15"), r6(F.avg(F.when((F.col("frame") >= 15) & (last >= 15), a))).alias("middle"))


def q_whatif(spark, d):
    p = event_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n"))
    trims = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("head"), F.lit(t).cast("long").alias("tail")) for h, t in ((30, 15), (45, 30), (5, 5))]))
    x = p.select("n", trims.alias("t")).select("n", "t.head", "t.tail").withColumn("cut", F.least("n", F.col("head") + F.col("tail")))
    return x.groupBy("head", "tail").agg(F.sum("cut").alias("removed"), r6(F.sum("cut") / F.sum("n")).alias("share"), F.count_if(F.col("n") - F.col("cut") < 20).alias("short"))


QUERIES = {
    "trim_plan": _plan,
    "trim_report": lambda s, d: report(_plan(s, d), FPS, MIN_FRAMES), "trim_left_out": lambda s, d: left_out(_plan(s, d)),
    "trim_apply_frames": q_apply,
    "trim_episode_meta": q_meta,
    "trim_idmap_holdout": q_idmap,
    "episode_feature_stats": q_episode_stats,
    "global_feature_stats": q_global_stats,
    "camera_variant": q_camera_variant,
    "resample_mean": lambda s, d: _resample(s, d, "mean"),
    "resample_first": lambda s, d: _resample(s, d, "first"),
    "resample_zoh_integral": q_zoh,
    "split_train_val": q_split,
    "deadzone_profile": q_deadzone,
    "trim_whatif": q_whatif,
}

ORACLE = {
    "trim_plan": f"WITH {PLAN_SQL} SELECT * FROM pl",
    "trim_report": f"""WITH {PLAN_SQL} SELECT count(*) AS episodes, count(*) FILTER (WHERE keep > 0) AS kept, count(*) FILTER (WHERE keep = 0) AS dropped, CAST(sum(n) AS BIGINT) AS frames_before, CAST(sum(keep) AS BIGINT) AS frames_after,
  round(100.0 * sum(n - keep) / sum(n), 6) AS cut_pct, CAST(quantile_cont(start, 0.5) FILTER (WHERE keep > 0) AS DOUBLE) AS head_median, max(start) FILTER (WHERE keep > 0) AS head_max,
  CAST(quantile_cont(n - 1 - stop, 0.5) FILTER (WHERE keep > 0) AS DOUBLE) AS tail_median, max(n - 1 - stop) FILTER (WHERE keep > 0) AS tail_max, min(keep) FILTER (WHERE keep > 0) AS shortest,
  count(*) FILTER (WHERE keep > 0 AND keep < {MIN_FRAMES}) AS below_min, coalesce(string_agg(ep, ',' ORDER BY ep) FILTER (WHERE reason = 'excluded'), '') AS excluded_ids, coalesce(string_agg(ep, ',' ORDER BY ep) FILTER (WHERE reason = 'silent'), '') AS silent_ids FROM pl""",
    "trim_left_out": f"WITH {PLAN_SQL} SELECT reason, ep FROM pl WHERE reason IN ('excluded', 'silent')",
    "trim_apply_frames": f"WITH {PLAN_SQL} SELECT event_id, new_ep, frame - start AS new_frame, round((frame - start) / {FPS}, 6) AS timestamp, from_index + frame - start AS index, state FROM f JOIN sv USING (ep) WHERE frame BETWEEN start AND stop",
    "trim_episode_meta": f"WITH {PLAN_SQL} SELECT new_ep, ep, keep AS length, from_index, to_index, round(ep * 100.0 + start / {FPS}, 6) AS video_from, round(ep * 100.0 + n / {FPS} - (n - 1 - stop) / {FPS}, 6) AS video_to FROM sv",
    "trim_idmap_holdout": f"WITH {PLAN_SQL} SELECT ep AS old_ep, new_ep FROM sv WHERE ep >= 5 AND (ep - 5) % 10 = 0",
    "episode_feature_stats": f"WITH {FRAMES_SQL}, {LONG_SQL} " + _stats_sql("ep, feature", "l"),
    "global_feature_stats": f"WITH {FRAMES_SQL}, {LONG_SQL} " + _stats_sql("feature", "l") + " UNION ALL SELECT 'image', 0.0, 1.0, 0.5, 0.25, 1000, 0.0, 0.1, 0.5, 0.9, 1.0",
    "camera_variant": f"WITH {FRAMES_SQL} SELECT ep, count(*) AS length, min(CASE WHEN event_type = 'click' THEN frame END) AS click_from, 'action+observation.images.click' AS features, CAST(2 AS BIGINT) AS dropped FROM f GROUP BY ep",
    "resample_mean": f"WITH {FRAMES_SQL} SELECT ep, frame // 3 AS frame, count(*) AS n, round(min_by(state, frame), 6) AS state, round(avg(slew), 6) AS slew, round(avg(move), 6) AS move FROM f GROUP BY ep, frame // 3",
    "resample_first": f"WITH {FRAMES_SQL} SELECT ep, frame // 3 AS frame, count(*) AS n, round(min_by(state, frame), 6) AS state, round(min_by(slew, frame), 6) AS slew, round(min_by(move, frame), 6) AS move FROM f GROUP BY ep, frame // 3",
    "resample_zoh_integral": f"""WITH {FRAMES_SQL}, low AS (SELECT ep, frame // 3 AS w, avg(move) AS held FROM f GROUP BY ep, frame // 3 HAVING count(*) = 3)
SELECT f.ep, frame, round(sum(move) OVER (PARTITION BY f.ep ORDER BY frame) / {FPS}, 6) AS integral, round(sum(held) OVER (PARTITION BY f.ep ORDER BY frame) / {FPS}, 6) AS held_integral FROM f JOIN low ON low.ep = f.ep AND low.w = f.frame // 3""",
    "split_train_val": f"WITH {FRAMES_SQL} SELECT ep, count(*) AS frames, CASE WHEN ep >= 5 AND (ep - 5) % 10 = 0 THEN 'val' ELSE 'train' END AS split, ep IN (3, 11, 19, 27) AS fixed_val FROM f GROUP BY ep",
    "deadzone_profile": f"""WITH {FRAMES_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY ep) - 1 - frame AS last, CASE WHEN ep < 50 THEN 'a' WHEN ep < 100 THEN 'b' ELSE 'c' END AS block FROM f)
SELECT block, round(avg(move) FILTER (WHERE frame < 5 OR last < 5), 6) AS edge_05, round(avg(move) FILTER (WHERE frame < 10 OR last < 10), 6) AS edge_10, round(avg(move) FILTER (WHERE frame < 15 OR last < 15), 6) AS edge_15,
  round(avg(move) FILTER (WHERE frame >= 15 AND last >= 15), 6) AS middle FROM g GROUP BY block""",
    "trim_whatif": f"""WITH {FRAMES_SQL}, p AS (SELECT ep, count(*) AS n FROM f GROUP BY ep), t AS (SELECT CAST(unnest([30, 45, 5]) AS BIGINT) AS head, CAST(unnest([15, 30, 5]) AS BIGINT) AS tail)
SELECT head, tail, CAST(sum(least(n, head + tail)) AS BIGINT) AS removed, round(sum(least(n, head + tail)) / sum(n), 6) AS share, count(*) FILTER (WHERE n - least(n, head + tail) < 20) AS short FROM p, t GROUP BY head, tail""",
}
