"""Latency, memory and stream-health summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators.ranks import order_statistics, percentiles
from framelark.operators.stats import beside, nano, nano_sql, nearest_rank, r6, ratio6, ratio6_sql
from framelark.sources.frames import FRAMES_SQL, event_frames, read_table


def _events(spark, d):
    return read_table(spark, d, "events")


def q_linear(spark, d):
    e = _events(spark, d)
    a = e.groupBy("event_type").agg(F.count("*").alias("k"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    a = beside(a, percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), ["event_type"])
    # A stage without samples reports zeros.
    kinds = spark.createDataFrame([(k,) for k in ("click", "view", "error", "purchase", "signup", "never")], "event_type string")
    j = kinds.join(a, "event_type", "left")
    z = lambda c: F.coalesce(r6(F.col(c)), F.lit(0.0))
    return j.select("event_type", F.coalesce("k", F.lit(0)).alias("n"), z("m").alias("avg"), z("p50").alias("p50"), z("p95").alias("p95"), z("s").alias("std"), z("lo").alias("min"), z("hi").alias("max"))


def q_index_rule(spark, d):
    """p50 = a[n // 2], p95 = a[max(0, int(0.95 n) - 1)]."""
    at = {"p50": F.expr("n div 2"), "p95": F.expr("greatest(0, cast(floor(0.95D * n) as bigint) - 1)")}
    return order_statistics(_events(spark, d), ["event_type"], "value", at)


def q_roundtrip(spark, d):
    """Round trip against server time; every fifth server time is missing (NaN) and is skipped by the mean."""
    e = _events(spark, d).select("user_id", F.col("value").alias("rt"), F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value") * 0.8).alias("si"))
    si = F.nanvl("si", F.lit(None).cast("double"))
    a = e.groupBy("user_id").agg(F.count("*").alias("k"), F.avg("rt").alias("rt_avg"), F.avg(si).alias("si_avg"))
    a = beside(a, percentiles(e, ["user_id"], "rt", {"p90": 0.9}), ["user_id"])
    return a.select("user_id", F.col("k").alias("n"), r6(F.col("rt_avg")).alias("rt_mean"), r6(F.col("p90")).alias("rt_p90"), r6(F.col("si_avg")).alias("si_mean"), r6(F.col("rt_avg") - F.col("si_avg")).alias("overhead"))


def q_replan_split(spark, d):
    """Ticks slower than three medians are replans."""
    e = _events(spark, d)
    m = percentiles(e, ["event_type"], "value", {"med": 0.5}).select("event_type", "med")
    j = e.join(m, "event_type").withColumn("slow", F.col("value") > 3 * F.col("med"))
    return j.groupBy("event_type").agg(r6(F.max("med")).alias("median"), F.count_if("slow").alias("replans"), r6(F.avg(F.when(F.col("slow"), F.col("value")))).alias("replan_mean"), r6(F.avg(F.when(~F.col("slow"), F.col("value")))).alias("tick_mean"))


def q_stages(spark, d):
    """Fan out the *_ms entries of a timing map; a running report at every 2000th event."""
    m = F.create_map(F.lit("vision_ms"), F.col("value") * 0.2, F.lit("denoise_ms"), F.col("value") * 0.7, F.lit("count"), F.lit(1.0), F.concat("event_type", F.lit("_ms")), F.col("value"))
    rows = _events(spark, d).select("event_id", F.explode(F.map_filter(m, lambda k, v: k.endswith("_ms"))).alias("stage", "ms"))
    a = beside(rows.groupBy("stage").agg(F.count("*").alias("k"), F.avg("ms").alias("avg")), percentiles(rows, ["stage"], "ms", {"p95": 0.95}), ["stage"])
    return a.select("stage", F.col("k").alias("n"), r6(F.col("avg")).alias("avg"), r6(F.col("p95")).alias("p95"))


def q_warmup(spark, d):
    """Drop each user's first hour and first three ticks."""
    w = Window.partitionBy("user_id")
    e = _events(spark, d).withColumn("rn", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("t0", F.min("ts").over(w))
    kept = e.where("rn > 3 and ts >= t0 + interval 1 hour")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("avg"))


def q_health(spark, d):
    """Delivered rate, instantaneous rate percentiles, largest gap, share within 20 % of nominal, dropped frames, verdict."""
    nominal = 1 / 12000.0  # frames a second
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).select("user_id", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz '2024-01-01 00:00:00', ts)") / 1e6).alias("s"), F.expr("event_id div 150").alias("counter"), "ts", "event_id")
    e = e.withColumn("dt", F.col("s") - F.lag("s").over(w)).withColumn("gap", F.greatest(F.col("counter") - F.lag("counter").over(w) - 1, F.lit(0)))
    a = e.groupBy("user_id").agg(
        F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("span"), F.percentile(1 / F.col("dt"), [0.05, 0.5, 0.95]).alias("p"), F.max("dt").alias("max_gap"),
        F.avg(F.when(F.col("dt").isNotNull(), (F.abs(F.col("dt") * nominal - 1) <= 0.2).cast("double"))).alias("within"), F.sum("gap").alias("dropped"),
    ).where("n >= 3")
    fps = F.try_divide(F.col("n") - 1, "span")
    ok = (fps >= 0.97 * nominal) & (F.col("dropped") == 0) & (F.col("within") >= 0.95)
    return a.select("user_id", "n", r6(F.col("span")).alias("span_s"), F.round(fps, 9).alias("fps"), *[F.round(F.col("p")[i], 9).alias(k) for i, k in enumerate(("p5", "p50", "p95"))], r6(F.col("max_gap")).alias("max_gap_s"), r6(100 * F.col("within")).alias("within_pct"), "dropped", F.when(ok, "STABLE").otherwise("UNSTABLE").alias("verdict"))


def q_windows(spark, d):
    """Tumbling reports that start anew, and running ones that don't; sums are of whole billionths, so that order does not matter."""
    g = _events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(nano(F.col("value"))).alias("v"))
    run = Window.partitionBy("event_type").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(F.col("w.start").alias("start"), "event_type", "n", "v").withColumn("rv", F.sum("v").over(run)).withColumn("rn", F.sum("n").over(run))
    return g.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", ratio6("v", "(n * 1000000000)").alias("avg"), ratio6("rv", "(rn * 1000000000)").alias("running_avg"))


def q_marginal(spark, d):
    """Memory after each load against the one before, and against the configuration called baseline (null beyond its end)."""
    f = event_frames(spark, d).select("ep", "frame", (F.lit(500.0) + F.col("frame") * 40 + F.col("state")).alias("rss"), (F.col("frame") + 1).alias("params"))
    w = Window.partitionBy("ep").orderBy("frame")
    base = f.where("ep = 0").select("frame", F.col("rss").alias("base"))
    j = f.withColumn("delta", F.col("rss") - F.lag("rss", 1, 500.0).over(w)).join(base, "frame", "left")
    return j.select("ep", "frame", r6(F.col("delta")).alias("delta"), F.round(F.col("rss") / F.col("base"), 9).alias("ratio"), r6(F.col("rss") / F.col("params")).alias("per_param"))


def q_two_point(spark, d):
    """Line through the first and last usable row (not least squares), its inverse at a budget, and the low-water mark."""
    f = event_frames(spark, d).where("state > 5")
    a = f.groupBy("ep").agg(F.min_by("frame", "frame").alias("x0"), F.min_by("state", "frame").alias("y0"), F.max_by("frame", "frame").alias("x1"), F.max_by("state", "frame").alias("y1"), F.min("state").alias("low"))
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    a = a.withColumn("slope", slope).withColumn("floor", F.col("y0") - F.col("slope") * F.col("x0"))
    return a.select("ep", r6(F.col("slope")).alias("slope"), r6(F.col("floor")).alias("floor"), r6(F.try_divide(F.lit(100.0) - F.col("floor"), "slope")).alias("at_budget"), r6(F.col("y0") - F.col("low")).alias("consumed"))


QUERIES = {
    "latency_nearest_rank": lambda s, d: nearest_rank(_events(s, d), "event_type", "value"),
    "latency_linear": q_linear, "latency_index_rule": q_index_rule, "roundtrip_overhead": q_roundtrip, "replan_tick_split": q_replan_split, "stage_timings": q_stages,
    "warmup_discard": q_warmup, "stream_health": q_health, "report_windows": q_windows, "marginal_delta": q_marginal, "two_point_fit": q_two_point,
}

ORACLE = {
    "latency_nearest_rank": """WITH a AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type)
SELECT event_type, n AS count, round(m, 2) AS mean, round(v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1], 2) AS p50, round(v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1], 2) AS p90,
  round(v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1], 2) AS p99, round(v[1], 2) AS min, round(v[n], 2) AS max, round(s, 2) AS stdev, round(1000 / m, 2) AS hz FROM a""",
    "latency_linear": """WITH k AS (SELECT unnest(['click', 'view', 'error', 'purchase', 'signup', 'never']) AS event_type)
SELECT k.event_type, count(value) AS n, coalesce(round(avg(value), 6), 0) AS avg, coalesce(round(quantile_cont(value, 0.5), 6), 0) AS p50, coalesce(round(quantile_cont(value, 0.95), 6), 0) AS p95,
  coalesce(round(stddev_pop(value), 6), 0) AS std, coalesce(round(min(value), 6), 0) AS min, coalesce(round(max(value), 6), 0) AS max FROM k LEFT JOIN events USING (event_type) GROUP BY 1""",
    "latency_index_rule": "WITH a AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, v[n // 2 + 1] AS p50, v[greatest(0, CAST(floor(0.95 * n) AS BIGINT) - 1) + 1] AS p95 FROM a",
    "roundtrip_overhead": """WITH e AS (SELECT user_id, value AS rt, CASE WHEN event_id % 5 <> 0 THEN value * CAST(0.8 AS DOUBLE) END AS si FROM events)
SELECT user_id, count(*) AS n, round(avg(rt), 6) AS rt_mean, round(quantile_cont(rt, 0.9), 6) AS rt_p90, round(avg(si), 6) AS si_mean, round(avg(rt) - avg(si), 6) AS overhead FROM e GROUP BY user_id""",
    "replan_tick_split": """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1)
SELECT event_type, round(max(med), 6) AS median, count(*) FILTER (WHERE value > 3 * med) AS replans, round(avg(value) FILTER (WHERE value > 3 * med), 6) AS replan_mean, round(avg(value) FILTER (WHERE value <= 3 * med), 6) AS tick_mean FROM events JOIN m USING (event_type) GROUP BY 1""",
    "stage_timings": """WITH r AS (SELECT 'vision_ms' AS stage, value * CAST(0.2 AS DOUBLE) AS ms FROM events UNION ALL SELECT 'denoise_ms', value * CAST(0.7 AS DOUBLE) FROM events UNION ALL SELECT event_type || '_ms', value FROM events)
SELECT stage, count(*) AS n, round(avg(ms), 6) AS avg, round(quantile_cont(ms, 0.95), 6) AS p95 FROM r GROUP BY stage""",
    "warmup_discard": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg FROM e WHERE rn > 3 AND ts >= t0 + INTERVAL 1 HOUR GROUP BY user_id""",
    "stream_health": """WITH e AS (SELECT user_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / CAST(1e6 AS DOUBLE) AS s, event_id // 150 AS counter, ts, event_id FROM events),
g AS (SELECT *, s - lag(s) OVER w AS dt, greatest(counter - lag(counter) OVER w - 1, 0) AS gap0, lag(counter) OVER w AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, count(*) AS n, max(s) - min(s) AS span, quantile_cont(1 / dt, [0.05, 0.5, 0.95]) AS p, max(dt) AS mg, avg(CASE WHEN dt IS NOT NULL THEN CASE WHEN abs(dt * CAST(1 / 12000.0 AS DOUBLE) - 1) <= 0.2 THEN 1.0 ELSE 0.0 END END) AS wi, CAST(sum(CASE WHEN prev IS NOT NULL THEN gap0 ELSE 0 END) AS BIGINT) AS dropped FROM g GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id, n, round(span, 6) AS span_s, round((n - 1) / nullif(span, 0), 9) AS fps, round(p[1], 9) AS p5, round(p[2], 9) AS p50, round(p[3], 9) AS p95, round(mg, 6) AS max_gap_s, round(100 * wi, 6) AS within_pct, dropped,
  CASE WHEN (n - 1) / nullif(span, 0) >= 0.97 / 12000 AND dropped = 0 AND wi >= 0.95 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM a""",
    "report_windows": f"""WITH g AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, sum({nano_sql("value")}) AS v FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(v) OVER w AS rv, sum(n) OVER w AS rn FROM g WINDOW w AS (PARTITION BY event_type ORDER BY start))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, {ratio6_sql("v", "(n * 1000000000)")} AS avg, {ratio6_sql("rv", "(rn * 1000000000)")} AS running_avg FROM r""",
    "marginal_delta": f"""WITH {FRAMES_SQL}, m AS (SELECT ep, frame, 500.0 + frame * 40 + state AS rss, frame + 1 AS params FROM f), b AS (SELECT frame, rss AS base FROM m WHERE ep = 0)
SELECT ep, frame, round(rss - lag(rss, 1, 500.0) OVER (PARTITION BY ep ORDER BY frame), 6) AS delta, round(rss / base, 9) AS ratio, round(rss / params, 6) AS per_param FROM m LEFT JOIN b USING (frame)""",
    "two_point_fit": f"""WITH {FRAMES_SQL}, a AS (SELECT ep, min(frame) AS x0, arg_min(state, frame) AS y0, max(frame) AS x1, arg_max(state, frame) AS y1, min(state) AS low FROM f WHERE state > 5 GROUP BY ep),
s AS (SELECT *, (y1 - y0) / nullif(x1 - x0, 0) AS slope FROM a) SELECT ep, round(slope, 6) AS slope, round(y0 - slope * x0, 6) AS floor, round((100.0 - (y0 - slope * x0)) / nullif(slope, 0), 6) AS at_budget, round(y0 - low, 6) AS consumed FROM s""",
}
