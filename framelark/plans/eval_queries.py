"""Evaluation of prediction runs. Runs are made from the truth itself, so that no model is needed:
`hold` repeats the command at the start, `mean3` averages and holds three frames, `zero` predicts nothing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators.evaluate import best_checkpoint, eval_points, grid, score
from framelark.operators.stats import nano, nano_sql, r6, ratio6, ratio6_sql
from framelark.sources.frames import FRAMES_SQL, event_frames, read_table

NEED, STRIDE, RATE, K = 12, 5, 10, 3
DT = 0.1
#: Steps that a run of kind hold predicts.
HOLD = 6
HELD = "ep % 10 = 5"


def _base(spark, d):
    f = event_frames(spark, d).select("ep", "frame", "slew", "move")
    held = f.where(HELD)
    points = eval_points(held.groupBy("ep").agg(F.count("*").alias("n")), NEED, STRIDE)
    return f, points, grid(points, held, NEED)


def _runs(truth):
    """(run, ord, ep, start, t, joint, gt, pred): all runs from windows over each point's own steps."""
    own = Window.partitionBy("ep", "start", "joint")
    tile = Window.partitionBy("ep", "start", "joint", F.expr(f"t div {K}"))
    p = truth.select("*", F.when(F.col("t") < HOLD, F.first("gt").over(own.orderBy("t"))).alias("hold"), F.avg("gt").over(tile).alias("mean3"))
    return p.selectExpr("ep", "start", "t", "joint", "gt", "stack(3, 0, 'hold', hold, 1, 'mean3', mean3, 2, 'zero', 0.0D) as (ord, run, pred)")


def q_points(spark, d):
    return _base(spark, d)[1]


def q_score(spark, d):
    runs = _runs(_base(spark, d)[2])
    # A run whose own steps do not reach the horizon is left out.
    covered = runs.groupBy("run").agg((F.max(F.when(F.col("pred").isNotNull(), F.col("t"))) + 1).alias("covered"))
    both = runs.withColumn("horizon", F.explode(F.array(F.lit(6), F.lit(12)))).where("t < horizon")
    s = score(both, ["horizon", "ord", "run"], RATE).join(F.broadcast(covered), "run").where("covered + 1e-6 >= horizon")  # a row per run
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("horizon").orderBy("disp_err", "ord")).cast("long")).select(F.col("horizon").cast("long").alias("horizon"), "run", "rank", "mae", "disp_err", "move_ratio", "n")


def q_joint(spark, d):
    runs = _runs(_base(spark, d)[2])
    e = nano(F.col("pred") - F.col("gt"))
    per = runs.groupBy("run", "ep", "start", "joint").agg(F.sum(e).alias("e"))
    out = per.groupingSets([["run"], ["run", "joint"]], "run", "joint").agg(F.sum(F.abs("e")).alias("de"), F.count("*").alias("n"))
    return out.select("run", F.coalesce("joint", F.lit("all")).alias("joint"), ratio6("de", f"n * {RATE} * 1000000000").alias("disp_err"))


def q_joint_mae(spark, d):
    """Mean absolute error of each run's joints over the steps that it predicts."""
    e = F.abs(nano(F.col("pred") - F.col("gt")))
    g = _runs(_base(spark, d)[2]).groupBy("run", "joint").agg(F.sum(e).alias("ae"), F.count("pred").alias("n"))
    return g.select("run", "joint", ratio6("ae", "n * 1000000000").alias("mae"), "n")


def q_training_rows(spark, d):
    """Frames outside of the held-out intervals, which are every episode's middle third [n div 3, 2 * n div 3)."""
    f = event_frames(spark, d).select("ep", "frame", "state")
    held = f.groupBy("ep").agg(F.count("*").alias("n")).selectExpr("ep as held_ep", "n div 3 as lo", "2 * n div 3 as hi")
    return f.join(held, (F.col("ep") == F.col("held_ep")) & (F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi")), "left_anti")


def q_train_episodes(spark, d):
    """All episodes less the held-out ones."""
    ep = event_frames(spark, d).select("ep").distinct()
    return ep.exceptAll(ep.where(HELD))


def q_baselines(spark, d):
    f, points, truth = _base(spark, d)
    train = f.where(f"not ({HELD})").selectExpr("stack(2, 'slew', slew, 'move', move) as (joint, v)").groupBy("joint").agg(F.avg("v").alias("mean_action"))
    both = truth.join(train, "joint").selectExpr("ep", "start", "t", "joint", "gt", "stack(2, 'mean', mean_action, 'zero', 0.0D) as (run, pred)")
    return score(both, ["run"], RATE)


def q_curve(spark, d):
    truth = _base(spark, d)[2]
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in (1000, 2000, 3000, 4000)]))
    gain = F.expr("case step when 1000 then 0.5 when 2000 then 0.9 when 3000 then 1.0 else 1.25 end")  # the last one overshoots
    c = score(truth.withColumn("step", steps).withColumn("pred", F.col("gt") * gain).withColumn("run", F.lit("scaled")), ["run", "step"], RATE)
    return best_checkpoint(c, "run", 0.005)


def q_replan(spark, d):
    """Open-loop replay: a chunk of 4 steps held 2 frames each; each tile replays the command at its start."""
    f = event_frames(spark, d).select("ep", "frame", "move").withColumn("tile", F.expr("frame div 8"))
    w = Window.partitionBy("ep", "tile").orderBy("frame")
    p = f.withColumn("pred", F.first("move").over(w))
    run = Window.partitionBy("ep").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("ep", "frame", "tile", r6(F.sum("pred").over(run) * DT).alias("pred_travel"), r6(F.sum("move").over(run) * DT).alias("travel")).where("frame % 2 = 0")


def q_rates(spark, d):
    """Rate of each run: its own config, else its dataset's, else the default; LABEL=VALUE overrides, later ones win."""
    ep = event_frames(spark, d).select("ep").distinct()
    runs = ep.select(F.col("ep").alias("run"), F.concat(F.lit("ds"), F.col("ep") % 7).alias("dataset"))
    cfg = runs.where("run % 3 = 0").select("run", (F.lit(5) + F.col("run") % 4).cast("long").alias("run_fps"))
    ds = runs.select("dataset").distinct().where("dataset < 'ds4'").withColumn("ds_fps", F.lit(10).cast("long"))
    given = runs.where("run % 5 = 0").select(F.posexplode(F.array(*[F.concat("run", F.lit(f"={v}")) for v in (15, 6, 12)])).alias("place", "arg"))
    parts = given.select("place", F.regexp_extract("arg", "^([^=]*)=(.*)$", 1).cast("long").alias("run"), F.regexp_extract("arg", "^([^=]*)=(.*)$", 2).cast("long").alias("own"))
    own = parts.groupBy("run").agg(F.max_by("own", "place").alias("own"))  # the one given last
    j = runs.join(cfg, "run", "left").join(ds, "dataset", "left").join(own, "run", "left")
    return j.select("run", "dataset", F.coalesce("own", "run_fps", "ds_fps", F.lit(30).cast("long")).alias("fps"))


def q_asof(spark, d):
    """Every control tick (a click) with the newest view at or before it, and its age in milliseconds."""
    e = read_table(spark, d, "events").where("event_type in ('click', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.expr("case event_type when 'view' then 0 else 1 end"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("event_type") == "view", F.col(c)), ignorenulls=True).over(w)
    j = e.select("event_id", "event_type", "ts", last("value").alias("frame_value"), last("ts").alias("frame_ts")).where("event_type = 'click'")
    age = F.expr("timestampdiff(MICROSECOND, frame_ts, ts)") / 1000.0
    return j.select("event_id", "frame_value", F.round(age, 3).alias("age_ms"))


QUERIES = {"eval_points": q_points, "eval_score": q_score, "eval_score_per_joint": q_joint, "joint_mae": q_joint_mae, "training_rows": q_training_rows, "train_episodes": q_train_episodes, "eval_baselines": q_baselines, "eval_curve_best": q_curve, "open_loop_replan": q_replan, "run_rate_resolve": q_rates, "asof_latest_frame": q_asof}

_TRUTH = f"""{FRAMES_SQL}, h AS (SELECT * FROM f WHERE {HELD}), ep AS (SELECT ep, count(*) AS n FROM h GROUP BY ep),
pt AS (SELECT ep, frame AS start FROM h JOIN ep USING (ep) WHERE frame % {STRIDE} = 0 AND frame < n - {NEED}),
gt AS (SELECT pt.ep, start, frame - start AS t, 'slew' AS joint, slew AS gt FROM pt JOIN h ON h.ep = pt.ep AND frame BETWEEN start AND start + {NEED - 1}
  UNION ALL SELECT pt.ep, start, frame - start, 'move', move FROM pt JOIN h ON h.ep = pt.ep AND frame BETWEEN start AND start + {NEED - 1})"""
_RUNS = f"""{_TRUTH}, pr AS (SELECT *, CASE WHEN t < {HOLD} THEN first_value(gt) OVER (PARTITION BY ep, start, joint ORDER BY t) END AS hold, avg(gt) OVER (PARTITION BY ep, start, joint, t // {K}) AS mean3 FROM gt),
ru AS (SELECT 0 AS ord, 'hold' AS run, ep, start, t, joint, gt, hold AS pred FROM pr UNION ALL SELECT 1, 'mean3', ep, start, t, joint, gt, mean3 FROM pr UNION ALL SELECT 2, 'zero', ep, start, t, joint, gt, 0.0 FROM pr)"""


_E, _P, _G = nano_sql("pred - gt"), nano_sql("pred"), nano_sql("gt")


def _score(src: str, keys: str) -> str:
    return f"""per AS (SELECT {keys}, ep, start, joint, sum({_E}) AS e, sum(abs({_E})) AS ae, sum(abs({_P})) AS ap, sum(abs({_G})) AS ag, count(pred) AS k FROM {src} GROUP BY {keys}, ep, start, joint),
tot AS (SELECT {keys}, sum(ae) AS ae, sum(abs(e)) AS de, sum(ap) AS ap, sum(ag) AS ag, sum(k) AS k, count(*) AS n FROM per GROUP BY {keys}),
sc AS (SELECT {keys}, {ratio6_sql("ae", "(k * 1000000000)")} AS mae, {ratio6_sql("de", f"(n * {RATE} * 1000000000)")} AS disp_err, {ratio6_sql("ap", "ag")} AS move_ratio, n FROM tot)"""


ORACLE = {
    "eval_points": f"WITH {_TRUTH} SELECT ep, start FROM pt",
    "eval_score": f"""WITH {_RUNS}, hz AS (SELECT * FROM ru, (SELECT unnest([6, 12]) AS horizon) WHERE t < horizon), {_score("hz", "horizon, ord, run")},
co AS (SELECT run, max(t) + 1 AS covered FROM ru WHERE pred IS NOT NULL GROUP BY run),
ok AS (SELECT sc.* FROM sc JOIN co USING (run) WHERE covered + 1e-6 >= horizon)
SELECT CAST(horizon AS BIGINT) AS horizon, run, row_number() OVER (PARTITION BY horizon ORDER BY disp_err, ord) AS rank, mae, disp_err, move_ratio, n FROM ok""",
    "eval_score_per_joint": f"""WITH {_RUNS}, per AS (SELECT run, ep, start, joint, sum({_E}) AS e FROM ru GROUP BY ALL), g AS (SELECT run, joint, sum(abs(e)) AS de, count(*) AS n FROM per GROUP BY GROUPING SETS ((run), (run, joint)))
SELECT run, coalesce(joint, 'all') AS joint, {ratio6_sql("de", f"(n * {RATE} * 1000000000)")} AS disp_err FROM g""",
    "joint_mae": f"""WITH {_RUNS}, g AS (SELECT run, joint, sum(abs({_E})) AS ae, count(pred) AS n FROM ru GROUP BY run, joint) SELECT run, joint, {ratio6_sql("ae", "(n * 1000000000)")} AS mae, n FROM g""",
    "training_rows": f"WITH {FRAMES_SQL}, n AS (SELECT ep, count(*) AS n FROM f GROUP BY ep) SELECT ep, frame, state FROM f JOIN n USING (ep) WHERE frame < n // 3 OR frame >= 2 * n // 3",
    "train_episodes": f"WITH {FRAMES_SQL} SELECT DISTINCT ep FROM f WHERE NOT ({HELD})",
    "eval_baselines": f"""WITH {_TRUTH}, tr AS (SELECT avg(slew) AS s, avg(move) AS m FROM f WHERE NOT ({HELD})),
b AS (SELECT 'mean' AS run, ep, start, t, joint, gt, CASE joint WHEN 'slew' THEN s ELSE m END AS pred FROM gt, tr UNION ALL SELECT 'zero', ep, start, t, joint, gt, 0.0 FROM gt), {_score("b", "run")} SELECT * FROM sc""",
    "eval_curve_best": f"""WITH {_TRUTH}, c AS (SELECT 'scaled' AS run, step, ep, start, t, joint, gt, gt * CASE step WHEN 1000 THEN 0.5 WHEN 2000 THEN 0.9 WHEN 3000 THEN 1.0 ELSE 1.25 END AS pred FROM gt, (SELECT CAST(unnest([1000, 2000, 3000, 4000]) AS BIGINT) AS step)),
{_score("c", "run, step")} SELECT run, arg_min(step, disp_err) AS best_step, min(disp_err) AS best_err, arg_max(disp_err, step) AS final_err, arg_max(disp_err, step) - min(disp_err) > 0.005 AS overfit FROM sc GROUP BY run""",
    "open_loop_replan": f"""WITH {FRAMES_SQL}, p AS (SELECT ep, frame, move, frame // 8 AS tile, first_value(move) OVER (PARTITION BY ep, frame // 8 ORDER BY frame) AS pred FROM f),
s AS (SELECT ep, frame, tile, round(sum(pred) OVER (PARTITION BY ep ORDER BY frame) * {DT}, 6) AS pred_travel, round(sum(move) OVER (PARTITION BY ep ORDER BY frame) * {DT}, 6) AS travel FROM p) SELECT * FROM s WHERE frame % 2 = 0""",
    "run_rate_resolve": f"""WITH {FRAMES_SQL}, r AS (SELECT DISTINCT ep AS run, 'ds' || (ep % 7) AS dataset FROM f)
SELECT run, dataset, CAST(CASE WHEN run % 5 = 0 THEN 12 WHEN run % 3 = 0 THEN 5 + run % 4 WHEN dataset < 'ds4' THEN 10 ELSE 30 END AS BIGINT) AS fps FROM r""",
    "asof_latest_frame": """SELECT c.event_id, v.value AS frame_value, round(date_diff('microsecond', v.ts, c.ts) / 1000.0, 3) AS age_ms
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
}
