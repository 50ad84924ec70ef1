"""Policy runs answered by type and reported, rates, datasets read back by their metadata, cameras, instructions and stages of components."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators.captures import capture
from framelark.operators.evaluate import score
from framelark.operators.instructions import tokenised
from framelark.operators.policies import held, joined, playback, predict_chunks, repeats, without_state
from framelark.operators.ranks import percentiles
from framelark.operators.stats import beside, r6, ratio6_sql
from framelark.plans import eval_queries as ev
from framelark.plans.text_queries import q_buckets
from framelark.session import new_folder
from framelark.sinks.datasets import bounds_of, index_points, split_episodes, write_dataset
from framelark.sinks.images import read_frame_files, write_frame_files
from framelark.sources.frames import FRAMES_SQL, event_frames, read_shards, read_table

#: run, policy type, rate of its chunks, steps of a chunk, cameras, whether it was trained without a state.
RUNS = (("still", "hold", 10, 6, ("infrared",), False), ("slow", "ramp", 5, 6, ("infrared", "colour"), False), ("blind", "hold", 10, 12, (), True), ("none", "mock", 2, 3, ("colour",), False))
TASK = "dig"


def q_report(spark, d):
    """Every run's chunks at every held-out start, each by the backend of its type, held onto the recording's grid, scored at each horizon that it covers, and ranked."""
    f, points, truth = ev._base(spark, d)
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("run"), F.lit(p).alias("policy"), F.lit(v).alias("fps"), F.lit(c).alias("chunk"), F.array(*map(F.lit, cams)).cast("array<string>").alias("cams"), F.lit(b).alias("blind")) for i, (r, p, v, c, cams, b) in enumerate(RUNS)]))
    at = points.join(f.withColumnRenamed("frame", "start"), ["ep", "start"]).select("ep", "start", "slew", "move", runs.alias("r")).select("ep", "start", "slew", "move", "r.*")
    state = without_state(F.array("slew", "move"), F.col("blind"))
    asked = at.select("ep", "start", "ord", "run", "policy", "fps", "chunk", joined(F.col("cams")).alias("cams"), state.alias("state"), F.lit(TASK).alias("task"))
    covers = (F.col("chunk") * repeats(ev.RATE, F.col("fps"))).alias("covers")
    keys = ["ord", "run", "policy", "fps", "chunk", "cams", "covers"]
    laid = predict_chunks(asked).withColumn("covers", covers).withColumn("n", F.least("covers", F.lit(ev.NEED)))
    laid = laid.select(*keys, "ep", "start", F.posexplode(held(F.col("actions"), ev.RATE, F.col("fps"), F.col("n"))).alias("t", "a"))
    long = laid.selectExpr(*keys, "ep", "start", "cast(t as long) as t", "stack(2, 'slew', a[0], 'move', a[1]) as (joint, pred)")
    pairs = long.join(truth, ["ep", "start", "t", "joint"]).withColumn("horizon", F.explode(F.array(F.lit(6), F.lit(12)))).where("t < horizon and covers >= horizon")
    s = score(pairs, ["horizon", *keys], ev.RATE)
    rank = F.row_number().over(Window.partitionBy("horizon").orderBy("disp_err", "ord")).cast("long")
    whole = lambda c: F.col(c).cast("long").alias(c)
    return s.select(whole("horizon"), rank.alias("rank"), "run", "policy", "cams", whole("fps"), whole("chunk"), (F.col("covers") / float(ev.RATE)).alias("covers_s"), "mae", "disp_err", "move_ratio", "n")


def q_playback(spark, d):
    """The frames of each episode that a policy of its own rate is shown, from a recording at 30, 40 steps at most."""
    rate = F.element_at(F.array(*map(F.lit, (5, 6, 10, 15, 30))), (F.col("ep") % 5 + 1).cast("int"))
    p = playback(event_frames(spark, d).select("ep", "frame", "state"), 30, rate, 40)
    return p.select("ep", "frame", "step", "stride", "state")


def q_empty(spark, d):
    """Large errors of each user, count, mean and 95th percentile, which are NaN where there are none."""
    e = read_table(spark, d, "events")
    large = e.where("event_type = 'error' and value > 120")
    a = beside(large.groupBy("user_id").agg(F.count("*").alias("k"), F.avg("value").alias("avg")), percentiles(large, ["user_id"], "value", {"p95": 0.95}), ["user_id"])
    j = e.select("user_id").distinct().join(a, "user_id", "left")
    nan = lambda c: F.coalesce(r6(F.col(c)), F.lit(float("nan"))).alias(c)
    return j.select("user_id", F.coalesce("k", F.lit(0)).alias("n"), nan("avg"), nan("p95"))


#: Where keys that are divided into stages begin, and what a stage is called.
STAGES = {"vision.blocks.": "stage ", "vision.convs.": "embed "}


def stage_sums(tensors, stages: dict[str, str]):
    """Tensors (component, key, shape) by component and, within it, by stage: the first part of a key behind a prefix of `stages`.

    Rows of components, of their stages and of all (level 1, 2 and 0) with counts, parameters, and what these take in MB at four and at two bytes each."""
    stage = F.lit(None).cast("string")
    for prefix, name in stages.items():
        stage = F.when(F.col("key").startswith(prefix), F.concat(F.lit(name), F.split_part(F.substr("key", F.lit(len(prefix) + 1)), F.lit("."), F.lit(1)))).otherwise(stage)
    x = tensors.select("component", stage.alias("stage"), F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x).alias("params"))
    g = x.groupingSets([[], ["component"], ["component", "stage"]], "component", "stage").agg(F.grouping_id().alias("gid"), F.count("*").alias("tensors"), F.sum("params").alias("params"))
    g = g.where("gid > 0 or stage is not null")  # tensors outside of any stage are in their component's row
    level = F.when(F.col("gid") == 3, 0).when(F.col("gid") == 1, 1).otherwise(2).cast("long")
    mb = lambda b: r6(F.col("params") * b / 1e6)
    return g.select(level.alias("level"), F.coalesce("component", F.lit("total")).alias("component"), F.coalesce("stage", F.lit("")).alias("stage"), "tensors", "params", mb(4).alias("mb_4"), mb(2).alias("mb_2"))


def q_stages(spark, d):
    """The parts as tensors of a model: those of two types belong to the vision tower's blocks and embeddings."""
    p = read_table(spark, d, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("vision.blocks."), F.col("p_size") % 4)).when(F.col("p_type") == "SMALL", F.concat(F.lit("vision.convs."), F.col("p_size") % 3)).otherwise(F.concat(F.lit("action."), F.lower("p_type")))
    key = F.concat_ws(".", kind, "p_partkey")
    shape = F.array(F.col("p_size").cast("long"), F.lit(4).cast("long"), F.col("p_partkey") % 3 + 1)
    return stage_sums(p.select(F.split_part(key, F.lit("."), F.lit(1)).alias("component"), key.alias("key"), shape.alias("shape")), STAGES)


def q_capture(spark, d):
    """Probe documents made of the parts: who made the camera, and the lens model to begin with."""
    p = read_table(spark, d, "part")
    size = F.col("p_size") % 8
    make = F.when(size == 1, F.lit("Insta360")).when(size == 2, F.col("p_brand")).when(size == 3, F.lit("Apple"))
    firmware = F.when(size == 4, F.concat(F.lit("HD"), F.col("p_partkey"))).otherwise(F.concat(F.lit("v"), F.col("p_size")))
    handler = F.when(size == 5, F.concat(F.lit("\x0b DJI "), F.col("p_name"))).when(size == 6, F.concat(F.lit(" GoPro AVC "), F.col("p_name"))).otherwise(F.col("p_name"))
    streams = F.array(F.struct(F.lit("video").alias("codec_type"), F.struct(handler.alias("handler_name")).alias("tags")), F.struct(F.lit("audio").alias("codec_type"), F.struct(F.lit(None).cast("string").alias("handler_name")).alias("tags")))
    tags = F.struct(make.alias("make"), F.lower("p_type").alias("com.apple.quicktime.model"), firmware.alias("firmware"))
    document = F.to_json(F.struct(F.struct(F.lit("mov").alias("format_name"), tags.alias("tags")).alias("format"), streams.alias("streams")))
    c = p.select("p_partkey", capture(document).alias("c"))
    return c.select("p_partkey", "c.container", "c.make", "c.model", "c.firmware", "c.detected", "c.camera_model", "c.mapper")


def q_points(spark, d):
    """A dataset written, its episodes' bounds and count read from its metadata, and the rows of its data shards at every fifth start of the held-out episodes."""
    folder = new_folder(spark, "dataset")
    write_dataset(event_frames(spark, d).select("ep", "frame", "event_id", "state"), folder, 10.0)
    episodes = split_episodes(bounds_of(spark, folder))
    points = index_points(episodes.where("split = 'val'"), ev.NEED, ev.STRIDE)
    rows = read_shards(spark, f"{folder}/data").join(points, "index", "left_semi")
    return rows.select("index", "episode_index", "frame_index", "event_id", "state")


def q_frame_files(spark, d):
    """The best frame of each time bucket, as files numbered within the episode, after a first selection of every frame of high value has been written to the same place; what is there then."""
    folder = new_folder(spark, "frames")
    f = event_frames(spark, d)
    data = F.concat_ws(":", "ep", "frame").cast("binary").alias("data")
    write_frame_files(f.where("state > 150").select("ep", "frame", data), folder, "ep", "frame", "data")
    write_frame_files(q_buckets(spark, d).select("ep", "frame", data), folder, "ep", "frame", "data")
    r = read_frame_files(spark, folder)
    return r.select(F.col("group").cast("long").alias("ep"), "name", F.sha2("content", 256).alias("sha"))


WIDTH = 48


def q_instructions(spark, d):
    """Every turn as an instruction: its first ids, cut or padded to a width, and how many are not padding."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    t = tokenised(c, "text", public_tokenizers.path("byte_bpe_50k.json"), WIDTH)
    return t.select("conv_id", "turn", "tokens", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_tokens"))


QUERIES = {
    "eval_report": q_report, "playback_stride": q_playback, "latency_empty_nan": q_empty, "component_stages": q_stages, "capture_camera": q_capture, "points_from_metadata": q_points, "instruction_tokens": q_instructions,
    "frame_files": q_frame_files,
}

_VALUES = ", ".join(f"({i}, '{r}', '{p}', {v}, {c}, '{'+'.join(cams) or '-'}', {b})" for i, (r, p, v, c, cams, b) in enumerate(RUNS))
_KEYS = "horizon, ord, run, policy, fps, chunk, cams, covers"

ORACLE = {
    "eval_report": f"""WITH {ev._TRUTH}, z AS (SELECT *, max(CASE WHEN t = 0 THEN gt END) OVER (PARTITION BY ep, start, joint) AS g0 FROM gt), r(ord, run, policy, fps, chunk, cams, blind) AS (VALUES {_VALUES}),
p AS (SELECT ord, run, policy, fps, chunk, cams, chunk * ({ev.RATE} // fps) AS covers, ep, start, t, joint, gt, CASE WHEN blind OR policy = 'mock' THEN 0.0 WHEN policy = 'hold' THEN g0 ELSE g0 * (1 - (t // ({ev.RATE} // fps)) / CAST(chunk AS DOUBLE)) END AS pred FROM z, r WHERE t < chunk * ({ev.RATE} // fps)),
hz AS (SELECT * FROM p, (SELECT unnest([6, 12]) AS horizon) WHERE t < horizon AND covers >= horizon), {ev._score("hz", _KEYS)}
SELECT CAST(horizon AS BIGINT) AS horizon, row_number() OVER (PARTITION BY horizon ORDER BY disp_err, ord) AS rank, run, policy, cams, CAST(fps AS BIGINT) AS fps, CAST(chunk AS BIGINT) AS chunk, covers / CAST({ev.RATE} AS DOUBLE) AS covers_s, mae, disp_err, move_ratio, n FROM sc""",
    "playback_stride": f"""WITH {FRAMES_SQL}, s AS (SELECT *, CAST(30 // CASE ep % 5 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 30 END AS BIGINT) AS stride FROM f)
SELECT ep, frame, frame // stride AS step, stride, state FROM s WHERE frame % stride = 0 AND frame < 40 * stride""",
    "latency_empty_nan": """SELECT user_id, count(v) AS n, coalesce(round(avg(v), 6), 'nan'::DOUBLE) AS avg, coalesce(round(quantile_cont(v, 0.95), 6), 'nan'::DOUBLE) AS p95 FROM (SELECT user_id, CASE WHEN event_type = 'error' AND value > 120 THEN value END AS v FROM events) GROUP BY user_id""",
    "component_stages": """WITH x AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'vision' ELSE 'action' END AS component, CASE p_type WHEN 'ECONOMY' THEN 'stage ' || (p_size % 4) WHEN 'SMALL' THEN 'embed ' || (p_size % 3) END AS stage, CAST(p_size AS BIGINT) * 4 * (p_partkey % 3 + 1) AS params FROM part),
g AS (SELECT 0 AS level, 'total' AS component, '' AS stage, params FROM x UNION ALL SELECT 1, component, '', params FROM x UNION ALL SELECT 2, component, stage, params FROM x WHERE stage IS NOT NULL)
SELECT CAST(level AS BIGINT) AS level, component, stage, count(*) AS tensors, CAST(sum(params) AS BIGINT) AS params, round(sum(params) * 4 / CAST(1e6 AS DOUBLE), 6) AS mb_4, round(sum(params) * 2 / CAST(1e6 AS DOUBLE), 6) AS mb_2 FROM g GROUP BY ALL""",
    "capture_camera": """WITH p AS (SELECT *, p_size % 8 AS s, CASE p_size % 8 WHEN 1 THEN 'Insta360' WHEN 2 THEN p_brand WHEN 3 THEN 'Apple' END AS make FROM part),
m AS (SELECT *, CASE s WHEN 4 THEN 'GoPro' WHEN 6 THEN 'GoPro' WHEN 1 THEN 'Insta360' WHEN 5 THEN 'DJI' WHEN 3 THEN 'Apple/iPhone' ELSE coalesce(make, 'unknown') END AS detected FROM p)
SELECT p_partkey, 'mov' AS container, make, lower(p_type) AS model, CASE s WHEN 4 THEN 'HD' || p_partkey ELSE 'v' || p_size END AS firmware, detected, CASE WHEN s IN (1, 4, 5, 6) THEN 'OPENCV_FISHEYE' ELSE 'OPENCV' END AS camera_model, CASE WHEN s IN (1, 4, 5, 6) THEN 'global' ELSE 'incremental' END AS mapper FROM m""",
    "points_from_metadata": f"""WITH {FRAMES_SQL}, o AS (SELECT ep, frame, event_id, state, row_number() OVER (ORDER BY ep, frame) - 1 AS index, dense_rank() OVER (ORDER BY ep) - 1 AS episode_index, count(*) OVER (PARTITION BY ep) AS n FROM f)
SELECT index, episode_index, frame AS frame_index, event_id, state FROM o WHERE episode_index % 10 = 5 AND frame % {ev.STRIDE} = 0 AND frame < n - {ev.NEED}""",
    "frame_files": f"""WITH {FRAMES_SQL}, b AS (SELECT *, ((frame + 1) * 7 - 1) // count(*) OVER (PARTITION BY ep) AS bucket FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY ep, bucket ORDER BY (state >= 20) DESC, state DESC, frame) AS rn FROM b),
n AS (SELECT ep, frame, row_number() OVER (PARTITION BY ep ORDER BY frame) AS n FROM r WHERE rn = 1)
SELECT ep, 'frame_' || lpad(CAST(n AS VARCHAR), 4, '0') || '.jpg' AS name, sha256(ep || ':' || frame) AS sha FROM n""",
}
