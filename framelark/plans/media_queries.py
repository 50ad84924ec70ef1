"""Queries on packed words, embeddings as 8 x 8 images, masks, random access and a fixed rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import media
from framelark.operators.cache import cache_key, cached
from framelark.operators.stats import r6
from framelark.session import new_folder
from framelark.sources.frames import read_table


def q_quaternions(spark, d):
    """Three bytes as scales and a unit quaternion out of each packed word."""
    li = read_table(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("id"), F.expr("(l_partkey * 2654435761 + l_suppkey * 40503) & 4294967295").alias("word")).distinct()
    v = li.select("id", "word", media.unpack_bytes(F.col("word"), F.lit(-5.0), F.lit(1.0)).alias("s"), media.smallest_three(F.col("word")).alias("q"))
    return v.select("id", "word", *[r6(F.get("s", F.lit(i))).alias(n) for i, n in enumerate(("sx", "sy", "sz"))], *[r6(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))])


def q_time_vectors(spark, d):
    """Both embeddings of each event's time of denoising, a row for each place; the second has an odd width."""
    t = F.col("event_id") % 100 / 100.0
    e = read_table(spark, d, "events").select("event_id", F.arrays_zip(media.sinusoidal(t, 8, 0.04, 4.0).alias("s"), media.timestep(t, 7, 100.0).alias("c")).alias("z"))
    return e.select("event_id", F.posexplode("z").alias("i", "x")).select("event_id", F.col("i").cast("long").alias("i"), r6(F.col("x.s")).alias("sinusoidal"), r6(F.col("x.c")).alias("timestep"))


def _images(spark, d):
    levels = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000 % 256))
    return read_table(spark, d, "embeddings").select("vec_id", levels.alias("image"))


def q_sharpness(spark, d):
    return _images(spark, d).select("vec_id", r6(media.sharpness(F.col("image"), 8, 8)).alias("sharpness"))


def q_score_cache(spark, d):
    """Sharpness of every image through a score cache, three times: new, held, and under another parameter."""
    folder = new_folder(spark, "scores")
    score = lambda new: new.select("_key", media.sharpness(F.col("image"), 8, 8).alias("score"))
    e = _images(spark, d)
    runs = [cached(e, cache_key(1, "vec_id", F.col("vec_id"), step, 2), folder, score, ["score"]).select("vec_id", r6(F.col("score")).alias("score"), "hit", F.lit(n).alias("run")) for n, step in enumerate((5, 5, 10))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def q_resized(spark, d):
    """Images at 5 x 5, normalised as the second channel."""
    small = media.normalised(media.resized(F.col("image"), 8, 8, 5), 1)
    return _images(spark, d).select("vec_id", F.posexplode(small).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x")).alias("x"))


def q_letterbox(spark, d):
    """Images of 4 x 16, normalised, in 10 x 12 of their aspect, padded with zeros above."""
    boxed = media.letterboxed(media.normalised(F.col("image"), 0), 4, 16, 10, 12)
    return _images(spark, d).select("vec_id", F.posexplode(boxed).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("x")).alias("x"))


def q_geometry(spark, d):
    h, w = F.col("p_partkey") % 7 * 100 + 50, F.col("p_size").cast("long") * 40 + 64
    p = read_table(spark, d, "part").select("p_partkey", media.fitted(h, w, 224, 224).alias("f"), media.centre_square(h, w).alias("c"))
    return p.select("p_partkey", "f.rows", "f.cols", "f.top", "f.left", F.col("c.top").alias("crop_top"), F.col("c.left").alias("crop_left"), F.col("c.side").alias("side"))


def q_mask(spark, d):
    """How many turns each user or assistant turn may look at; an assistant's turn starts a block."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") != "system").alias("valid"), (F.col("role") == "assistant").alias("starts"))
    return media.attended(c, "conv_id", "turn", "valid", "starts").select("conv_id", "turn", "attends")


def q_rows_at(spark, d):
    """Events at given positions, some of them asked for twice and some beyond the end."""
    wanted = read_table(spark, d, "supplier").select(F.explode(F.array(F.col("s_suppkey") * 150, F.col("s_suppkey") * 300)).alias("event_id"))
    return media.rows_at(read_table(spark, d, "events").select("event_id", "user_id", "value"), wanted, "event_id").select("event_id", "found", F.coalesce("user_id", F.lit(-1).cast("long")).alias("user_id"), "value")


def q_throttled(spark, d):
    return media.throttled(read_table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", "90 minutes").select("user_id", "event_id")


QUERIES = {
    "quaternion_unpack": q_quaternions, "time_vectors": q_time_vectors, "image_sharpness": q_sharpness, "image_resize": q_resized, "image_geometry": q_geometry,
    "attention_mask": q_mask, "random_access": q_rows_at, "fixed_rate": q_throttled, "score_cache": q_score_cache, "image_letterbox": q_letterbox,
}

_IMAGE = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((abs(CAST(x AS DOUBLE)) * 1000) % 256) AS BIGINT)) AS u FROM embeddings)"
_N = "CAST({} AS DOUBLE)"
_SHARPNESS = f"""WITH {_IMAGE}, p AS (SELECT vec_id, unnest(generate_series(0, 63)) AS i, u FROM u), x AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, u FROM p),
l AS (SELECT vec_id, u[(CASE r WHEN 0 THEN 1 ELSE r - 1 END) * 8 + c + 1] + u[(CASE r WHEN 7 THEN 6 ELSE r + 1 END) * 8 + c + 1] + u[r * 8 + (CASE c WHEN 0 THEN 1 ELSE c - 1 END) + 1] + u[r * 8 + (CASE c WHEN 7 THEN 6 ELSE c + 1 END) + 1] - 4 * u[r * 8 + c + 1] AS l FROM x)
SELECT vec_id, round(CAST(64 * sum(l * l) - sum(l) * sum(l) AS DOUBLE) / 4096, 6) AS sharpness FROM l GROUP BY vec_id"""
ORACLE = {
    "quaternion_unpack": """WITH li AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, (l_partkey * 2654435761 + l_suppkey * 40503) & 4294967295 AS word FROM lineitem),
p AS (SELECT *, word & 3 AS big, ((word >> 2) & 1023) / CAST(1023 AS DOUBLE) * sqrt(2) - sqrt(0.5) AS a, ((word >> 12) & 1023) / CAST(1023 AS DOUBLE) * sqrt(2) - sqrt(0.5) AS b, ((word >> 22) & 1023) / CAST(1023 AS DOUBLE) * sqrt(2) - sqrt(0.5) AS c FROM li),
q AS (SELECT *, sqrt(greatest(0, 1 - a * a - b * b - c * c)) AS d FROM p)
SELECT id, word, round(-5 + (word & 255) / CAST(255 AS DOUBLE) * 6, 6) AS sx, round(-5 + ((word >> 8) & 255) / CAST(255 AS DOUBLE) * 6, 6) AS sy, round(-5 + ((word >> 16) & 255) / CAST(255 AS DOUBLE) * 6, 6) AS sz,
  round(CASE big WHEN 0 THEN d ELSE a END, 6) AS qw, round(CASE big WHEN 0 THEN a WHEN 1 THEN d ELSE b END, 6) AS qx, round(CASE big WHEN 2 THEN d WHEN 3 THEN c ELSE b END, 6) AS qy, round(CASE big WHEN 3 THEN d ELSE c END, 6) AS qz FROM q""",
    "time_vectors": f"""WITH e AS (SELECT event_id, event_id % 100 / CAST(100 AS DOUBLE) AS t, unnest(generate_series(0, 7)) AS i FROM events),
a AS (SELECT *, t * 2 * pi() / (CAST(0.04 AS DOUBLE) * pow(CAST(100 AS DOUBLE), (i % 4) / CAST(3 AS DOUBLE))) AS s, t * exp(-ln(CAST(100 AS DOUBLE)) * (i % 3) / 3) AS c FROM e)
SELECT event_id, i, round(CASE WHEN i < 4 THEN sin(s) ELSE cos(s) END, 6) + {_N.format(0)} AS sinusoidal, CASE WHEN i < 3 THEN round(cos(c), 6) WHEN i < 6 THEN round(sin(c), 6) WHEN i = 6 THEN {_N.format(0)} END AS timestep FROM a""",
    "image_sharpness": _SHARPNESS,
    "image_letterbox": f"""WITH {_IMAGE}, n AS (SELECT vec_id, list_transform(u, lambda x: (x / CAST(255 AS DOUBLE) - CAST({media.IMAGE_MEAN[0]} AS DOUBLE)) / CAST({media.IMAGE_STD[0]} AS DOUBLE)) AS u FROM u),
k AS (SELECT vec_id, u, unnest(generate_series(0, 119)) AS i FROM n), p AS (SELECT *, i // 12 - 7 AS r, i % 12 AS c FROM k),
y AS (SELECT *, least(greatest((r + CAST(0.5 AS DOUBLE)) * 4 / 3 - CAST(0.5 AS DOUBLE), 0), 3) AS y, least(greatest((c + CAST(0.5 AS DOUBLE)) * 16 / 12 - CAST(0.5 AS DOUBLE), 0), 15) AS x FROM p),
z AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(floor(x) AS INT) AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM y)
SELECT vec_id, i, CASE WHEN r < 0 THEN CAST(0 AS DOUBLE) ELSE round((u[y0 * 16 + x0 + 1] * (1 - fx) + u[y0 * 16 + least(x0 + 1, 15) + 1] * fx) * (1 - fy) + (u[least(y0 + 1, 3) * 16 + x0 + 1] * (1 - fx) + u[least(y0 + 1, 3) * 16 + least(x0 + 1, 15) + 1] * fx) * fy, 6) + CAST(0 AS DOUBLE) END AS x FROM z""",
    "score_cache": f"WITH s AS ({_SHARPNESS}) SELECT vec_id, sharpness AS score, run = 1 AS hit, CAST(run AS INTEGER) AS run FROM s, (SELECT unnest(range(3)) AS run)",
    "image_resize": f"""WITH {_IMAGE}, p AS (SELECT vec_id, unnest(generate_series(0, 24)) AS i, u FROM u)
SELECT vec_id, i, round((u[((i // 5) * 8 // 5) * 8 + (i % 5) * 8 // 5 + 1] / CAST(255 AS DOUBLE) - CAST({media.IMAGE_MEAN[1]} AS DOUBLE)) / CAST({media.IMAGE_STD[1]} AS DOUBLE), 6) AS x FROM p""",
    "image_geometry": """WITH p AS (SELECT p_partkey, p_partkey % 7 * 100 + 50 AS h, CAST(p_size AS BIGINT) * 40 + 64 AS w FROM part), r AS (SELECT *, greatest(w / CAST(224 AS DOUBLE), h / CAST(224 AS DOUBLE)) AS k FROM p),
s AS (SELECT *, CAST(floor(h / k) AS BIGINT) AS rows, CAST(floor(w / k) AS BIGINT) AS cols, least(h, w) AS side FROM r) SELECT p_partkey, rows, cols, 224 - rows AS top, 224 - cols AS left, (h - side) // 2 AS crop_top, (w - side) // 2 AS crop_left, side FROM s""",
    "attention_mask": """WITH c AS (SELECT conv_id, turn, role <> 'system' AS valid, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT a.conv_id, a.turn, count(*) FILTER (WHERE a.valid AND b.valid AND b.block <= a.block) AS attends FROM c a JOIN c b ON a.conv_id = b.conv_id GROUP BY a.conv_id, a.turn""",
    "random_access": "SELECT w.event_id, e.event_id IS NOT NULL AS found, coalesce(user_id, -1) AS user_id, value FROM (SELECT s_suppkey * 150 AS event_id FROM supplier UNION ALL SELECT s_suppkey * 300 FROM supplier) w LEFT JOIN events e ON e.event_id = w.event_id",
    "fixed_rate": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, time_bucket(INTERVAL 90 minutes, ts, TIMESTAMP '1970-01-01')",
}
