"""Vector parity, packed point data and numeric function queries (over embeddings and lineitem)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framelark.operators.stats import r6
from framelark.operators.vectors import clamp_sentinels, cosine_policies, dot, fit_width, gate
from framelark.sources.frames import read_table


def _pairs(spark, d):
    """Reference a and candidate b: each vector rounded to two places; some are zeroed to meet the policies."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    zero = lambda c: F.transform(c, lambda x: F.lit(0.0))
    a = F.when(F.col("vec_id") % 10 == 3, zero("v")).otherwise(F.col("v"))
    b = F.when(F.col("vec_id") % 15 == 3, zero("v")).otherwise(F.transform("v", lambda x: F.bround(x * 100) / 100))
    return e.select("vec_id", a.alias("a"), b.alias("b"))


def q_cosine(spark, d):
    return _pairs(spark, d).select("vec_id", *[r6(c).alias(k) for k, c in cosine_policies("a", "b").items()])


def q_timestep(spark, d):
    """16 steps of 4 values: cosine per step, null where a side is zero, then mean, least and greatest."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(15)))
    p = _pairs(spark, d).select("vec_id", "a", "b", steps.alias("t"))
    x, y = F.slice("a", F.col("t") * 4 + 1, 4), F.slice("b", F.col("t") * 4 + 1, 4)
    c = p.select("vec_id", F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))).alias("c"))
    return c.groupBy("vec_id").agg(r6(F.avg("c")).alias("mean"), r6(F.min("c")).alias("min"), r6(F.max("c")).alias("max"))


def _long(p):
    return p.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("vec_id", "i", F.col("z.a").alias("a"), F.col("z.b").alias("b")).withColumn("e", F.abs(F.col("a") - F.col("b")))


def q_diff(spark, d):
    x = _long(_pairs(spark, d))
    g = x.groupBy("vec_id").agg(F.max("e").alias("mx"), F.avg("e").alias("mean_abs"), F.max(F.abs("a")).alias("ref"), F.stddev_pop("e").alias("sd"), F.percentile("e", 0.5).alias("med"), F.avg(F.col("e") / (F.abs("a") + 1e-6)).alias("rel"), F.count_if(F.isnan("b")).alias("n_nan"), F.count_if(F.abs("b") == float("inf")).alias("n_inf"))
    return g.select("vec_id", r6(F.col("mx")).alias("max_abs"), r6(F.col("mean_abs")).alias("mean_abs"), r6(F.col("mx") / (F.col("ref") + 1e-9)).alias("max_rel"), r6(F.col("sd")).alias("std"), r6(F.col("med")).alias("median"), F.round("rel", 3).alias("mean_rel"), "n_nan", "n_inf", (F.col("n_nan") + F.col("n_inf") == 0).alias("finite"))


def q_gate(spark, d):
    p = _pairs(spark, d)
    c = p.select(F.expr("vec_id div 50").alias("sample"), cosine_policies("a", "b")["both_zero"].alias("c"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("m"), F.exists("b", lambda x: F.isnan(x)).alias("bad"))
    w = c.groupBy("sample").agg(F.min(F.when(~F.isnan("c"), F.col("c"))).alias("worst_cos"), F.max("m").alias("worst_abs"), F.bool_or("bad").alias("nonfinite"))
    return gate(w, 0.997, 0.01).select("sample", r6(F.col("worst_cos")).alias("worst_cos"), r6(F.col("worst_abs")).alias("worst_abs"), "reasons", "passed")


def q_pad(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = F.when(F.col("vec_id") % 2 == 0, 20).otherwise(64).cast("int")
    out = e.withColumn("p", fit_width(F.slice("v", 1, n), 32))
    return out.select("vec_id", F.size("p").cast("long").alias("width"), r6(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.col("p")[31]).alias("last"))


def q_clamp(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))
    x = F.when(F.col("i") == 0, F.col("x") * 1e35).when(F.col("i") == 1, float("-inf")).when(F.col("i") == 2, float("nan")).otherwise(F.col("x"))
    y = e.withColumn("y", clamp_sentinels(x))
    return y.groupBy("i").agg(F.count_if(F.col("y") == 10000).alias("high"), F.count_if(F.col("y") == -10000).alias("low"), F.count_if(F.isnan("y")).alias("nans")).select(F.col("i").cast("long").alias("i"), "high", "low", "nans")


def q_packed(spark, d):
    """10-10-10 positions against per-chunk bounds (chunk = 256 rows), 8-bit opacity to logit, two-bit quaternion index."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    v = li.select(F.expr("l_orderkey * 8 + l_linenumber").alias("id"), F.expr("(l_partkey * 2654435761 + l_suppkey * 40503) & 4294967295").alias("w"))
    v = v.withColumn("chunk", F.expr("id div 256"))
    chunks = v.select("chunk").distinct().select("chunk", (F.col("chunk") % 17).cast("double").alias("lo"), (F.col("chunk") % 17 + 3).cast("double").alias("hi"))
    j = v.join(chunks, "chunk")
    cut = lambda s, m: F.shiftrightunsigned(F.col("w"), s).bitwiseAND(F.lit(m))
    deq = lambda s: F.col("lo") + cut(s, 1023) / 1023.0 * (F.col("hi") - F.col("lo"))
    o = F.least(F.greatest(cut(0, 255) / 255.0, F.lit(1e-6)), F.lit(1 - 1e-6))
    q = [(cut(s, 1023) / 1023.0 - 0.5) * math.sqrt(2) for s in (20, 10, 0)]
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - q[0] * q[0] - q[1] * q[1] - q[2] * q[2]))
    j = j.select("chunk", deq(21).alias("x"), deq(11).alias("y"), cut(0, 1023).alias("z"), F.ln(o / (1 - o)).alias("logit"), cut(30, 3).alias("big"), rest.alias("rest"))
    return j.groupBy("chunk").agg(F.count("*").alias("n"), r6(F.min("x")).alias("x_min"), r6(F.max("x")).alias("x_max"), r6(F.avg("y")).alias("y_mean"), F.sum("z").alias("z_sum"), r6(F.avg("logit")).alias("logit_mean"), F.max("big").alias("big_max"), r6(F.avg("rest")).alias("rest_mean"))


def q_sh(spark, d):
    """45 bytes, channel-major, become coefficient-major triples in [-2, 2]; the degree follows from the count."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 45), lambda x: F.floor(F.abs(x.cast("double")) * 1000 % 256)).alias("u"))
    e = e.withColumn("c", F.expr("transform(sequence(0, 44), i -> u[cast(i % 3 as int) * 15 + cast(i div 3 as int)] / 255.0D * 4 - 2)"))
    return e.select("vec_id", r6(F.col("c")[1]).alias("c1"), r6(F.col("c")[3]).alias("c3"), r6(F.expr("aggregate(transform(c, (x, i) -> x * i), 0.0D, (s, x) -> s + x)")).alias("weighted"), F.lit(int(math.sqrt(45 / 3 + 1) - 1)).cast("long").alias("degree"))


def q_functions(spark, d):
    """Activations and time embeddings of every component of every embedding; i is its place."""
    r = read_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    sig = 1 / (1 + F.exp(-F.col("x")))
    clip = F.least(F.greatest(sig, F.lit(0.05)), F.lit(0.95))
    freq = F.exp(-F.lit(math.log(10000.0)) * (F.col("i") % 8) / 8)
    period = 0.004 * F.pow(F.lit(1000.0), (F.col("i") % 8) / 7.0)
    return r.select("vec_id", "i", r6(sig).alias("sigmoid"), r6(F.col("x") * sig).alias("silu"), r6(F.ln(clip / (1 - clip))).alias("logit"), r6(F.cos(F.col("x") * freq)).alias("t_cos"), r6(F.sin(F.col("x") * freq)).alias("t_sin"), r6(F.sin(F.col("x") / period * 0.001)).alias("s_sin"))


def q_integrate(spark, d):
    """Ten Euler steps x += dt * v from t = 1 with v = x * t, for every component; and interpolation x * t + noise * (1 - t), where the noise is the vector backwards and t goes with the row."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 10 / 10.0).alias("t"))
    p = e.select("vec_id", "t", F.posexplode(F.arrays_zip("v", F.reverse("v").alias("noise"))).alias("i", "z")).select("vec_id", "t", F.col("i").cast("long").alias("i"), F.col("z.v").alias("x"), F.col("z.noise").alias("noise"))
    steps = F.expr("aggregate(sequence(0, 9), x, (y, k) -> y + (-0.1D) * y * (1 - k * 0.1D))")
    return p.select("vec_id", "i", r6(steps).alias("euler"), r6(F.col("x") * F.col("t") + F.col("noise") * (1 - F.col("t"))).alias("interp"))


QUERIES = {
    "vector_cosine_policies": q_cosine, "per_timestep_cosine": q_timestep, "diff_stats": q_diff, "parity_gate": q_gate, "pad_truncate_vector": q_pad, "sentinel_clamp": q_clamp,
    "packed_dequantise": q_packed, "sh_reorder": q_sh, "embedding_functions": q_functions, "euler_integrate": q_integrate,
}

_P = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(v, lambda x: CAST(0 AS DOUBLE)) ELSE v END AS a, CASE WHEN vec_id % 15 = 3 THEN list_transform(v, lambda x: CAST(0 AS DOUBLE)) ELSE list_transform(v, lambda x: round_even(x * 100, 0) / 100) END AS b FROM e),
l AS (SELECT vec_id, unnest(generate_series(0, len(a) - 1)) AS i, unnest(a) AS a, unnest(b) AS b FROM p)"""
_COS = "c AS (SELECT vec_id, sum(a * b) AS d, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb, bool_and(a = b) AS same, max(abs(a - b)) AS m FROM l GROUP BY vec_id)"
ORACLE = {
    "vector_cosine_policies": f"""WITH {_P}, {_COS} SELECT vec_id, round(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE d / (na * nb) END, 6) AS both_zero,
  round(CASE WHEN na = 0 OR nb = 0 THEN 'nan'::DOUBLE ELSE d / (na * nb) END, 6) AS nan, round(CASE WHEN na = 0 OR nb = 0 THEN CASE WHEN same THEN 1 ELSE 0 END ELSE d / (na * nb) END, 6) AS equal,
  round(d / nullif(na * nb, 0), 6) AS unguarded, round(d / (na * nb + 1e-8), 6) AS epsilon FROM c""",
    "per_timestep_cosine": f"WITH {_P}, t AS (SELECT vec_id, sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS c FROM l GROUP BY vec_id, i // 4) SELECT vec_id, round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(max(c), 6) AS max FROM t GROUP BY vec_id",
    "diff_stats": f"WITH {_P}, x AS (SELECT *, abs(a - b) AS e FROM l) SELECT vec_id, round(max(e), 6) AS max_abs, round(avg(e), 6) AS mean_abs, round(max(e) / (max(abs(a)) + 1e-9), 6) AS max_rel, round(stddev_pop(e), 6) AS std, round(quantile_cont(e, 0.5), 6) AS median, round(avg(e / (abs(a) + 1e-6)), 3) AS mean_rel, count(*) FILTER (WHERE isnan(b)) AS n_nan, count(*) FILTER (WHERE isinf(b)) AS n_inf, bool_and(isfinite(b)) AS finite FROM x GROUP BY vec_id",
    "parity_gate": f"""WITH {_P}, {_COS}, g AS (SELECT vec_id // 50 AS sample, min(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE d / (na * nb) END) AS wc, max(m) AS wm FROM c GROUP BY 1)
SELECT sample, round(wc, 6) AS worst_cos, round(wm, 6) AS worst_abs, concat_ws('+', CASE WHEN wc < 0.997 THEN 'cosine' END, CASE WHEN wm > 0.01 THEN 'max_abs' END) AS reasons, wc >= 0.997 AND wm <= 0.01 AS passed FROM g""",
    "pad_truncate_vector": f"WITH {_P}, n AS (SELECT vec_id, least(32, CASE WHEN vec_id % 2 = 0 THEN 20 ELSE 64 END) AS k, v FROM e) SELECT vec_id, CAST(32 AS BIGINT) AS width, round(list_sum(v[1:k]), 6) AS total, round(CASE WHEN k = 32 THEN v[32] ELSE 0 END, 6) AS last FROM n",
    "sentinel_clamp": f"""WITH {_P}, x AS (SELECT i, CASE i WHEN 0 THEN v * 1e35 WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE v END AS x FROM (SELECT unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS v FROM e))
SELECT i, count(*) FILTER (WHERE NOT isnan(x) AND x >= 1e30) AS high, count(*) FILTER (WHERE NOT isnan(x) AND x <= -1e30) AS low, count(*) FILTER (WHERE isnan(x)) AS nans FROM x GROUP BY i""",
    "packed_dequantise": """WITH li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
v AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_partkey * 2654435761 + l_suppkey * 40503) & 4294967295 AS w FROM li),
j AS (SELECT id // 256 AS chunk, CAST((id // 256) % 17 AS DOUBLE) AS lo, CAST(3 AS DOUBLE) AS span, w FROM v),
k AS (SELECT chunk, lo + ((w >> 21) & 1023) / CAST(1023 AS DOUBLE) * span AS x, lo + ((w >> 11) & 1023) / CAST(1023 AS DOUBLE) * span AS y, w & 1023 AS z, least(greatest((w & 255) / CAST(255 AS DOUBLE), 1e-6), 1 - CAST(1e-6 AS DOUBLE)) AS o, (w >> 30) & 3 AS big,
  ((w >> 20 & 1023) / CAST(1023 AS DOUBLE) - 0.5) * sqrt(2) AS q0, ((w >> 10 & 1023) / CAST(1023 AS DOUBLE) - 0.5) * sqrt(2) AS q1, ((w & 1023) / CAST(1023 AS DOUBLE) - 0.5) * sqrt(2) AS q2 FROM j)
SELECT chunk, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(avg(y), 6) AS y_mean, CAST(sum(z) AS BIGINT) AS z_sum, round(avg(ln(o / (1 - o))), 6) AS logit_mean, max(big) AS big_max, round(avg(sqrt(greatest(0, 1 - q0*q0 - q1*q1 - q2*q2))), 6) AS rest_mean FROM k GROUP BY chunk""",
    "sh_reorder": f"""WITH {_P}, u AS (SELECT vec_id, list_transform(v[1:45], lambda x: floor((abs(x) * 1000) % 256)) AS u FROM e), c AS (SELECT vec_id, list_transform(generate_series(0, 44), lambda i: u[(i % 3) * 15 + i // 3 + 1] / CAST(255 AS DOUBLE) * 4 - 2) AS c FROM u)
SELECT vec_id, round(c[2], 6) AS c1, round(c[4], 6) AS c3, round(list_sum(list_transform(c, lambda x, i: x * (i - 1))), 6) AS weighted, CAST(3 AS BIGINT) AS degree FROM c""",
    "embedding_functions": f"""WITH {_P}, r AS (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM e), s AS (SELECT *, 1 / (1 + exp(-x)) AS g, least(greatest(1 / (1 + exp(-x)), CAST(0.05 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS k FROM r)
SELECT vec_id, i, round(g, 6) + CAST(0 AS DOUBLE) AS sigmoid, round(x * g, 6) + CAST(0 AS DOUBLE) AS silu, round(ln(k / (1 - k)), 6) + CAST(0 AS DOUBLE) AS logit, round(cos(x * exp(-ln(10000) * (i % 8) / 8)), 6) + CAST(0 AS DOUBLE) AS t_cos, round(sin(x * exp(-ln(10000) * (i % 8) / 8)), 6) + CAST(0 AS DOUBLE) AS t_sin, round(sin(x / (CAST(0.004 AS DOUBLE) * pow(1000, (i % 8) / CAST(7 AS DOUBLE))) * CAST(0.001 AS DOUBLE)), 6) + CAST(0 AS DOUBLE) AS s_sin FROM s""",
    "euler_integrate": f"""WITH {_P}, r AS (SELECT vec_id, vec_id % 10 / CAST(10 AS DOUBLE) AS t, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x, unnest(list_reverse(v)) AS noise FROM e)
SELECT vec_id, i, round(x * list_product(list_transform(generate_series(0, 9), lambda i: 1 - CAST(0.1 AS DOUBLE) * (1 - i * CAST(0.1 AS DOUBLE)))), 6) + CAST(0 AS DOUBLE) AS euler, round(x * t + noise * (1 - t), 6) + CAST(0 AS DOUBLE) AS interp FROM r""",
}
