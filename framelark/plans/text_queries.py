"""Bucketing, packing, catalog, text and log queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelark.operators.packing import greedy_chunks
from framelark.operators.stats import r6
from framelark.sources.frames import FRAMES_SQL, event_frames, read_table


def q_buckets(spark, d, buckets: int = 7, least: float = 20.0):
    """Equal-count time buckets [b*n//B, (b+1)*n//B) per episode; the best frame of each, preferring scores of at least `least`."""
    f = event_frames(spark, d)
    f = f.withColumn("n", F.count("*").over(Window.partitionBy("ep"))).withColumn("bucket", F.expr(f"((frame + 1) * {buckets} - 1) div n"))
    w = Window.partitionBy("ep", "bucket").orderBy(F.desc(F.col("state") >= least), F.desc("state"), "frame")
    return f.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ep", "bucket", "frame", F.col("state").alias("score"), (F.col("state") < least).alias("weak"))


def q_even(spark, d, k: int = 8):
    f = event_frames(spark, d)
    f = f.withColumn("n", F.count("*").over(Window.partitionBy("ep"))).withColumn("step", F.greatest(F.expr(f"n div {k}"), F.lit(1)))
    return f.where(f"frame % step = 0 and frame < least(n, {k} * step)").select("ep", "frame", "step")


def q_greedy(spark, d, budget: int = 120):
    """Contiguous greedy packing of part sizes under a budget, per brand in key order; a larger unit stands alone."""
    p = read_table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("size"))
    packed = greedy_chunks(p, "p_brand", "p_partkey", "size", budget)
    return packed.groupBy("p_brand", "chunk").agg(F.count("*").alias("units"), F.sum("size").alias("total"), F.min("p_partkey").alias("first_key"))


def tensor_columns(p):
    """The parts as tensors: key (starting with its type), dtype and shape."""
    dtype = F.when(F.col("p_brand").endswith("1"), "F16").when(F.col("p_brand").endswith("2"), "U8").otherwise("F32")
    return p.select("p_brand", "p_partkey", F.concat_ws("/", "p_type", "p_partkey").alias("key"), dtype.alias("dtype"), F.array(F.col("p_size").cast("long"), F.lit(4).cast("long"), (F.col("p_partkey") % 3 + 1)).alias("shape"))


def component_sums(tensors):
    """Tensors (key, dtype, shape) by the first prefix that fits the key: counts, sums of products of shapes and bytes, kinds, and a grand total row."""
    kind = F.when(F.col("key").startswith("STANDARD"), "standard").when(F.col("key").startswith("S"), "s-other").when(F.col("key").startswith("ECO"), "economy").otherwise("other")
    width = F.coalesce(F.create_map(F.lit("F16"), F.lit(2), F.lit("F32"), F.lit(4))[F.col("dtype")], F.lit(4))
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    x = tensors.select(kind.alias("component"), "dtype", size.alias("params"), (size * width).alias("bytes"))
    g = x.rollup("component").agg(F.count("*").alias("tensors"), F.sum("params").alias("params"), F.sum("bytes").alias("bytes"), F.array_join(F.sort_array(F.collect_set("dtype")), "+").alias("dtypes"))
    order = F.expr("case component when 'standard' then 0 when 'economy' then 1 when 's-other' then 2 when 'other' then 3 else 4 end").cast("long")
    return g.select(F.coalesce("component", F.lit("total")).alias("component"), order.alias("ord"), "tensors", "params", "bytes", "dtypes")


def q_components(spark, d):
    return component_sums(tensor_columns(read_table(spark, d, "part")))


def q_natural(spark, d):
    """Numeric order of numeric suffixes: rank within each nation."""
    c = read_table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("block_"), F.col("s_suppkey")).alias("name"))
    w = Window.partitionBy("s_nationkey").orderBy(F.regexp_extract("name", r"_(\d+)$", 1).cast("int"))
    return c.select("name", F.row_number().over(w).cast("long").alias("rank"), F.substring_index("name", "_", -1).cast("long").alias("part"))


def q_latest(spark, d):
    """Latest checkpoint per run; the `last` alias matches twice, which does no harm."""
    e = read_table(spark, d, "events").where("event_type in ('click', 'view')").select("user_id", "event_type", "event_id", "ts")
    both = e.unionByName(e.where("event_type = 'click'"))
    g = both.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("m"))
    return g.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


def q_vendor(spark, d):
    """First matching rule names the vendor; it suggests a camera model and mapper."""
    p = read_table(spark, d, "pages").select("page_id", F.lower(F.trim(F.coalesce(F.concat_ws(" ", "url", "html"), F.lit("")))).alias("s"))
    v = F.when(F.col("s").contains("gopro"), "gopro").when(F.col("s").contains("/fr/") | F.col("s").contains("dji"), "dji").when(F.col("s").contains("page=2"), "insta").when(F.col("s") == "", "none").otherwise("unknown")
    p = p.withColumn("vendor", v)
    s = F.when(F.col("vendor").isin("gopro", "insta"), F.struct(F.lit("OPENCV_FISHEYE").alias("model"), F.lit("incremental").alias("mapper"))).otherwise(F.struct(F.lit("OPENCV").alias("model"), F.lit("global").alias("mapper")))
    return p.withColumn("s2", s).select("page_id", "vendor", F.col("s2.model").alias("model"), F.col("s2.mapper").alias("mapper"))


def q_instruction(spark, d, width: int = 48):
    """Line-feed ended instruction, padded or cut to a width, with its mask."""
    t = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("t", F.when(F.col("t").endswith("\n"), F.col("t")).otherwise(F.concat("t", F.lit("\n"))))
    return t.select("doc_id", F.rpad("t", width, " ").alias("padded"), F.least(F.char_length("t"), F.lit(width)).cast("long").alias("mask_len"))


def q_json(spark, d):
    """Descriptor reading: explicit schema, defaults for missing keys, dropped entries, a rational rate."""
    e = read_table(spark, d, "events").select("event_id", F.from_json("props", "k bigint, fps string").alias("p"), F.from_json("props", "map<string,string>").alias("m"))
    rate = F.when(F.col("event_id") % 4 == 0, "30000/1001").when(F.col("event_id") % 4 == 1, "25/0").otherwise("30/1")
    num, den = F.split_part(rate, F.lit("/"), F.lit(1)).cast("double"), F.split_part(rate, F.lit("/"), F.lit(2)).cast("double")
    left = F.map_filter("m", lambda k, v: k != "k")
    return e.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce(F.bround(F.try_divide(num, den), 3), F.lit(30.0)).alias("fps"), F.size(left).cast("long").alias("other_keys"))


def q_log(spark, d):
    """Logs with carriage returns: last step record, first integer, number of `or` samples; last tagged line as JSON."""
    t = read_table(spark, d, "documents").select("doc_id", F.concat(F.lit("step:1K a\rstep:"), F.col("doc_id"), F.lit("K loss\nRESULT {\"x\": 1}\nRESULT {\"x\": "), F.col("doc_id"), F.lit("}\n"), F.coalesce("text", F.lit(""))).alias("t"))
    lines = F.split(F.replace("t", F.lit("\r"), F.lit("\n")), "\n")
    steps = F.filter(lines, lambda s: s.rlike(r"^step:[0-9.]+[KM]? .*"))
    tagged = F.filter(lines, lambda s: s.startswith("RESULT "))
    return t.select("doc_id", F.element_at(steps, -1).alias("last_step"), F.regexp_extract("t", r"\d+", 0).cast("long").alias("first_int"), F.get_json_object(F.substr(F.element_at(tagged, -1), F.lit(8)), "$.x").cast("long").alias("x"), F.size(F.regexp_extract_all("t", F.lit("or "), F.lit(0))).cast("long").alias("hits"))


def q_lockstep(spark, d):
    """Request and reply alternate; gaps in the turn counter and repeated roles are faults."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumn("prev", F.lag("role").over(w)).withColumn("gap", F.col("turn") - F.lag("turn").over(w) - 1)
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("prev") == F.col("role")).alias("repeats"), F.sum(F.coalesce("gap", F.lit(0))).alias("gaps"), F.max(F.char_length("text")).cast("long").alias("longest"))


def q_cache_key(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.substring(F.sha2(F.concat_ws("|", F.lit("v1"), "url", F.char_length("html"), F.lit(1), F.lit(4)), 256), 1, 16).alias("key"))


def q_mock(spark, d):
    """A policy backend as a batch function: per episode a chunk of zeros (50 steps, 2 joints) and its first action."""
    f = event_frames(spark, d).where("frame = 0").select("ep", "state")

    def predict(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            chunk = np.zeros((len(pdf), 50, 2))
            yield pd.DataFrame({"ep": pdf["ep"], "steps": chunk.shape[1], "dims": chunk.shape[2], "first": chunk[:, 0, 0]})

    return f.mapInPandas(predict, T._parse_datatype_string("ep long, steps long, dims long, first double"))


def q_embedding_order(spark, d):
    """Attention positions: running count of unmasked tokens less one, per conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = read_table(spark, d, "conversations")
    return c.select("conv_id", "turn", (F.sum((F.col("role") != "system").cast("long")).over(w) - 1).alias("position"))


QUERIES = {
    "time_bucket_top1": q_buckets, "even_sample": q_even, "greedy_pack": q_greedy, "component_accounting": q_components, "natural_sort_suffix": q_natural, "latest_by_mtime": q_latest,
    "classify_vendor_case": q_vendor, "instruction_normalise": q_instruction, "json_descriptor": q_json, "log_scrape": q_log, "lockstep_check": q_lockstep, "cache_key": q_cache_key,
    "mock_backend_chunk": q_mock, "position_ids": q_embedding_order,
}

ORACLE = {
    "time_bucket_top1": f"""WITH {FRAMES_SQL}, b AS (SELECT *, ((frame + 1) * 7 - 1) // count(*) OVER (PARTITION BY ep) AS bucket FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY ep, bucket ORDER BY (state >= 20) DESC, state DESC, frame) AS rn FROM b)
SELECT ep, bucket, frame, state AS score, state < 20 AS weak FROM r WHERE rn = 1""",
    "even_sample": f"WITH {FRAMES_SQL}, s AS (SELECT ep, frame, count(*) OVER (PARTITION BY ep) AS n FROM f) SELECT ep, frame, greatest(n // 8, 1) AS step FROM s WHERE frame % greatest(n // 8, 1) = 0 AND frame < least(n, 8 * greatest(n // 8, 1))",
    "greedy_pack": """WITH RECURSIVE o AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
w AS (SELECT p_brand, p_partkey, size, i, CAST(0 AS BIGINT) AS chunk, size AS running FROM o WHERE i = 1
  UNION ALL SELECT o.p_brand, o.p_partkey, o.size, o.i, CASE WHEN w.running + o.size > 120 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.running + o.size > 120 THEN o.size ELSE w.running + o.size END FROM w JOIN o ON o.p_brand = w.p_brand AND o.i = w.i + 1)
SELECT p_brand, chunk, count(*) AS units, CAST(sum(size) AS BIGINT) AS total, min(p_partkey) AS first_key FROM w GROUP BY p_brand, chunk""",
    "component_accounting": """WITH x AS (SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'S%' THEN 's-other' WHEN p_type LIKE 'ECO%' THEN 'economy' ELSE 'other' END AS component, CAST(p_size AS BIGINT) * 4 * (p_partkey % 3 + 1) AS params,
  CASE WHEN p_brand LIKE '%1' THEN 'F16' WHEN p_brand LIKE '%2' THEN 'U8' ELSE 'F32' END AS dtype FROM part)
SELECT coalesce(component, 'total') AS component, CAST(CASE component WHEN 'standard' THEN 0 WHEN 'economy' THEN 1 WHEN 's-other' THEN 2 WHEN 'other' THEN 3 ELSE 4 END AS BIGINT) AS ord, count(*) AS tensors, CAST(sum(params) AS BIGINT) AS params,
  CAST(sum(params * CASE dtype WHEN 'F16' THEN 2 ELSE 4 END) AS BIGINT) AS bytes, array_to_string(list_sort(list(DISTINCT dtype)), '+') AS dtypes FROM x GROUP BY ROLLUP (component)""",
    "natural_sort_suffix": "SELECT 'block_' || s_suppkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank, s_suppkey AS part FROM supplier",
    "latest_by_mtime": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'view')) WHERE rn = 1",
    "classify_vendor_case": """WITH p AS (SELECT page_id, lower(trim(concat_ws(' ', url, html))) AS s FROM pages), v AS (SELECT page_id, CASE WHEN contains(s, 'gopro') THEN 'gopro' WHEN contains(s, '/fr/') OR contains(s, 'dji') THEN 'dji' WHEN contains(s, 'page=2') THEN 'insta' WHEN s = '' THEN 'none' ELSE 'unknown' END AS vendor FROM p)
SELECT page_id, vendor, CASE WHEN vendor IN ('gopro', 'insta') THEN 'OPENCV_FISHEYE' ELSE 'OPENCV' END AS model, CASE WHEN vendor IN ('gopro', 'insta') THEN 'incremental' ELSE 'global' END AS mapper FROM v""",
    "instruction_normalise": "WITH t AS (SELECT doc_id, CASE WHEN ends_with(coalesce(text, ''), chr(10)) THEN text ELSE coalesce(text, '') || chr(10) END AS t FROM documents) SELECT doc_id, rpad(t, 48, ' ') AS padded, least(length(t), 48) AS mask_len FROM t",
    "json_descriptor": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, CASE event_id % 4 WHEN 0 THEN 29.97 ELSE 30.0 END::DOUBLE AS fps, CAST(len(json_keys(props)) - 1 AS BIGINT) AS other_keys FROM events",
    "log_scrape": "SELECT doc_id, 'step:' || doc_id || 'K loss' AS last_step, CAST(1 AS BIGINT) AS first_int, doc_id AS x, CAST(len(regexp_extract_all(coalesce(text, ''), 'or ')) AS BIGINT) AS hits FROM documents",
    "lockstep_check": """WITH c AS (SELECT *, lag(role) OVER w AS prev, turn - lag(turn) OVER w - 1 AS gap FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE prev = role) AS repeats, CAST(sum(coalesce(gap, 0)) AS BIGINT) AS gaps, max(length(text)) AS longest FROM c GROUP BY conv_id""",
    "cache_key": "SELECT page_id, left(sha256(concat_ws('|', 'v1', url, length(html), 1, 4)), 16) AS key FROM pages",
    "mock_backend_chunk": f"WITH {FRAMES_SQL} SELECT DISTINCT ep, CAST(50 AS BIGINT) AS steps, CAST(2 AS BIGINT) AS dims, CAST(0 AS DOUBLE) AS first FROM f",
    "position_ids": "SELECT conv_id, turn, CAST(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position FROM conversations",
}
