"""Queries over binary files that Spark writes from the tables and reads back by ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators.keypoints import with_key_points
from framelark.operators.media import sharpness
from framelark.operators.points import CHUNK, decode_points, dense_ids
from framelark.operators.stats import r6
from framelark.plans import text_queries
from framelark.session import new_folder
from framelark.sinks import incremental
from framelark.sinks.parts import write_arrays, write_bytes, write_points
from framelark.sources import wire
from framelark.sources.files import read_arrays
from framelark.sources.frames import FRAMES_SQL, event_frames, read_table
from framelark.sources.ranged import read_grey_frames, read_points, read_tensor_headers

#: Vertices of a file.
PART = CHUNK * 64
_BOUNDS = ("x", "y", "z", "scale_x", "scale_y", "scale_z", "r", "g", "b")


def q_points(spark, d):
    """Packed points of lineitem in files of chunks, vertices and coefficients; read by ranges, decoded, and summed up by chunk."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    v = dense_ids(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    word = lambda n: F.expr(f"(l_partkey * {2654435761 + 2 * n} + l_suppkey * 40503 + id) & 4294967295")
    words = [word(i).alias(f"packed_{n}") for i, n in enumerate(("position", "rotation", "scale", "color"))]
    chunk = F.expr(f"id div {CHUNK}")
    bounds = [b for i, n in enumerate(_BOUNDS) for b in ((chunk % (17 - i)).cast("float").alias(f"min_{n}"), (chunk % (17 - i) + 3).cast("float").alias(f"max_{n}"))]
    rest = [F.expr(f"cast((l_partkey + {i} * l_suppkey) % 256 as smallint)").alias(f"f_rest_{i}") for i in range(9)]
    folder = new_folder(spark, "points")
    write_points(v.select("id", *bounds, *words, *rest), folder, PART)
    p = decode_points(read_points(spark, folder, "vertex", "sh", rows=PART // 4), read_points(spark, folder, "chunk"))
    at = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long") * PART + F.col("id")
    p = p.withColumn("chunk", F.floor(at / CHUNK).cast("long"))
    least = lambda c, name: r6(F.min(c)).alias(name)
    return p.groupBy("chunk").agg(
        F.count("*").alias("n"), least(F.col("x"), "x"), r6(F.max("y")).alias("y"), least(F.col("z"), "z"), r6(F.max(F.get("scale", F.lit(1)))).alias("scale_y"), least(F.get("albedo", F.lit(2)), "b"),
        r6(F.max("density")).alias("density"), least(F.get("rotation", F.lit(0)), "w"), r6(F.max(F.get("rotation", F.lit(3)))).alias("q_z"), least(F.get("specular", F.lit(1)), "specular_1"), F.max("degree").alias("degree"),
    )


def q_tensors(spark, d):
    """Tensor files of the parts of each brand, of a thousand keys at most; the catalog of their headers, by component."""
    t = text_queries.tensor_columns(read_table(spark, d, "part"))
    t = t.withColumn("part", F.expr("cast(regexp_extract(p_brand, '([0-9]+)', 1) as long) * 100000 + p_partkey div 1000"))
    width = F.when(F.col("dtype") == "F16", 2).when(F.col("dtype") == "U8", 1).otherwise(4)
    t = t.withColumn("bytes", (F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x) * width).cast("long"))
    stop = F.sum("bytes").over(Window.partitionBy("part").orderBy("p_partkey"))  # a thousand rows at most
    t = t.withColumn("data_offsets", F.array(stop - F.col("bytes"), stop))
    entry = F.struct("key", F.struct("dtype", "shape", "data_offsets").alias("spec"))
    head = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry))))
    files = t.groupBy("part").agg(head.alias("head"))
    length = F.unhex(F.lpad(F.hex(F.octet_length("head")), 16, "0"))
    little = F.concat(*[F.substring(length, 8 - i, 1) for i in range(8)])
    body = t.select("part", (F.col("p_partkey") + 1).alias("at"), F.unhex(F.repeat(F.lit("00"), F.col("bytes").cast("int"))).alias("data"))
    folder = new_folder(spark, "tensors")
    write_bytes(files.select("part", F.lit(0).cast("long").alias("at"), F.concat(little, F.col("head").cast("binary")).alias("data")).unionByName(body), folder)
    return text_queries.component_sums(read_tensor_headers(spark, folder))


def q_grey(spark, d):
    """Embeddings as raw grey frames of 8 x 8, a file for each label; every second frame at half size, with its sum and the variance of its Laplacian."""
    level = "cast(floor(abs(cast(x as double)) * 1000 % 256) as int)"
    e = read_table(spark, d, "embeddings").select(F.col("label").cast("long").alias("part"), F.col("vec_id").alias("at"), F.expr(f"unhex(array_join(transform(embedding, x -> lpad(hex({level}), 2, '0')), ''))").alias("data"))
    folder = new_folder(spark, "grey")
    write_bytes(e, folder)
    f = read_grey_frames(spark, folder, 8, 8, step=2, scale=2, frames=16)
    pixels = F.expr("transform(sequence(1, 16), i -> cast(conv(hex(substring(pixels, i, 1)), 16, 10) as int))")
    f = f.select(F.regexp_extract("file", r"part-(\d+)-", 1).cast("long").alias("label"), "frame", pixels.alias("p"))
    return f.select("label", "frame", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), r6(sharpness(F.col("p"), 4, 4)).alias("sharpness"))


def q_archives(spark, d):
    """Each episode's frames as an npz archive of its states (two dimensions) and frame numbers, read back and summed."""
    f = event_frames(spark, d)
    n = F.count("*").over(Window.partitionBy("ep"))
    f = f.select("ep", "frame", "state", "slew", n.alias("n"))
    piece = lambda name, dtype, shape, values: f.select(F.col("ep").alias("archive"), F.lit(name).alias("name"), F.col("frame").alias("piece"), F.lit(dtype).alias("dtype"), shape.alias("shape"), values.alias("values"))
    long = lambda c: c.cast("long")
    states = piece("states", "<f8", F.array(long(F.col("n")), F.lit(2).cast("long")), F.array("state", "slew"))
    frames = piece("frames", "<i4", F.array(long(F.col("n"))), F.array(F.col("frame").cast("double")))
    folder = new_folder(spark, "archives")
    write_arrays(states.unionByName(frames), folder)
    a = read_arrays(spark, folder, "*.npz")
    whole = F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 1e6).cast("long"))
    return a.select(F.regexp_extract("file", r"part-(\d+)-", 1).cast("long").alias("ep"), "name", "dtype", F.array_join("shape", "x").alias("shape"), whole.alias("micros"))


def q_messages(spark, d):
    """Every turn of a conversation as a message (its text as an array of bytes, its number as an array of one, the role as text), packed and unpacked."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    entry = lambda key, dtype, shape, data: F.struct(F.lit(key).alias("key"), F.lit(dtype).alias("dtype"), shape.alias("shape"), data.alias("data"))
    body = F.col("text").cast("binary")
    arrays = F.array(entry("turn", ">i8", F.array(F.lit(1).cast("long")), F.unhex(F.lpad(F.hex(F.col("turn").cast("long")), 16, "0"))), entry("text", "|u1", F.array(F.octet_length("text").cast("long")), body))
    sent = wire.encoded(c.select("conv_id", "turn", arrays.alias("arrays"), F.create_map(F.lit("role"), F.coalesce("role", F.lit(""))).alias("words")), "arrays", "words").select("conv_id", "message")
    got = wire.decoded(sent, "message")
    one = lambda key: F.get(F.filter("entries", lambda e: e["key"] == key), F.lit(0))
    turn = F.conv(F.hex(one("turn")["data"]), 16, 10).cast("long")
    return got.select("conv_id", turn.alias("turn"), F.col("texts")["role"].alias("role"), one("text")["dtype"].alias("dtype"), F.get(one("text")["shape"], F.lit(0)).alias("n_bytes"), F.sha2(one("text")["data"], 256).alias("text_sha256"), F.size("entries").cast("long").alias("arrays"))


LEAST = 60


def q_incremental(spark, d):
    """Episodes added in two batches, the second one twice, those of LEAST frames and more saved with it; the frames of the dataset that results."""
    f = event_frames(spark, d).select("ep", "frame", "state")
    n = F.count("*").over(Window.partitionBy("ep"))
    f = f.withColumn("second", F.col("frame") * 2 >= n).withColumn("long", n >= LEAST)
    folder = new_folder(spark, "grown")
    incremental.create(spark, folder, 10.0)
    incremental.add_frames(f.where("not second").drop("second", "long"), folder, 0)
    for _ in range(2):
        incremental.add_frames(f.where("second").drop("second", "long"), folder, 1)
        incremental.save_episodes(f.where("long"), folder, 1)
    incremental.finalize(spark, folder, f"{folder}/done")
    done = spark.read.parquet(f"{folder}/done/data")
    return done.select("episode_index", "frame_index", "timestamp", F.col("index").alias("row"), "state")


def q_key_points(spark, d, buckets: int = 5, least: float = 8000.0):
    """Of equal-count buckets of each label's images the best one: sharp ones first, then by key points, then by sharpness."""
    level = "cast(floor(abs(cast(x as double)) * 1000 % 256) as int)"
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.expr(f"transform(embedding, x -> {level})").alias("p"))
    e = e.withColumn("sharpness", sharpness(F.col("p"), 8, 8)).withColumn("pixels", F.expr("unhex(array_join(transform(p, x -> lpad(hex(x), 2, '0')), ''))")).drop("p")
    e = with_key_points(e.withColumns({"h": F.lit(8), "w": F.lit(8)}), "pixels", "h", "w")
    w = Window.partitionBy("label")
    e = e.withColumn("bucket", F.expr(f"(row_number() OVER (PARTITION BY label ORDER BY vec_id) * {buckets} - 1)").cast("long")).withColumn("bucket", F.floor(F.col("bucket") / F.count("*").over(w)))
    best = F.row_number().over(Window.partitionBy("label", "bucket").orderBy(F.desc(F.col("sharpness") >= least), F.desc("key_points"), F.desc("sharpness"), "vec_id"))
    return e.withColumn("place", best).where("place = 1").select("label", "bucket", "vec_id", "key_points", r6(F.col("sharpness")).alias("sharpness"), (F.col("sharpness") < least).alias("weak"))


QUERIES = {"wire_messages": q_messages, "incremental_dataset": q_incremental, "sharpest_by_key_points": q_key_points, "point_file_decode": q_points, "tensor_file_accounting": q_tensors, "grey_frame_scores": q_grey, "episode_archives": q_archives}

_SHARE = lambda word, shift, mask: f"(({word} >> {shift}) & {mask}) / CAST({mask} AS DOUBLE)"
_F = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
_BOUND = lambda n, share: _F(f"(chunk % {17 - _BOUNDS.index(n)}) + {share} * 3")
_MIRROR = lambda i: 1 if i < 0 else 2 if i > 3 else i
_AROUND = " + ".join(f"(-4 * b[{r * 4 + c + 1}] + " + " + ".join(f"b[{_MIRROR(r + dr) * 4 + _MIRROR(c + dc) + 1}]" for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))) + ")" for r in range(4) for c in range(4))
_AROUND_LIST = "[" + ", ".join(x for x in _AROUND.replace(") + (-4", ")|(-4").split("|")) + "]"
_BLOCKS = "[" + ", ".join("(2 * (" + " + ".join(f"p[{(2 * r + i) * 8 + 2 * c + j + 1}]" for i in (0, 1) for j in (0, 1)) + ") + 4) // 8" for r in range(4) for c in range(4)) + "]"

ORACLE = {
    "wire_messages": """SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, '|u1' AS dtype, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, CAST(2 AS BIGINT) AS arrays FROM conversations""",
    "incremental_dataset": f"""WITH {FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM f), s AS (SELECT *, dense_rank() OVER (ORDER BY ep) - 1 AS episode_index FROM n WHERE n >= {LEAST})
SELECT episode_index, frame AS frame_index, frame / CAST(10 AS DOUBLE) AS timestamp, row_number() OVER (ORDER BY ep, frame) - 1 AS row, state FROM s""",
    "point_file_decode": f"""WITH v AS (SELECT l_partkey AS p, l_suppkey AS s, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS id FROM lineitem),
w AS (SELECT id, id // {CHUNK} AS chunk, p, s, {", ".join(f"(p * {2654435761 + 2 * i} + s * 40503 + id) & 4294967295 AS w{i}" for i in range(4))} FROM v),
q AS (SELECT *, w1 & 3 AS big, {", ".join(f"{_SHARE('w1', 2 + 10 * i, 1023)} * sqrt(2) - sqrt(0.5) AS q{i}" for i in range(3))}, least(greatest({_SHARE("w3", 24, 255)}, 1e-6), 1 - CAST(1e-6 AS DOUBLE)) AS o FROM w),
r AS (SELECT *, sqrt(greatest(0, 1 - q0 * q0 - q1 * q1 - q2 * q2)) AS rest FROM q)
SELECT chunk, count(*) AS n, round(min({_BOUND("x", _SHARE("w0", 0, 1023))}), 6) AS x, round(max({_BOUND("y", _SHARE("w0", 10, 1023))}), 6) AS y, round(min({_BOUND("z", _SHARE("w0", 20, 1023))}), 6) AS z,
  round(max({_BOUND("scale_y", _SHARE("w2", 8, 255))}), 6) AS scale_y, round(min({_BOUND("b", _SHARE("w3", 16, 255))}), 6) AS b, round(max({_F("ln(o / (1 - o))")}), 6) AS density,
  round(min({_F("CASE WHEN big = 0 THEN rest ELSE q0 END")}), 6) AS w, round(max({_F("CASE WHEN big = 3 THEN rest ELSE q2 END")}), 6) AS q_z,
  round(min({_F("((p + 3 * s) % 256) / CAST(255 AS DOUBLE) * 4 - 2")}), 6) AS specular_1, CAST(1 AS BIGINT) AS degree FROM r GROUP BY chunk""",
    "tensor_file_accounting": text_queries.ORACLE["component_accounting"],
    "grey_frame_scores": f"""WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: CAST(floor((abs(CAST(x AS DOUBLE)) * 1000) % 256) AS BIGINT)) AS p FROM embeddings),
b AS (SELECT label, frame, {_BLOCKS} AS b FROM e WHERE frame % 2 = 0), l AS (SELECT *, {_AROUND_LIST} AS l FROM b)
SELECT CAST(label AS BIGINT) AS label, frame, CAST(list_sum(b) AS BIGINT) AS total, round((16 * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l)) / CAST(256 AS DOUBLE), 6) AS sharpness FROM l""",
    "episode_archives": f"""WITH {FRAMES_SQL} SELECT ep, 'states' AS name, '<f8' AS dtype, count(*) || 'x2' AS shape, CAST(sum(CAST(round(state * 1e6) AS BIGINT) + CAST(round(slew * 1e6) AS BIGINT)) AS BIGINT) AS micros FROM f GROUP BY ep
UNION ALL SELECT ep, 'frames', '<i4', CAST(count(*) AS VARCHAR), CAST(sum(frame * 1000000) AS BIGINT) FROM f GROUP BY ep""",
}
