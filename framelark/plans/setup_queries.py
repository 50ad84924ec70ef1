"""Setup queries: names, roles, options, configurations, positions, descriptors and file stamps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators import setup
from framelark.operators.points import dense_ids
from framelark.operators.stats import r6
from framelark.plans.text_queries import q_buckets
from framelark.sinks import datasets
from framelark.sources.frames import FRAMES_SQL, event_frames, read_shards, read_table, real_or_gradient, with_gradient


def q_common_names(spark, d):
    """Names that a reference (small parts) and a candidate (large parts) both have, in the candidate's order."""
    p = read_table(spark, d, "part").select("p_name", "p_partkey", "p_size")
    ref = p.where("p_size < 25").select("p_name").distinct()
    cand = p.where("p_size >= 25").groupBy("p_name").agg(F.min("p_partkey").alias("first_key"))
    both = dense_ids(cand.join(ref, "p_name", "left_semi"), ["first_key", "p_name"])
    return both.select("p_name", (F.col("id") + 1).alias("place"))


def q_positions(spark, d):
    """The i-th click of a user beside the i-th view."""
    e = read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return setup.zip_by_position(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", ["ts", "event_id"], "value", "value")


def q_selected(spark, d):
    """The frames that were selected, one for each bucket of their episode."""
    chosen = q_buckets(spark, d).select("ep", "frame")
    return event_frames(spark, d).join(chosen, ["ep", "frame"], "left_semi").select("ep", "frame", "event_type", "state")


def q_size_ratio(spark, d):
    """Bytes after halving what is stored as F32 against bytes before, overall and of the halved kind alone."""
    p = read_table(spark, d, "part").select((F.col("p_size").cast("long") * 4).alias("src"), F.col("p_brand").endswith("1").alias("halved"))
    p = p.withColumn("dst", F.when(F.col("halved"), F.expr("src div 2")).otherwise(F.col("src")))
    part = lambda c: F.sum(F.when(F.col("halved"), F.col(c)))
    return p.agg(F.sum("src").alias("total_src"), F.sum("dst").alias("total_dst"), r6(F.try_divide(F.sum("dst"), F.sum("src"))).alias("ratio"), r6(F.try_divide(part("dst"), part("src"))).alias("halved_ratio"))


ROLES = [("image", "small", "ECONOMY", 0), ("state", "large", "STANDARD", 1), ("mask", "medium", "PROMO", 2), ("noise", "small", "ECONOMY", 1)]


def q_roles(spark, d):
    """Each brand's parts as the inputs of a model: name, kind and rank decide which one serves which role."""
    p = read_table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("dtype"), (F.col("p_size") % 3).alias("rank"))
    return setup.resolve_roles(p, "model", ROLES).select("model", "role", F.coalesce("key", F.lit(-1).cast("long")).alias("key"), "via")


CONFIG = [("O", "1-URGENT", "big", 30_000), ("O", "5-LOW", "small", 7_000), ("F", "1-URGENT", "big", 30_000), ("P", "3-MEDIUM", "mcmc", 15_000)]


def q_config(spark, d):
    """Orders by the configuration of their status and priority; a combination without one says so."""
    table = spark.createDataFrame(CONFIG, "o_orderstatus string, o_orderpriority string, preset string, steps long")
    o = setup.look_up(read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), table, ["o_orderstatus", "o_orderpriority"])
    return o.groupBy("o_orderstatus", "o_orderpriority", "known", F.coalesce("preset", F.lit("none")).alias("preset"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps")).agg(F.count("*").alias("n"))


def q_frames_of(spark, d):
    """Seconds to frames at the episode's rate and back, halves to the even frame."""
    e = read_table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("s"), F.when(F.col("user_id") % 2 == 0, 50.0).otherwise(30.0).alias("fps"))
    n = setup.frames_of(F.col("s"), F.col("fps"))
    return e.select("event_id", n.alias("frames"), F.round(n / F.col("fps"), 9).alias("seconds"))


def q_stripped(spark, d):
    t = setup.stripped(F.concat(F.lit("\t\x07 "), "text", F.lit("\r\n\x1b ")))
    return read_table(spark, d, "documents").select("doc_id", F.char_length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha"))


def q_video(spark, d):
    """The first video stream of a description made from each event: audio first, sometimes no video at all."""
    kind = F.when(F.col("event_type") == "error", "data").otherwise("video")
    doc = F.format_string('{"streams": [{"codec_type": "audio"}, {"codec_type": "%s", "width": %d, "height": 1080, "r_frame_rate": "%d/1001"}, {"codec_type": "video", "width": 1}]}', kind, F.col("user_id") + 1, F.col("event_id") % 7 * 1000)
    short = F.when(F.col("event_type") == "signup", F.lit('{"streams": [{"codec_type": "audio"}]}')).otherwise(doc)
    v = read_table(spark, d, "events").select("event_id", setup.first_video(short).alias("v"))
    return v.select("event_id", F.col("v").isNotNull().alias("found"), F.coalesce("v.width", F.lit(-1).cast("long")).alias("width"), r6(setup.rate(F.col("v.r_frame_rate"))).alias("fps"))


def q_unpack(spark, d):
    """Pipe-delimited configuration lines, unpacked; a missing field is empty."""
    line = F.concat_ws("|", F.concat(F.lit("run"), "o_orderkey"), "o_orderstatus", F.lit(""), "o_orderpriority")
    o = read_table(spark, d, "orders").select("o_orderkey", line.alias("line"))
    part = lambda i: F.split_part("line", F.lit("|"), F.lit(i))
    return o.select("o_orderkey", part(1).alias("run"), part(2).alias("status"), part(3).alias("extra"), part(4).alias("priority"), part(5).alias("none"))


def q_csv(spark, d):
    """A line of numbers, some blank, as a vector."""
    line = F.concat(F.col("event_id").cast("string"), F.lit(", ,"), F.expr("cast(cast(round(value * 100) as bigint) as string)"), F.lit(","))
    v = read_table(spark, d, "events").select("event_id", setup.numbers(line).alias("v"))
    return v.select("event_id", F.size("v").cast("long").alias("n"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("blanks"), F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"))


def q_samples(spark, d):
    """Step times out of a training log's lines, made from events; views have none."""
    ms = F.col("event_id") % 1000
    text = F.concat(F.lit("step:"), "event_id", F.lit("K loss:0.5"), F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.format_string(" updt_s:%d.%03d data_s:0.1\n updt_s:%d", F.col("user_id"), ms, ms)))
    e = read_table(spark, d, "events").select("event_id", setup.samples(text, "updt_s").alias("v"), setup.first_integer(text).alias("step"))
    return e.select("event_id", "step", F.size("v").cast("long").alias("n"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def q_dataset_episodes(spark, d):
    return datasets.episode_table(event_frames(spark, d), 10.0)


def q_stamp(spark, d):
    return read_table(spark, d, "events").select("event_id", F.date_format("ts", "'run_'yyyyMMdd'T'HHmmss'Z.json'").alias("name"))


def q_top(spark, d, n: int = 5, shown: int = 8):
    """The first outputs of each episode, with a preview of each one's values."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read_table(spark, d, "embeddings").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)
    preview = F.transform(F.slice("embedding", 1, shown), lambda x: F.round(x.cast("double"), 4))
    return e.select("label", "place", "vec_id", F.size(preview).cast("long").alias("shown"), F.aggregate(preview, F.lit(0).cast("long"), lambda a, x: a + F.round(x * 10000).cast("long")).alias("sum4"))


def q_modes(spark, d):
    """Distinct modes, largest first."""
    m = read_table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("width"), F.col("l_linenumber").cast("long").alias("rate")).distinct()
    return m.select("width", "rate", F.row_number().over(Window.orderBy(F.desc("width"), F.desc("rate"))).cast("long").alias("place"))  # a row per mode


def q_blind(spark, d):
    """States of the listed sources as zeros, the others as they are."""
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("state"))
    s = F.when(F.col("label").isin(1, 3), F.transform("state", lambda x: F.lit(0.0))).otherwise(F.col("state"))
    return e.select("vec_id", F.size(s).cast("long").alias("width"), r6(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x))).alias("total"))


def q_streams(spark, d):
    """Data streams of each conversation, told apart by a table of known tags."""
    known = F.create_map(F.lit("user"), F.lit("gps"), F.lit("system"), F.lit("imu"))
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"))
    tags = F.transform(F.filter("s", lambda x: known[x.role].isNotNull()), lambda x: known[x.role])
    return c.select("conv_id", F.array_join(tags, ",").alias("telemetry"), F.size(F.filter("s", lambda x: known[x.role].isNull())).cast("long").alias("others"))


def q_keys(spark, d):
    """Observation keys renamed; unknown ones stay."""
    m = F.create_map(F.lit("image"), F.col("value"), F.lit("state"), F.col("user_id").cast("double"), F.col("event_type"), F.lit(1.0))
    out = setup.renamed_keys(m, {"image": "observation/image", "state": "observation/state"})
    return read_table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(out)), "|").alias("keys"), out["observation/image"].alias("image"))


def q_features(spark, d):
    """The features that are left without what the dataset manages itself, with their counts."""
    f = setup.features(event_frames(spark, d))
    return f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("there")) for c in f.columns])).alias("x")).groupBy("x.feature").agg(F.count_if("x.there").alias("n"))


def q_episode(spark, d):
    return setup.one_episode(event_frames(spark, d), 0).select("frame", "state", "slew", "move")


def q_hosts(spark, d):
    h = setup.host_of(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("tcp://127.0.0."), F.col("page_id") % 200, F.lit(":5555"))).when(F.col("page_id") % 3 == 1, F.lit("http://LOCALHOST/x")).otherwise(F.col("url")))
    return read_table(spark, d, "pages").select("page_id", h.alias("host"), setup.is_loopback(h).alias("loopback"))


def q_flags(spark, d):
    """Whether the largest difference stays within a tight and a loose threshold."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    places = F.when(F.col("vec_id") % 3 == 0, 1e5).when(F.col("vec_id") % 3 == 1, 5e3).otherwise(1e2)
    e = read_table(spark, d, "embeddings").select("vec_id", v.alias("a"), F.transform(v, lambda x: F.floor(x * places) / places).alias("b"))
    m = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return e.select("vec_id", (m < 1e-4).alias("within_1e4"), (m < 1e-3).alias("within_1e3"))


def q_shards(spark, d):
    return read_shards(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))


def q_gradient(spark, d):
    """A synthetic image of 16 rows for every recorded frame."""
    return with_gradient(event_frames(spark, d).select("ep", "frame"), 16)


def q_fallback(spark, d):
    """The recorded conversations, as there are some: the synthetic frames stand in only where nothing is."""
    return real_or_gradient(spark, f"{d}/conversations.parquet", 40, 4).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


QUERIES = {
    "common_names": q_common_names, "zip_by_position": q_positions, "selected_frames": q_selected, "size_ratio": q_size_ratio, "role_resolver": q_roles, "config_lookup": q_config,
    "seconds_to_frames": q_frames_of, "control_strip": q_stripped, "first_video_stream": q_video, "pipe_unpack": q_unpack, "csv_vector": q_csv, "file_stamp": q_stamp, "first_outputs": q_top,
    "distinct_modes": q_modes, "state_blind": q_blind, "stream_tags": q_streams, "renamed_keys": q_keys, "own_features": q_features, "one_episode": q_episode, "loopback_hosts": q_hosts,
    "parity_flags": q_flags, "shard_reader": q_shards, "synthetic_gradient": q_gradient, "golden_fallback": q_fallback,
    "log_samples": q_samples, "dataset_episodes": q_dataset_episodes,
}


def _roles_sql() -> str:
    steps, left = [], "p0"
    picks = []
    n = 0
    for via in ("name", "shape"):
        for role, word, dtype, rank in ROLES:
            n += 1
            fit = f"dtype = '{dtype}' AND rank = {rank}"
            if via == "name":
                steps.append(f"k{n} AS (SELECT model, min(key) AS key FROM {left} WHERE {fit} AND contains(name, '{word}') GROUP BY model)")
            else:
                done = " UNION ALL ".join(f"SELECT model FROM k{i} WHERE '{r}' = '{role}'" for i, r, _ in picks)
                steps.append(f"k{n} AS (SELECT model, min(key) AS key FROM {left} WHERE {fit} AND model NOT IN ({done}) GROUP BY model HAVING count(*) = 1)")
            steps.append(f"p{n} AS (SELECT * FROM {left} WHERE (model, key) NOT IN (SELECT model, key FROM k{n}))")
            picks.append((n, role, via))
            left = f"p{n}"
    found = " UNION ALL ".join(f"SELECT model, '{r}' AS role, key, '{v}' AS via FROM k{i}" for i, r, v in picks)
    names = ", ".join(f"'{r[0]}'" for r in ROLES)
    return f"""WITH p0 AS (SELECT p_brand AS model, p_partkey AS key, p_name AS name, p_type AS dtype, p_size % 3 AS rank FROM part), {", ".join(steps)}, found AS ({found}),
want AS (SELECT model, unnest([{names}]) AS role FROM (SELECT DISTINCT model FROM p0)) SELECT want.model, want.role, coalesce(key, -1) AS key, coalesce(via, 'missing') AS via FROM want LEFT JOIN found USING (model, role)"""


_CONTROL_SQL = " || ".join(f"chr({c})" for c in [*range(1, 33), 127])

ORACLE = {
    "common_names": "SELECT p_name, row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part WHERE p_size >= 25 AND p_name IN (SELECT p_name FROM part WHERE p_size < 25) GROUP BY p_name",
    "zip_by_position": """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS place FROM events),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.place, b.place) AS place, a.value AS a, b.value AS b, a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS paired FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.place = b.place)
SELECT user_id, place, a, b, bool_and(paired) OVER (PARTITION BY user_id) AS complete FROM j""",
    "selected_frames": f"""WITH {FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM f), b AS (SELECT *, ((frame + 1) * 7 - 1) // n AS bucket FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY ep, bucket ORDER BY state >= 20 DESC, state DESC, frame) AS rn FROM b) SELECT ep, frame, event_type, state FROM r WHERE rn = 1""",
    "size_ratio": """WITH p AS (SELECT CAST(p_size AS BIGINT) * 4 AS src, p_brand LIKE '%1' AS halved FROM part), q AS (SELECT *, CASE WHEN halved THEN src // 2 ELSE src END AS dst FROM p)
SELECT CAST(sum(src) AS BIGINT) AS total_src, CAST(sum(dst) AS BIGINT) AS total_dst, round(sum(dst) / sum(src), 6) AS ratio, round(sum(dst) FILTER (WHERE halved) / sum(src) FILTER (WHERE halved), 6) AS halved_ratio FROM q""",
    "role_resolver": _roles_sql(),
    "config_lookup": "SELECT o_orderstatus, o_orderpriority, c.preset IS NOT NULL AS known, coalesce(preset, 'none') AS preset, coalesce(steps, 0) AS steps, count(*) AS n FROM orders LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}', '{p}', {n}::BIGINT)" for a, b, p, n in CONFIG) + ") c(s, p, preset, steps) ON s = o_orderstatus AND p = o_orderpriority GROUP BY ALL",
    "seconds_to_frames": "WITH e AS (SELECT event_id, value / 100 AS s, CASE WHEN user_id % 2 = 0 THEN 50.0::DOUBLE ELSE 30.0 END AS fps FROM events), n AS (SELECT *, CAST(round_even(s * fps, 0) AS BIGINT) AS frames FROM e) SELECT event_id, frames, round(frames / fps, 9) AS seconds FROM n",
    "control_strip": f"WITH t AS (SELECT doc_id, trim(coalesce(chr(9) || chr(7) || ' ' || text || chr(13) || chr(10) || chr(27) || ' ', ''), {_CONTROL_SQL}) AS t FROM documents) SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM t",
    "first_video_stream": "SELECT event_id, event_type <> 'signup' AS found, CASE event_type WHEN 'signup' THEN -1 WHEN 'error' THEN 1 ELSE user_id + 1 END AS width, CASE WHEN event_type NOT IN ('signup', 'error') THEN round(event_id % 7 * 1000 / 1001, 6) END AS fps FROM events",
    "pipe_unpack": "SELECT o_orderkey, 'run' || o_orderkey AS run, o_orderstatus AS status, '' AS extra, o_orderpriority AS priority, '' AS none FROM orders",
    "csv_vector": "SELECT event_id, CAST(4 AS BIGINT) AS n, CAST(2 AS BIGINT) AS blanks, CAST(event_id + CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS total FROM events",
    "file_stamp": "SELECT event_id, strftime(ts, 'run_%Y%m%dT%H%M%SZ.json') AS name FROM events",
    "first_outputs": """WITH e AS (SELECT label, vec_id, embedding[1:8] AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings)
SELECT label, place, vec_id, len(p) AS shown, CAST(list_sum(list_transform(p, lambda x: CAST(round(round(CAST(x AS DOUBLE), 4) * 10000) AS BIGINT))) AS BIGINT) AS sum4 FROM e WHERE place <= 5""",
    "distinct_modes": "SELECT width, rate, row_number() OVER (ORDER BY width DESC, rate DESC) AS place FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS width, CAST(l_linenumber AS BIGINT) AS rate FROM lineitem)",
    "state_blind": "SELECT vec_id, len(embedding) AS width, round(CASE WHEN label IN (1, 3) THEN 0.0 ELSE list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) END, 6) AS total FROM embeddings",
    "stream_tags": """SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'gps' WHEN 'system' THEN 'imu' END, ',' ORDER BY turn, role), '') AS telemetry, count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'system')) AS others FROM conversations GROUP BY conv_id""",
    "renamed_keys": "SELECT event_id, array_to_string(list_sort([event_type, 'observation/image', 'observation/state']), '|') AS keys, value AS image FROM events",
    "own_features": f"WITH {FRAMES_SQL} SELECT unnest(['event_type', 'state', 'slew', 'move']) AS feature, unnest([count(event_type), count(state), count(slew), count(move)]) AS n FROM f",
    "one_episode": f"WITH {FRAMES_SQL} SELECT frame, state, slew, move FROM f WHERE ep = 0",
    "loopback_hosts": r"""WITH h AS (SELECT page_id, lower(CASE page_id % 3 WHEN 0 THEN '127.0.0.' || (page_id % 200) WHEN 1 THEN 'localhost' ELSE regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) END) AS host FROM pages) SELECT page_id, host, host = 'localhost' OR host LIKE '127.0.0.%' AS loopback FROM h""",
    "parity_flags": """WITH e AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 1e5 WHEN 1 THEN 5e3 ELSE 1e2 END AS p, unnest(embedding)::DOUBLE AS a FROM embeddings), m AS (SELECT vec_id, max(abs(a - floor(a * p) / p)) AS m FROM e GROUP BY vec_id) SELECT vec_id, m < 1e-4 AS within_1e4, m < 1e-3 AS within_1e3 FROM m""",
    "shard_reader": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "synthetic_gradient": f"WITH {FRAMES_SQL}, r AS (SELECT unnest(range(16)) AS row) SELECT ep, frame, row, (frame * 3 + row * 5) % 256 AS level FROM f, r",
    "golden_fallback": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
    "log_samples": "SELECT event_id, event_id AS step, CAST(CASE event_type WHEN 'view' THEN 0 ELSE 2 END AS BIGINT) AS n, CASE event_type WHEN 'view' THEN CAST(0 AS DOUBLE) ELSE round(user_id + event_id % 1000 / CAST(1000 AS DOUBLE) + event_id % 1000, 6) END AS total FROM events",
    "dataset_episodes": f"""WITH {FRAMES_SQL}, e AS (SELECT ep, count(*) AS length FROM f GROUP BY ep), o AS (SELECT *, CAST(sum(length) OVER (ORDER BY ep) AS BIGINT) AS hi FROM e)
SELECT row_number() OVER (ORDER BY ep) - 1 AS episode_index, ep AS source_episode, length, hi - length AS dataset_from_index, hi AS dataset_to_index, CAST(length / CAST(10 AS DOUBLE) AS DOUBLE) AS duration, 0::BIGINT AS "data/chunk_index", 0::BIGINT AS "data/file_index", 0::BIGINT AS "meta/episodes/chunk_index", 0::BIGINT AS "meta/episodes/file_index" FROM o""",
}
