"""Importance resampling toward a target distribution, in DataFrame functions only.

A text's features are its runs of 1 to LONGEST consecutive words; a feature falls into one of BUCKETS
buckets by the crc32 of its bytes. Exploded buckets are counted for all documents and for all target
texts (a task sends one row for each bucket at most). A bucket's gain is the floored log ratio of
its smoothed shares; the table of gains, BUCKETS rows, is broadcast and joined, and a document's weight is the
floored mean over its features. Drawing without replacement takes the highest weights plus Gumbel
noise, which a hash of seed and id gives: one distributed sort, then each row's rank is its place in
its partition plus the rows of the partitions before.

Defined results: null or empty text has no words, no features, weight 0; a null id has no score and
is never drawn; rows that share an id count each, ties between them in order of n_features, weight
and n_words; rows equal in id and text share one fate in resample(); with an empty target all target counts are
0; texts are taken whole; in resample() all columns stay, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds the two tables of counts and the broadcast table of gains.
BUCKETS = 10_000
LONGEST, LEAST_WORDS, PERCENT, SEED = 2, 20, 25, 7
#: Runs of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _runs(n: int, buckets: int) -> str:
    """SQL of the buckets of all runs of n words of the array w."""
    parts = ", ".join(["x", *[f"' ', get(w, i + {k})" for k in range(1, n)]])
    return f"transform(slice(w, 1, greatest(size(w) - {n - 1}, 0)), (x, i) -> crc32(cast(concat({parts}) AS binary)) % {buckets})"


def _bucketed(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """text becomes n_words and the array b of its features' buckets."""
    rest = [c for c in rows.columns if c != "text"]
    found = F.expr(f"concat({', '.join(_runs(n, buckets) for n in range(1, longest + 1))})")
    return rows.select(*rest, words(F.col("text")).alias("w")).select(*rest, F.size("w").alias("n_words"), found.alias("b"))


def _counts(texts: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    # Not explode(): the filter that Spark infers from it would be pushed below and split each text once a word.
    return _bucketed(texts, longest, buckets).select(F.explode_outer("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name)).where("bucket is not null")


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket int, gain long) of every bucket, from the counts of all documents and all target texts."""
    spark = docs.sparkSession
    here = _counts(docs.select(F.col(f"`{text_col}`").alias("text")), longest, buckets, "s")
    there = _counts(target.select(F.col(f"`{target_col}`").alias("text")), longest, buckets, "t")
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = cut(every.join(here, "bucket", "left").join(there, "bucket", "left").fillna(0, ["s", "t"]))
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = F.expr(f"(cast(t + 1 AS double) * cast(all_s + {buckets} AS double)) / (cast(s + 1 AS double) * cast(all_t + {buckets} AS double))")
    # one row of totals beside at most BUCKETS rows
    return cut(both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")))


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, doc, n_words, n_features, weight) for each row of docs; doc is a hash of its text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    # One more element a row, in no bucket, keeps texts without features and counts rows that are equal.
    each = _bucketed(rows, longest, buckets).select("id", "doc", "n_words", F.explode_outer(F.concat("b", F.array(F.lit(-1).cast("bigint")))).alias("bucket"))
    summed = each.join(F.broadcast(gain), "bucket", "left").groupBy("id", "doc", "n_words").agg(
        F.count("gain").alias("k"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"), F.count_if(F.col("bucket") < 0).alias("copies")
    )
    one = summed.select("id", "doc", F.col("n_words").cast("long").alias("n_words"), F.expr("k div copies").alias("n_features"), F.expr("sum div copies").alias("sum"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return one.select("id", "doc", "n_words", "n_features", weight.alias("weight"))


def draw(weighed: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds score and rank (long; null unless drawn) to rows of weights(): percent of those with least_words words."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("fit", (F.col("n_words") >= least_words) & F.col("id").isNotNull())
    ordered = scored.orderBy(F.desc("fit"), F.desc("score"), "id", "n_features", "weight", "n_words", "doc")
    # A row's partition and its place within: upper and lower bits of this number, made once by the checkpoint.
    placed = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = cut(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit")))
    before = sizes.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before", "sum(n_fit) OVER () AS n_fit")  # a row for each partition
    rank = F.col("before") + place + 1
    drawn = rank <= F.expr(f"n_fit * {percent} div 100")
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("id", "doc", "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    gain = gains(docs, target, text_col, target_col)
    taken = draw(weights(docs, gain, id_col, text_col), percent, seed).where("rank is not null").groupBy("id", "doc").agg(F.min("rank").alias("rank")).alias("taken")
    same = (F.col(f"all.`{id_col}`") == F.col("taken.id")) & (F.xxhash64(F.coalesce(F.col(f"all.`{text_col}`"), F.lit(""))) == F.col("taken.doc"))
    return docs.alias("all").join(taken, same, "left_semi")


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(docs, table(spark, sf_dir, "benchmark").select("text"))
    return draw(weights(docs, gain)).select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 byte by byte over a table made by its rule; each distinct feature once.
SQL = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM texts),
f AS (SELECT kind, id, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM f)),
bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM bytes, tab),
fb AS (SELECT kind, id, n_words, bucket FROM f JOIN bucket USING (f)),
cnt AS (SELECT b.bucket, count(fb.bucket) FILTER (WHERE kind = 0) AS s, count(fb.bucket) FILTER (WHERE kind = 1) AS t
        FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN fb USING (bucket) GROUP BY b.bucket),
tot AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM cnt),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(all_s + {BUCKETS} AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM cnt, tot),
per AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM fb JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
weighed AS (SELECT w.id AS doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
              CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE CAST((g - ((g % n) + n) % n) // n AS BIGINT) END AS weight,
              CAST('0x' || substr(sha256({SEED} || ':' || w.id), 1, 8) AS BIGINT) AS h
            FROM w LEFT JOIN per USING (id) WHERE kind = 0),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT CAST(s.doc_id AS BIGINT) AS doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)"""
