"""Audit of how filters interact: every order of five filters, replayed on every document.

Each document gets five failure flags from its whole text (and, for exact copies, from all texts). The
flags are crossed with the 120 broadcast orders, five steps are exploded, the first failure is
computed, and conditional sums by part, order and step follow: a task sends one row for each of those keys at
most, however many documents it holds.

Before they are crossed, the flags (a few bytes a document) are dealt anew, so that each text is looked at once.

The filters' letters: A few words, B few distinct words, C many capitals, D symbols, E copy of an earlier
document's text. Copies are equal when the SHA-256 of their UTF-8 bytes are; a text that very many
documents share is reduced to its smallest id before it is shuffled, and joined back by a broadcast of
the few such texts, all others by a shuffle.

Defined results: null text is an empty text; null source is the empty string's part; a row with a null id is
never a copy, nor is one a copy of it; rows that share an id count each, and are no copies of each other; a
document's labels count if any of its label rows says so; documents without labels lose nothing good or
toxic; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
#: A text with more than one in HEAVY of the rows that have copies is joined by a broadcast; so there are fewer than HEAVY.
HEAVY = 1000
TASKS_A_CORE = 3
_WORD = r"[^\x20\x09-\x0D]+"
_SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic) for each document; fails has bit k set where filter k fails it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("w"))
    own = [
        F.size("w") < 50,
        100 * F.size(F.array_distinct("w")) < 65 * F.size("w"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    bits = sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(own)), F.lit(0))
    slim = rows.select("id", "part", bits.alias("bits"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("body"))
    again = slim.where("id is not null").groupBy("body").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    again = cut(again.where("first < last").select("body", "first", "n"))
    rows = again.agg(F.sum("n")).first()[0] or 0
    # Bodies that more than one in HEAVY of these rows share are fewer than HEAVY: broadcast. All others are too rare to make a task large.
    heavy = again.where(F.col("n") * HEAVY > rows).select(F.col("body").alias("heavy"), F.col("first").alias("heavy_first"))
    met = slim.join(F.broadcast(heavy), F.col("body") == F.col("heavy"), "left")
    own_key = F.monotonically_increasing_id().cast("string").cast("binary")  # shorter than any body: meets none
    met = met.withColumn("key", F.when(F.col("heavy").isNull(), F.col("body")).otherwise(own_key))
    light = again.where(F.col("n") * HEAVY <= rows).select(F.col("body").alias("key"), "first")
    marked = met.join(light, "key", "left").withColumn("fails", F.col("bits") + F.when(F.coalesce("heavy_first", "first") < F.col("id"), F.lit(16)).otherwise(F.lit(0)))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    joined = marked.join(told, marked["id"] == told["doc_id"], "left")
    return joined.select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders: filter_order and the filters' bits in that order, b1 to b5."""
    rows = [("".join(o), *[1 << FILTERS.index(c) for c in o]) for o in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, b1 int, b2 int, b3 int, b4 int, b5 int")


def audit(flagged: DataFrame) -> DataFrame:
    """One row for each part, order and step, from rows of flags()."""
    spark = flagged.sparkSession
    # The shuffle makes the flags values. Within one stage Spark computes a column where it is used, here inside the loop over the orders: every text 120 times.
    dealt = flagged.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    crossed = dealt.crossJoin(F.broadcast(orders(spark)))  # 120 orders, as the replay asks
    failure = F.coalesce(*[F.when(F.col("fails").bitwiseAND(F.col(f"b{k}")) != 0, F.lit(k)) for k in range(1, 6)], F.lit(6))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(1, 6)]))
    each = crossed.withColumn("failure", failure).select("part", "filter_order", "fails", "good", "toxic", "failure", steps.alias("s"))
    removed = F.col("failure") == F.col("s.step")
    fails = F.col("fails").bitwiseAND(F.col("s.bit")) != 0
    sums = each.groupBy("part", "filter_order", F.col("s.step").alias("step")).agg(
        F.count_if(F.col("failure") > F.col("s.step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails & (F.col("failure") < F.col("s.step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("s.bit")).alias("unique_fails"),
        F.count_if(removed & (F.col("good") == 1)).alias("good_lost"),
        F.count_if(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    letter = F.expr("substring(filter_order, step, 1)")
    shapley = F.expr("sum(removed) OVER (PARTITION BY part, letter)").alias("shapley")  # 120 rows for each part and letter
    return sums.withColumn("letter", letter).select("part", "filter_order", "step", *_SUMS, shapley)


def query(spark, sf_dir):
    from .common import table

    return audit(flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
flag AS (SELECT doc_id, part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
           min(doc_id) OVER (PARTITION BY text) < doc_id AS E FROM d),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
long AS (SELECT f.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, A::INT + B::INT + C::INT + D::INT + E::INT AS n_fails,
           unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([A, B, C, D, E]) AS fails FROM flag f LEFT JOIN told USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT *, instr(filter_order, letter) AS step,
        min(CASE WHEN fails THEN instr(filter_order, letter) ELSE 6 END) OVER (PARTITION BY filter_order, doc_id) AS failure FROM long, o),
s AS (SELECT part, filter_order, letter, step, count(*) FILTER (WHERE failure > step) AS kept, count(*) FILTER (WHERE failure = step) AS removed,
        count(*) FILTER (WHERE fails AND failure < step) AS redundant, count(*) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
        count(*) FILTER (WHERE failure = step AND good = 1) AS good_lost, count(*) FILTER (WHERE failure = step AND toxic = 1) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s"""
