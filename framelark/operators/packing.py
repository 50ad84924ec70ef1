"""Greedy packing of a run of units under a budget, in parallel within a group, and running sums by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.session import cut

#: Whole numbers of the order, or of the running sum, that one task holds.
BLOCK = 1 << 16


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds, for each name: column of sums, the running sum up to and with a row, in order of a whole number that is unique by key.

    Ranges of block values of the order are summed first; a range is one task's work, and so are a key's sums, a row for each range."""
    ranged = rows.withColumn("_b", F.expr(f"floor(`{order}` / {block})"))
    totals = ranged.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    upto = Window.partitionBy(*keys).orderBy("_b")
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_c"), *[(F.sum(f"_t{i}").over(upto) - F.col(f"_t{i}")).alias(f"_p{i}") for i in range(len(sums))])
    match = F.col("_b") == F.col("_c")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_b").orderBy(order)
    joined = ranged.join(before, match)
    added = {name: (F.col(f"_p{i}") + F.sum(c).over(within)).cast("long") for i, (name, c) in enumerate(sums.items())}
    return joined.withColumns(added).select(*rows.columns, *sums)


def _next(units: DataFrame, key: str, budget: int, block: int) -> DataFrame:
    """(key, at, to): for each unit the first one that a chunk starting at it has no room for, if there is one.

    The running sums are cut into ranges of block values; a unit looks for the first running sum above its own start
    plus the budget, in that range or as the first of the next one that has any. Equal values are one row, so a range has block rows."""
    ends = units.groupBy(key, "upto").agg(F.min("at").alias("at"))
    asked = units.select(key, (F.col("upto") - F.col("size") + budget).alias("limit")).distinct()
    ranged = lambda c: F.floor(F.col(c) / block)
    both = ends.select(key, ranged("upto").alias("_b"), F.col("upto").alias("v"), "at").unionByName(asked.select(key, ranged("limit").alias("_b"), F.col("limit").alias("v"), F.lit(None).cast("long").alias("at")))
    # Of equal values the unit comes after the question: it must be above the limit.
    above = F.min("at").over(Window.partitionBy(key, "_b").orderBy(F.desc("v"), F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    first = both.groupBy(key, "_b").agg(F.min("at").alias("first"))
    later = first.select(key, "_b", F.min("first").over(Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    found = both.withColumn("above", above).where("at is null").join(later, [key, "_b"]).select(key, F.col("v").alias("limit"), F.coalesce("above", "later").alias("to"))
    own = units.withColumn("limit", F.col("upto") - F.col("size") + budget).join(found, [key, "limit"])
    return own.where("to is not null").select(key, "at", F.greatest("to", F.col("at") + 1).alias("to"))  # a larger unit stands alone


def greedy_chunks(units: DataFrame, key: str, order: str, size: str, budget: int, block: int = BLOCK) -> DataFrame:
    """Adds chunk (from 0) to units: a chunk is a run of units of a key, in order of a whole number that is unique in it, and a unit
    that would take it over the budget starts the next one. Sizes are whole numbers of 0 or more.

    Every unit's successor as a start is found at once; then the starts that the first unit leads to are marked by doubling: with
    the jumps of 2^k starts, those within 2^(k+1) starts are reached."""
    rows = units.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(size).cast("long").alias("size"), F.lit(1).alias("one"))
    rows = cut(running(rows, ["key"], "order", {"upto": "size", "place": "one"}, block).select("key", "order", "size", "upto", (F.col("place") - 1).alias("at")))
    jump = _next(rows, "key", budget, block)
    last = rows.groupBy("key").agg(F.max("at").alias("last"))
    jump = cut(jump.join(last, "key").where("to <= last").select("key", "at", "to"))
    starts = rows.where("at = 0").select("key", "at")
    while not jump.isEmpty():
        reached = starts.join(jump, ["key", "at"]).select("key", F.col("to").alias("at"))
        starts = cut(starts.unionByName(reached))
        twice = jump.select("key", F.col("to").alias("at"), F.col("at").alias("from")).join(jump, ["key", "at"])
        jump = cut(twice.select("key", F.col("from").alias("at"), "to"))
    marked = rows.join(starts.withColumn("start", F.lit(1)), ["key", "at"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    chunks = running(marked, ["key"], "at", {"chunk": "start"}, block).select("key", "order", (F.col("chunk") - 1).alias("chunk"))
    same = F.col(f"u.{key}").eqNullSafe(F.col("c.key")) & (F.col(f"u.{order}") == F.col("c.order"))
    return units.alias("u").join(chunks.alias("c"), same).select("u.*", "c.chunk")
