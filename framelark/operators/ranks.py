"""Exact order statistics by key, without a task that holds a key.

Keys of few rows are ranked from their counts of equal values. For a key of many rows each wanted rank is
narrowed down: a sketch of the values gives two bounds around the rank, one pass counts what lies below and between
them, and only what lies between goes on, about a fiftieth of the rows, until few are left or the rank is a bound itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.session import cut

#: Rows of a key, or between two bounds, that one task may rank; steps of the sketch; rows of a table that is broadcast.
LIMIT, STEPS, SMALL = 1 << 16, 100, 10_000


def _beside(rows: DataFrame, table: DataFrame, n: int, keys: list[str], *more: str) -> DataFrame:
    """rows with the columns of a table of n rows, by null-safe keys."""
    t = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *more)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(F.broadcast(t) if n <= SMALL else t, match).drop(*[f"_{k}" for k in keys])


def _of_few(v: DataFrame, sizes: DataFrame, n: int, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    counts = v.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))  # LIMIT rows at most
    ranked = _beside(counts.withColumn("upto", upto), sizes, n, keys, "n")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(name) for name, r in ranks.items()])


def _of_many(v: DataFrame, sizes: DataFrame, n: int, keys: list[str], ranks: dict[str, Column], limit: int) -> DataFrame:
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("left")) for name, r in ranks.items()])).alias("w")
    # left: the rank among the m rows of the range that is still in question.
    state = cut(sizes.select(*keys, F.col("n").alias("m"), wanted).select(*keys, "m", "w.*"))
    by, n = [*keys, "name"], n * len(ranks)
    near, found = _beside(v, state, n, keys, "name"), []
    while n:
        sketch = near.groupBy(*by).agg(F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], 100 * STEPS).alias("q"))
        share = F.col("left") / F.col("m") * STEPS
        lo, hi = F.get("q", F.greatest(F.floor(share) - 1, F.lit(0)).cast("int")), F.get("q", F.least(F.ceil(share) + 1, F.lit(STEPS)).cast("int"))
        bounds = cut(_beside(state, sketch, n, by, "q").select(*by, "left", "m", lo.alias("lo"), hi.alias("hi")))
        at = _beside(near, bounds, n, by, "lo", "hi")
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        counts = at.groupBy(*by).agg(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if((v > lo) & (v < hi)).alias("inside"))
        new = _beside(bounds, counts, n, by, "below", "at_lo", "inside").withColumn("left", F.col("left") - F.col("below"))
        # The sketch's error is a hundredth of a step, so the rank lies between the bounds. It is one of them, or strictly between.
        answer = F.when(F.col("left") < 0, F.raise_error(F.lit("a rank below its bounds"))).when(F.col("left") < F.col("at_lo"), lo).when(F.col("left") >= F.col("at_lo") + F.col("inside"), hi)
        new = cut(new.select(*by, (F.col("left") - F.col("at_lo")).cast("long").alias("left"), F.col("inside").alias("m"), "lo", "hi", answer.alias("answer")))
        found.append(new.where("answer is not null").select(*by, F.col("answer").alias("v")))
        open_ = new.where("answer is null")
        within = cut(_beside(near, open_, n, by, "lo", "hi").where("v > lo and v < hi").select(*by, "v"))
        few = open_.where(F.col("m") <= limit)
        counted = _beside(within, few, n, by, "left").groupBy(*by, "left", "v").agg(F.count("*").alias("c"))
        upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy("v")))  # limit rows at most
        found.append(upto.where("upto > left").groupBy(*by).agg(F.min("v").alias("v")))
        state = cut(open_.where(F.col("m") > limit).select(*by, "left", "m"))
        n = state.count()
        near = _beside(within, state, n, by)
    rows = reduce(DataFrame.unionByName, found)
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return _beside(wide, sizes, SMALL + 1, keys, "n").select(*keys, "n", *ranks)


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], limit: int = LIMIT) -> DataFrame:
    """(keys..., n, one column for each of ranks): the value at that place, from 0, of the sorted values of a key.

    ranks are whole-number columns of n, the count of the key's values that are not null; they must lie within it.
    NaN comes last, as Spark orders it. keys must differ from v, n, m, name, left, lo and hi."""
    v = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = cut(v.groupBy(*keys).agg(F.count("*").alias("n")))
    all_keys, many = sizes.agg(F.count("*"), F.count_if(F.col("n") > limit)).first()
    if not many:
        return _of_few(v, sizes, all_keys, keys, ranks)
    few, large = sizes.where(F.col("n") <= limit), sizes.where(F.col("n") > limit)
    return _of_few(_beside(v, few, all_keys, keys), few, all_keys, keys, ranks).unionByName(_of_many(_beside(v, large, many, keys), large, many, keys, ranks, limit))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """(keys..., n, one column for each share): linear between the two values around (n - 1) * share."""
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in shares.items()}
    ranks = {f"{k}_{name}": fn(x).cast("long") for name, x in at.items() for k, fn in (("lo", F.floor), ("hi", F.ceil))}
    s = order_statistics(rows, keys, value, ranks, limit)
    lo, hi = (lambda n: F.col(f"lo_{n}")), (lambda n: F.col(f"hi_{n}"))
    return s.select(*keys, "n", *[F.when(lo(n) == hi(n), lo(n)).otherwise(lo(n) + (x - F.floor(x)) * (hi(n) - lo(n))).alias(n) for n, x in at.items()])
