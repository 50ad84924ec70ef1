"""Feature statistics and the summary rules for latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.operators.ranks import order_statistics, percentiles

QUANTILES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def nano(c: Column) -> Column:
    """A double in whole billionths: sums of these don't depend on the order of the rows."""
    return F.round(c * 1e9).cast("long")


def ratio6(num: str, den: str) -> Column:
    """num / den of whole numbers, half up to six places, in whole numbers until the end; null for den 0."""
    return F.expr(f"((2 * cast({num} as decimal(38, 0)) * 1000000 + {den}) div (2 * nullif({den}, 0))) / 1e6D")


#: The same for the checking SQL.
def nano_sql(x: str) -> str:
    return f"CAST(round(({x}) * 1e9) AS BIGINT)"


def ratio6_sql(num: str, den: str) -> str:
    return f"CAST((2 * CAST({num} AS HUGEINT) * 1000000 + {den}) // (2 * nullif({den}, 0)) AS BIGINT) / 1e6"


def long_features(frames: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys..., feature, value): one row per frame and feature."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in features)
    return frames.selectExpr(*keys, f"stack({len(features)}, {pairs}) as (feature, value)")


def beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the columns of b, which has one row at most for each key; null is a key like any other."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), match, "left").select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in keys])


def feature_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """min, max, mean, population std, count and linear quantiles of value."""
    a = rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("k"))
    a = beside(a, percentiles(rows, keys, "value", QUANTILES), keys)
    return a.select(*keys, r6(F.col("lo")).alias("min"), r6(F.col("hi")).alias("max"), r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("std"), F.col("k").alias("count"), *[r6(F.col(k)).alias(k) for k in QUANTILES])


def nearest_rank(values: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """a[min(n - 1, int(p / 100 * n))] over the sorted values, with count, mean, population std and rate."""
    n = values.groupBy(key).agg(F.count(value).alias("k"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = {f"p{p}": F.least(F.col("n") - 1, F.floor(F.lit(p) / 100 * F.col("n"))) for p in percents}
    j = beside(n, order_statistics(values, [key], value, at), [key])
    two = lambda c: F.round(F.col(c), 2)
    return j.select(key, F.col("k").alias("count"), two("mean").alias("mean"), *[two(p).alias(p) for p in at], two("lo").alias("min"), two("hi").alias("max"), two("sd").alias("stdev"), F.round(1000 / F.col("mean"), 2).alias("hz"))
