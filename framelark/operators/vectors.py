"""Parity of vector outputs: cosine under five zero-norm policies, differences, gates, shapes, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_policies(a: str, b: str) -> dict[str, Column]:
    """What a zero norm means: both_zero (1 when both are, else 0), nan, equal (1 iff a = b), unguarded, epsilon."""
    x, y = F.col(a), F.col(b)
    d, na, nb = dot(x, y), F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
    any_zero = (na == 0) | (nb == 0)
    plain = F.try_divide(d, na * nb)
    same = F.forall(F.zip_with(x, y, lambda p, q: p == q), lambda t: t)
    return {
        "both_zero": F.when(any_zero, F.when((na == 0) & (nb == 0), 1.0).otherwise(0.0)).otherwise(plain),
        "nan": F.when(any_zero, F.lit(float("nan"))).otherwise(plain),
        "equal": F.when(any_zero, F.when(same, 1.0).otherwise(0.0)).otherwise(plain),
        "unguarded": plain,
        "epsilon": d / (na * nb + 1e-8),
    }


def gate(df: DataFrame, cos_min: float, abs_max: float) -> DataFrame:
    """worst_cos, worst_abs, nonfinite -> passed, reasons."""
    why = F.array_compact(F.array(F.when(F.col("nonfinite"), "non-finite"), F.when(F.col("worst_cos") < cos_min, "cosine"), F.when(F.col("worst_abs") > abs_max, "max_abs")))
    return df.withColumn("reasons", F.array_join(why, "+")).withColumn("passed", F.size(why) == 0)


def fit_width(a: Column, width: int, fill: float = 0.0) -> Column:
    """Pad with `fill`, or cut, to a width."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), width)), 1, width)


def clamp_sentinels(x: Column, bound: float = 1e30, to: float = 1e4) -> Column:
    """Infinite or huge values become +-to; NaN stays NaN."""
    big = ~F.isnan(x) & (F.abs(x) >= bound)
    return F.when(big, F.signum(x) * to).otherwise(x)
