"""Decoding of chunk-compressed points, and dense row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vertices of a chunk; bits of a place, a byte; the least distance of an opacity from 0 and 1.
CHUNK, PLACE_BITS, BYTE_BITS, EDGE = 256, 10, 8, 1e-6


def _cut(word: Column, shift: int, bits: int) -> Column:
    """bits of a word from shift on, as a share of their largest value."""
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << bits) - 1)) / float((1 << bits) - 1)


def _between(share: Column, name: str) -> Column:
    lo, hi = F.col(f"min_{name}").cast("double"), F.col(f"max_{name}").cast("double")
    return (lo + share * (hi - lo)).cast("float")


def decode_points(vertices: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, id, x, y, z, scale, rotation, albedo, density, specular, degree) of packed vertices and the bounds of their chunks.

    vertices: file, id, packed_position, packed_rotation, packed_scale, packed_color and f_rest_0 and on, if any (bytes); chunks: file,
    id and min_/max_ of x, y, z, scale_x, scale_y, scale_z, r, g, b. A vertex meets the chunk id div 256. Rotation is (w, x, y, z),
    its largest part being the one left out; density is the logit of the opacity; specular goes from channel by channel to
    coefficient by coefficient, in [-2, 2]. A vertex without a chunk is an error.
    """
    rest = sorted((c for c in vertices.columns if c.startswith("f_rest_")), key=lambda c: int(c.removeprefix("f_rest_")))
    bounds = chunks.withColumnRenamed("id", "_chunk").withColumn("_known", F.lit(True))
    v = vertices.withColumn("_chunk", F.expr(f"id div {CHUNK}")).join(bounds, ["file", "_chunk"], "left")
    place = [_between(_cut(F.col("packed_position"), PLACE_BITS * i, PLACE_BITS), n).alias(n) for i, n in enumerate("xyz")]
    triple = lambda word, names: F.array(*[_between(_cut(F.col(word), BYTE_BITS * i, BYTE_BITS), n) for i, n in enumerate(names)])
    three = [_cut(F.col("packed_rotation"), 2 + PLACE_BITS * i, PLACE_BITS) * math.sqrt(2) - math.sqrt(0.5) for i in range(3)]
    left = F.sqrt(F.greatest(F.lit(0.0), 1 - three[0] * three[0] - three[1] * three[1] - three[2] * three[2]))
    largest = F.col("packed_rotation").bitwiseAND(F.lit(3))
    turn = F.coalesce(*[F.when(largest == k, F.array(*[c.cast("float") for c in [*three[:k], left, *three[k:]]])) for k in range(4)])
    opacity = F.least(F.greatest(_cut(F.col("packed_color"), 24, BYTE_BITS), F.lit(EDGE)), F.lit(1 - EDGE))
    per = len(rest) // 3
    byte = lambda c: (F.col(c) / 255.0 * 4 - 2).cast("float")
    specular = F.array(*[byte(rest[channel * per + k]) for k in range(per) for channel in range(3)]).cast("array<float>")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no chunk for vertex "), F.col("id").cast("string"), F.lit(" of "), F.col("file")))).otherwise(F.col("id"))
    degree = int(math.sqrt(per + 1) - 1)
    return v.select(
        "file", known.alias("id"), *place, triple("packed_scale", ["scale_x", "scale_y", "scale_z"]).alias("scale"), turn.alias("rotation"), triple("packed_color", "rgb").alias("albedo"),
        F.log(opacity / (1 - opacity)).cast("float").alias("density"), specular.alias("specular"), F.lit(degree).cast("long").alias("degree"),
    )


def dense_ids(rows: DataFrame, order: list[str], name: str = "id", block: int = 1 << 16) -> DataFrame:
    """Adds the row number from 0 in the given order, whose first column is a whole number: rows are counted by ranges of it first.

    A range of block values of that column is numbered in one task; nothing else meets in one but the counts, a row for each range."""
    ranged = rows.withColumn("_b", F.expr(f"`{order[0]}` div {block}"))
    counts = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return ranged.join(before, "_b").withColumn(name, (F.col("_before") + place - 1).cast("long")).drop("_b", "_before")
