"""Packed words, position embeddings and small images held as arrays, all as column expressions.

An image is a flat array of h * w values, row by row. Null input gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The means and deviations that image models of three channels are trained with.
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)


def _bits(word: Column, at: int, mask: int) -> Column:
    return F.shiftrightunsigned(word, at).bitwiseAND(F.lit(mask))


def unpack_bytes(word: Column, lo: Column, hi: Column) -> Column:
    """The three low bytes of a word, each as a value between lo and hi."""
    return F.array(*[lo + _bits(word, at, 255) / 255.0 * (hi - lo) for at in (0, 8, 16)])


def smallest_three(word: Column) -> Column:
    """(w, x, y, z) of a unit quaternion: two bits name the largest part, three times ten bits hold the others in order."""
    parts = [_bits(word, at, 1023) / 1023.0 * math.sqrt(2) - math.sqrt(0.5) for at in (2, 12, 22)]
    left = F.sqrt(F.greatest(F.lit(0.0), 1.0 - parts[0] * parts[0] - parts[1] * parts[1] - parts[2] * parts[2]))
    largest = _bits(word, 0, 3)
    out = F.array(left, *parts)
    for at in (1, 2, 3):
        out = F.when(largest == at, F.array(*parts[:at], left, *parts[at:])).otherwise(out)
    return out


def sinusoidal(time: Column, dim: int, shortest: float, longest: float) -> Column:
    """Sines, then cosines, of time over dim // 2 periods in geometric steps."""
    half = dim // 2
    angles = [time * (2 * math.pi / (shortest * (longest / shortest) ** (i / max(half - 1, 1)))) for i in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def timestep(time: Column, dim: int, longest: float) -> Column:
    """Cosines, then sines, of time at dim // 2 falling frequencies; a zero fills an odd dim."""
    half = dim // 2
    angles = [time * math.exp(-math.log(longest) * i / half) for i in range(half)]
    return F.array(*[F.cos(a) for a in angles], *[F.sin(a) for a in angles], *[F.lit(0.0)] * (dim % 2))


def fitted(h: Column, w: Column, height: int, width: int) -> Column:
    """Where an image lands that keeps its aspect in height x width: its size, and the padding above and on the left."""
    ratio = F.greatest(w / F.lit(width), h / F.lit(height))
    rows, cols = F.floor(h / ratio), F.floor(w / ratio)
    return F.struct(rows.alias("rows"), cols.alias("cols"), (F.lit(height) - rows).alias("top"), (F.lit(width) - cols).alias("left"))


def centre_square(h: Column, w: Column) -> Column:
    side = F.least(h, w)
    half = lambda x: F.floor((x - side) / 2)
    return F.struct(half(h).alias("top"), half(w).alias("left"), side.alias("side"))


def normalised(image: Column, channel: int) -> Column:
    return F.transform(image, lambda x: (x / 255.0 - IMAGE_MEAN[channel]) / IMAGE_STD[channel])


def resized(image: Column, h: int, w: int, size: int) -> Column:
    """size x size by the nearest row and column before each place."""
    at = lambda i, n: F.floor(i * F.lit(n / size))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.transform(places, lambda k: F.get(image, (at(F.floor(k / size), h) * w + at(k % size, w)).cast("int")))


def letterboxed(image: Column, h: int, w: int, height: int, width: int, pad: float = 0.0) -> Column:
    """height x width that holds the image in its aspect, bilinear by centres of places (edges repeat), at the bottom right; the rest is pad."""
    if (h, w) == (height, width):
        return F.transform(image, lambda x: x.cast("double"))
    ratio = max(w / width, h / height)
    rows, cols = int(h / ratio), int(w / ratio)
    top, left = height - rows, width - cols
    if not rows or not cols:  # so flat or so narrow that nothing of it is left
        return F.array_repeat(F.lit(pad), height * width)

    def weighed(i: Column, n: int, out: int) -> tuple[Column, Column, Column]:
        at = F.least(F.greatest((i + 0.5) * F.lit(n / out) - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
        low = F.floor(at)
        return low, F.least(low + 1, F.lit(n - 1)), at - low

    def place(k: Column) -> Column:
        r, c = F.floor(k / width) - top, k % width - left
        r0, r1, fr = weighed(r, h, rows)
        c0, c1, fc = weighed(c, w, cols)
        get = lambda i, j: F.get(image, (i * w + j).cast("int"))
        mixed = (get(r0, c0) * (1 - fc) + get(r0, c1) * fc) * (1 - fr) + (get(r1, c0) * (1 - fc) + get(r1, c1) * fc) * fr
        return F.when((r < 0) | (c < 0), F.lit(pad)).otherwise(mixed)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), place)


def sharpness(image: Column, h: int, w: int) -> Column:
    """Variance of the four-neighbour Laplacian of whole levels; borders mirror without repeating the edge.

    Sums are whole numbers, so the value hangs on no order. Neighbours are found by arithmetic on the place, so the expression is
    no longer for larger images."""

    def beside(i: Column, at: Column, n: int, step: int) -> list[Column]:
        if n == 1:
            return [i, i]
        return [i + F.when(at == 0, F.lit(step)).otherwise(F.lit(-step)), i + F.when(at == n - 1, F.lit(-step)).otherwise(F.lit(step))]

    def edge(x: Column, i: Column) -> Column:
        around = beside(i, F.floor(i / w), h, w) + beside(i, i % w, w, 1)
        return sum((F.get(image, k.cast("int")).cast("long") for k in around), -4 * x.cast("long"))

    edges = F.transform(image, edge)
    total = F.aggregate(edges, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(edges, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return (F.lit(h * w) * squares - total * total) / F.lit(float(h * w) ** 2)


def attended(tokens: DataFrame, key: str, order: str, valid: str, starts: str) -> DataFrame:
    """Adds attends: how many tokens each valid one may look at (0 for the others).

    A token sees the valid tokens whose running count of starts is not above its own. Counted by a window over that
    running count, so no pair of tokens is formed."""
    block = tokens.withColumn("_block", F.sum(F.col(starts).cast("long")).over(Window.partitionBy(key).orderBy(order)))
    seen = F.sum(F.col(valid).cast("long")).over(Window.partitionBy(key).orderBy("_block"))
    return block.withColumn("attends", F.when(F.col(valid), seen).otherwise(F.lit(0).cast("long"))).drop("_block")


def rows_at(frames: DataFrame, wanted: DataFrame, index: str, strict: bool = False) -> DataFrame:
    """Every wanted index with its row, repeats included; found says whether there is one. strict makes a gap an error."""
    got = wanted.join(frames.withColumn("found", F.lit(True)), index, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict and (gap := got.where("not found").select(index).head()):
        raise IndexError(f"no row at {index} {gap[0]}")
    return got


def throttled(rows: DataFrame, key: str, ts: str, order: str, every: str) -> DataFrame:
    """The first row of each key in each period, which is what a loop of fixed rate takes."""
    least = F.min_by(F.struct(*rows.columns), F.struct(ts, order)).alias("r")
    return rows.groupBy(key, F.window(ts, every)).agg(least).select("r.*")
