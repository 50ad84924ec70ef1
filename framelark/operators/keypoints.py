"""Key points of grey images: extrema over place and scale of differences of Gaussians, in NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelark.session import ship_package

#: Scales of an octave, the first one's width, the least contrast of a key point (levels from 0 to 255), and the least side of an octave.
SCALES, SIGMA, CONTRAST, SIDE = 3, 1.6, 5.0, 8


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur by rows and columns, to three widths; borders repeat the edge."""
    r = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "edge")
        image = sum(k * np.take(padded, range(i, i + image.shape[axis]), axis) for i, k in enumerate(w))
    return image


def pyramid(image: np.ndarray) -> list[np.ndarray]:
    """For each octave, the differences of neighbouring scales (SCALES + 2 of them); each octave has half the size of the one before."""
    out, base = [], image.astype(float)
    while min(base.shape) >= SIDE:
        levels = [blurred(base, SIGMA * 2 ** (k / SCALES)) for k in range(SCALES + 3)]
        out.append(np.stack([b - a for a, b in zip(levels, levels[1:])]))
        base = levels[SCALES][::2, ::2]
    return out


def key_points(image: np.ndarray) -> int:
    """How many places of all octaves are above (or below) all 26 neighbours in place and scale, by CONTRAST at least from 0."""
    total = 0
    for d in pyramid(image):
        inner = d[1:-1, 1:-1, 1:-1]
        around = [d[1 + i : d.shape[0] - 1 + i, 1 + j : d.shape[1] - 1 + j, 1 + k : d.shape[2] - 1 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k]
        high, low = np.logical_and.reduce([inner > a for a in around]), np.logical_and.reduce([inner < a for a in around])
        total += int(((high | low) & (np.abs(inner) >= CONTRAST)).sum())
    return total


def with_key_points(images: DataFrame, pixels: str, height: str, width: str) -> DataFrame:
    """Adds key_points (long) of the image in a binary column, a byte a pixel, row by row; null without an image."""
    ship_package(images.sparkSession)
    schema = T.StructType([*images.schema.fields, T.StructField("key_points", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(pixels).to_pylist(), b.column(height).to_pylist(), b.column(width).to_pylist(), strict=True)
            counts = [None if p is None else key_points(np.frombuffer(p, np.uint8).reshape(h, w)) for p, h, w in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=schema.names)

    return images.mapInArrow(run, schema)
