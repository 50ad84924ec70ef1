"""Media operators against NumPy, and on what the queries' tables don't hold: nulls, gaps, repeats, other shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import media


def _one(spark, *columns, **values):
    df = spark.range(1).select(*[F.array(*[F.lit(int(x)) for x in v]).alias(k) if isinstance(v, (list, np.ndarray)) else F.lit(v).alias(k) for k, v in values.items()])
    return df.select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("h,w", [(2, 2), (3, 5), (8, 8), (1, 4)])
def test_sharpness_and_resize(spark, h, w):
    image = np.random.default_rng(h * 10 + w).integers(0, 256, (h, w))
    padded = np.pad(image, 1, mode="reflect") if min(h, w) > 1 else np.pad(np.pad(image, ((0, 0), (1, 1)), mode="reflect"), ((1, 1), (0, 0)), mode="edge")
    edges = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * image
    size = 3
    small = image[(np.arange(size) * (h / size)).astype(int)][:, (np.arange(size) * (w / size)).astype(int)]
    got = _one(spark, media.sharpness(F.col("x"), h, w), media.resized(F.col("x"), h, w, size), media.normalised(F.col("x"), 0), x=image.ravel())
    assert got["0"] == pytest.approx(edges.var()) and got["1"] == small.ravel().tolist()
    assert np.allclose(got["2"], (image.ravel() / 255 - media.IMAGE_MEAN[0]) / media.IMAGE_STD[0])


def test_null_image(spark):
    got = spark.sql("select cast(null as array<bigint>) as x").select(media.sharpness(F.col("x"), 2, 2).alias("s"), media.normalised(F.col("x"), 2).alias("n")).first()
    assert got.s is None and got.n is None


@pytest.mark.parametrize("largest", range(4))
def test_quaternion_round_trip(spark, largest):
    q = np.array([0.1, -0.2, 0.3, 0.15])
    q[largest] = 0.0
    q[largest] = math.sqrt(1 - (q * q).sum())
    word = largest
    for at, x in zip((2, 12, 22), np.delete(q, largest)):
        word |= round((x + math.sqrt(0.5)) / math.sqrt(2) * 1023) << at
    assert np.allclose(_one(spark, media.smallest_three(F.col("x").cast("long")), x=word)["0"], q, atol=2e-3)


@pytest.mark.parametrize("dim", [1, 6, 7])
def test_time_embeddings(spark, dim):
    half = dim // 2
    a = 0.3 * 2 * np.pi / (0.004 * 1000.0 ** np.linspace(0, 1, half))
    c = 0.3 * np.exp(-math.log(100) * np.arange(half) / max(half, 1))
    got = _one(spark, media.sinusoidal(F.col("t"), dim, 0.004, 4.0), media.timestep(F.col("t"), dim, 100.0), t=0.3)
    assert np.allclose(got["0"], [*np.sin(a), *np.cos(a)]) and np.allclose(got["1"], [*np.cos(c), *np.sin(c), *[0.0] * (dim % 2)])


def test_geometry(spark):
    got = _one(spark, media.fitted(F.lit(480), F.lit(640), 224, 224), media.centre_square(F.lit(480), F.lit(641)))
    assert tuple(got["0"]) == (168, 224, 56, 0) and tuple(got["1"]) == (0, 80, 480)


def test_mask_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, bool(rng.integers(2)), bool(rng.integers(2))) for k in range(4) for i in range(9)]
    got = media.attended(spark.createDataFrame(rows, "k long, i long, valid boolean, starts boolean"), "k", "i", "valid", "starts").collect()
    for k in range(4):
        mine = [r for r in rows if r[0] == k]
        block, valid = np.cumsum([r[3] for r in mine]), np.array([r[2] for r in mine])
        want = ((block[None, :] <= block[:, None]) & valid[None, :] & valid[:, None]).sum(axis=1)
        assert [r.attends for r in sorted(got, key=lambda r: r.i) if r.k == k] == want.tolist()


def test_rows_at(spark):
    frames = spark.createDataFrame([(0, "a"), (1, "b")], "at long, x string")
    wanted = spark.createDataFrame([(1,), (1,), (7,)], "at long")
    assert sorted((r.at, r.x, r.found) for r in media.rows_at(frames, wanted, "at").fillna("").collect()) == [(1, "b", True), (1, "b", True), (7, "", False)]
    with pytest.raises(IndexError, match="at 7"):
        media.rows_at(frames, wanted, "at", strict=True)


def test_fixed_rate(spark):
    rows = spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as ts, s as n from (select explode(array(0, 4, 10, 10, 35)) as s)")
    assert sorted(r.n for r in media.throttled(rows, "k", "ts", "n", "10 seconds").collect()) == [0, 10, 35]


@pytest.mark.parametrize(("h", "w", "height", "width"), [(4, 16, 10, 12), (7, 5, 14, 10), (5, 7, 3, 3), (6, 6, 6, 6), (1, 8, 4, 4), (48, 64, 20, 20)])
def test_letterbox(spark, h, w, height, width):
    """Against the same sampling written with arrays."""
    image = np.random.default_rng(h * w).integers(0, 256, (h, w)).astype(float)
    (got,) = spark.createDataFrame([(image.ravel().tolist(),)], "p array<double>").select(media.letterboxed(F.col("p"), h, w, height, width, -1.0).alias("x")).first()
    ratio = max(w / width, h / height)
    rows, cols = int(h / ratio), int(w / ratio)
    want = np.full((height, width), -1.0)
    if not rows:
        assert got == want.ravel().tolist()
        return
    y, x = (np.clip((np.arange(k) + 0.5) * n / k - 0.5, 0, n - 1) for n, k in ((h, rows), (w, cols)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], x - x0
    want[height - rows :, width - cols :] = (image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx) * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy
    assert np.allclose(np.array(got).reshape(height, width), want)


def test_large_images_take_no_longer_expressions(spark):
    h, w = 480, 640
    image = np.random.default_rng(1).integers(0, 256, (h, w))
    column = media.sharpness(F.col("p"), h, w)
    assert len(str(column)) < 5000
    (got,) = spark.createDataFrame([(image.ravel().tolist(),)], "p array<int>").select(column).first()
    pad = np.pad(image, 1, "reflect")
    assert np.isclose(got, (pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * image).var())
