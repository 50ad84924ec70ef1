"""Messages, growing datasets and key points against hand-made values and plain loops."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from framelark.operators import keypoints
from framelark.plans import file_queries
from framelark.sinks import incremental
from framelark.sources import wire
from framelark.streaming import live

KINDS = ["?", "i1", "u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<u8", "<f2", "<f4", "<f8", ">f4", ">i8"]


def same(a, b):
    if isinstance(a, np.ndarray):
        return isinstance(b, np.ndarray) and a.dtype == b.dtype and a.shape == b.shape and a.tobytes() == b.tobytes()
    if isinstance(a, dict):
        return list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def test_values_of_every_size():
    for v in (None, True, False, 0, 127, 128, -1, -32, -33, 2**63 - 1, -(2**63), 2**64 - 1, 1.5, float("inf"), "", "é" * 20, "x" * 255, "y" * 300, "z" * 70_000, b"", b"b" * 300, b"c" * 70_000, [], [1, [2, "3"]], list(range(20)), [0] * 70_000, {}, {"a": {"b": [1.0]}}, {str(i): i for i in range(40)}):
        assert same(v, wire.unpack(wire.pack(v)))
    assert wire.pack({"a": 1}) == b"\x81\xa1a\x01" and wire.pack([-1, 200]) == b"\x92\xff\xd3" + bytes(7) + b"\xc8"
    assert wire.unpack(b"\x94\xcc\xc8\xcd\x01\x00\xd0\xff\xca\x3f\x80\x00\x00") == [200, 256, -1, 1.0]


def test_arrays_of_every_kind():
    rng = np.random.default_rng(1)
    for kind in KINDS:
        for shape in ((), (0,), (3,), (2, 0, 4), (2, 3, 4)):
            a = rng.integers(0, 2, shape).astype(kind) if kind == "?" else (rng.normal(0, 50, shape)).astype(kind)
            assert same({"observation/image": a, "more": [a]}, wire.unpack(wire.pack({"observation/image": a, "more": [a]})))
    turned = np.arange(6).reshape(2, 3).T
    assert (wire.unpack(wire.pack(turned)) == turned).all()


def test_what_is_not_read():
    jpeg = wire.pack({"image": {"__jpeg__": True, "data": b"", "shape": [1]}})
    half = wire.pack({"image": {"__ndarray__": True, "data": b"", "dtype": "<f4"}})
    for raw, why in ((jpeg, "__jpeg__"), (half, "__ndarray__"), (b"\x81\xa1", "cut off"), (wire.pack("abc")[:-1], "cut off"), (b"\x00\x00", "follow"), (b"\xc1", "unknown kind"), (b"", "cut off")):
        with pytest.raises(ValueError, match=why):
            wire.unpack(raw)
    for v in (np.array(["text"]), {1, 2}, np.array([None])):
        with pytest.raises(ValueError, match="not sent"):
            wire.pack(v)
    assert wire.unpack(wire.pack({"__cmd__": "reset"})) == {"__cmd__": "reset"}


def test_long_batches_are_cut(spark):
    sent = wire.encoded(spark.range(700).coalesce(1).selectExpr("id", f"cast(array() as {wire._ENTRY}) as arrays", "map('at', string(id)) as words"), "arrays", "words")
    got = wire.decoded(sent.select("id", "message"), "message")

    assert [b.num_rows for b in wire.sliced(iter([pa.record_batch({"a": list(range(700))})]))] == [256, 256, 188]
    assert [(r.id, r.texts["at"]) for r in got.orderBy("id").collect()] == [(i, str(i)) for i in range(700)]


def test_messages_in_batches(spark):
    a, b = np.arange(4, dtype="<f4"), np.zeros((2, 2), "u1")
    entry = lambda k, x: (k, x.dtype.str, list(x.shape), x.tobytes())
    df = spark.createDataFrame([(1, [entry("s", a), entry("i", b)], {"prompt": "go"}), (2, [], None), (3, None, {})], f"id long, arrays {wire._ENTRY}, words map<string, string>")
    sent = wire.encoded(df, "arrays", "words").select("id", "message")
    got = {r.id: ([tuple(e) for e in r.entries], r.texts) for r in wire.decoded(sent, "message").collect()}
    assert got == {1: ([(k, d, s, bytearray(x)) for k, d, s, x in (entry("s", a), entry("i", b))], {"prompt": "go"}), 2: ([], {}), 3: ([], {})}
    bad = spark.createDataFrame([(1, bytearray(wire.pack({"n": 5})))], "id long, message binary")
    with pytest.raises(PySparkException, match="neither arrays nor texts"):
        wire.decoded(bad, "message").collect()


def test_dataset_grows_by_batches(spark, tmp_path):
    path, frames = f"{tmp_path}/d", lambda *rows: spark.createDataFrame(rows, "ep long, frame long, x double")
    incremental.create(spark, path, 2.0)
    with pytest.raises(PySparkException):
        incremental.create(spark, path, 2.0)
    with pytest.raises(ValueError, match="no batch"):
        incremental.saved_frames(spark, path)
    incremental.add_frames(frames((7, 0, 1.0), (7, 1, 2.0), (8, 0, 3.0)), path, 0)
    incremental.save_episodes(frames().select("ep"), path, 0)
    with pytest.raises(ValueError, match="no episode"):
        incremental.finalize(spark, path, f"{tmp_path}/none")
    for _ in range(3):  # a batch that is tried again changes nothing
        incremental.add_frames(frames((7, 2, 4.0), (9, 0, 5.0)), path, 1)
        incremental.save_episodes(frames((7, 2, 4.0)), path, 1)
    seen = lambda: sorted((r.ep, r.frame, r.x) for r in incremental.saved_frames(spark, path).collect())
    assert seen() == [(7, 0, 1.0), (7, 1, 2.0), (7, 2, 4.0)]  # 8 and 9 are not finished
    incremental.add_frames(frames((8, 1, 6.0)), path, 2)
    incremental.save_episodes(frames((8, 0, 0.0)), path, 2)
    incremental.finalize(spark, path, f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/data").orderBy("index").collect()
    assert [(r.episode_index, r.frame_index, r.timestamp, r.x) for r in rows] == [(0, 0, 0.0, 1.0), (0, 1, 0.5, 2.0), (0, 2, 1.0, 4.0), (1, 0, 0.0, 3.0), (1, 1, 0.5, 6.0)]
    incremental.add_frames(frames((7, 3, 7.0)), path, 3)
    with pytest.raises(PySparkException, match="after it was saved"):
        incremental.saved_frames(spark, path).collect()


def test_dataset_from_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([(1, 0, False), (2, 0, False)], [(1, 1, True), (2, 1, False)], [(3, 0, True)])):
        spark.createDataFrame(rows, "ep long, frame long, last boolean").toPandas().to_parquet(tmp_path / "in" / f"{n}.parquet", index=False)
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    incremental.create(spark, f"{tmp_path}/d", 5.0)
    incremental.stream_episodes(live.stream_table(spark, f"{tmp_path}/in", 1), f"{tmp_path}/d", f"{tmp_path}/c", "last").awaitTermination()
    assert sorted((r.ep, r.frame) for r in incremental.saved_frames(spark, f"{tmp_path}/d").collect()) == [(1, 0), (1, 1), (3, 0)]


def plain_key_points(image):
    total = 0
    for d in keypoints.pyramid(image):
        for s in range(1, d.shape[0] - 1):
            for r in range(1, d.shape[1] - 1):
                for c in range(1, d.shape[2] - 1):
                    v = d[s, r, c]
                    around = [d[s + i, r + j, c + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
                    total += abs(v) >= keypoints.CONTRAST and (all(v > a for a in around) or all(v < a for a in around))
    return total


def blobs(places, size=64, width=2.5):
    y, x = np.mgrid[:size, :size]
    return np.clip(20 + sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * width**2)) for a, b in places), 0, 255).astype(np.uint8)


def test_key_points(spark):
    few, many = blobs([(20, 20)]), blobs([(12, 12), (12, 50), (50, 12), (50, 50), (32, 32)])
    flat, noise, tiny = np.full((40, 30), 90, np.uint8), np.random.default_rng(3).integers(0, 256, (24, 40), dtype=np.uint8), np.zeros((3, 3), np.uint8)
    images = [few, many, flat, noise, tiny]
    assert keypoints.key_points(flat) == keypoints.key_points(tiny) == 0 and keypoints.key_points(few) >= 1
    assert keypoints.key_points(many) >= 5 > keypoints.key_points(few)
    rows = [(i, bytearray(m.tobytes()), *m.shape) for i, m in enumerate(images)] + [(9, None, 1, 1)]
    got = {r.id: r.key_points for r in keypoints.with_key_points(spark.createDataFrame(rows, "id long, p binary, h int, w int"), "p", "h", "w").collect()}
    assert got == {i: plain_key_points(m) for i, m in enumerate(images)} | {9: None}


def test_sharpest_by_key_points(spark):
    from pyspark.sql import functions as F

    got = sorted(map(tuple, file_queries.q_key_points(spark, "/root/testdata/sf0.001").collect()))
    by = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000 % 256)).alias("p")).collect():
        image = np.array(r.p, np.uint8).reshape(8, 8)
        pad = np.pad(image.astype(int), 1, "reflect")
        laplacian = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * image.astype(int)
        by.setdefault(r.label, []).append((r.vec_id, keypoints.key_points(image), float(laplacian.var())))
    want = []
    for label, rows in by.items():
        rows.sort()
        for b in range(5):
            some = [x for k, x in enumerate(rows) if ((k + 1) * 5 - 1) // len(rows) == b]
            if some:
                v, k, s = max(some, key=lambda x: (x[2] >= 8000, x[1], x[2], -x[0]))
                want.append((label, b, v, k, round(s, 6), s < 8000))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(want)] and np.allclose([x[4] for x in got], [x[4] for x in sorted(want)])
