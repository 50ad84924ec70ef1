"""Byte-range sources and writers by tasks, against NumPy on hand-made files."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelark.operators.points import decode_points, dense_ids
from framelark.sinks import parts
from framelark.sources import files, ranged

BOUNDS = ["x", "y", "z", "scale_x", "scale_y", "scale_z", "r", "g", "b"]


def compressed(path, n, rest, seed=1):
    """A chunk-compressed file of n vertices and its decoded values."""
    rng = np.random.default_rng(seed)
    chunks = -(-n // 256)
    lo = rng.normal(0, 3, (chunks, 9)).astype("f4")
    hi = lo + rng.uniform(0, 2, (chunks, 9)).astype("f4")
    packed = rng.integers(0, 2**32, (n, 4), dtype=np.uint32)
    sh = rng.integers(0, 256, (n, rest), dtype=np.uint8)
    order = [f"min_{b}" for b in BOUNDS[:3]] + [f"max_{b}" for b in BOUNDS[:3]] + [f"min_{b}" for b in BOUNDS[3:6]] + [f"max_{b}" for b in BOUNDS[3:6]] + [f"min_{b}" for b in BOUNDS[6:]] + [f"max_{b}" for b in BOUNDS[6:]]
    at = {f"min_{b}": lo[:, i] for i, b in enumerate(BOUNDS)} | {f"max_{b}": hi[:, i] for i, b in enumerate(BOUNDS)}
    head = ["ply", "format binary_little_endian 1.0", f"element chunk {chunks}", *[f"property float {c}" for c in order], f"element vertex {n}", *[f"property uint packed_{w}" for w in ("position", "rotation", "scale", "color")]]
    shuffled = sorted(range(rest), key=str)  # 0, 1, 10, 11, 2 ...: the reader orders them by number
    head += [f"element sh {n}", *[f"property uchar f_rest_{i}" for i in shuffled], "end_header\n"]
    path.write_bytes("\n".join(head).encode() + np.column_stack([at[c] for c in order]).astype("<f4").tobytes() + packed.astype("<u4").tobytes() + sh[:, shuffled].tobytes())
    of = np.arange(n) // 256
    mix = lambda i, share: lo[of, i] + share * (hi[of, i] - lo[of, i])
    word = packed.astype(np.int64)
    bits = lambda w, s, k: (word[:, w] >> s & (1 << k) - 1) / ((1 << k) - 1)
    three = np.column_stack([bits(1, 2 + 10 * i, 10) * np.sqrt(2) - np.sqrt(0.5) for i in range(3)])
    left = np.sqrt(np.maximum(0, 1 - (three**2).sum(1)))
    turn = np.array([np.insert(t, b, w) for t, b, w in zip(three, word[:, 1] & 3, left)])
    o = np.clip(bits(3, 24, 8), 1e-6, 1 - 1e-6)
    spec = (sh / 255 * 4 - 2).reshape(n, 3, rest // 3).transpose(0, 2, 1).reshape(n, rest)
    return {"x": mix(0, bits(0, 0, 10)), "y": mix(1, bits(0, 10, 10)), "z": mix(2, bits(0, 20, 10)), "scale": np.column_stack([mix(3 + i, bits(2, 8 * i, 8)) for i in range(3)]),
            "albedo": np.column_stack([mix(6 + i, bits(3, 8 * i, 8)) for i in range(3)]), "rotation": turn, "density": np.log(o / (1 - o)), "specular": spec}


@pytest.mark.parametrize(("n", "rest", "degree"), [(1000, 24, 2), (256, 45, 3), (1, 0, 0)])
def test_decoded_points(spark, tmp_path, n, rest, degree):
    want = compressed(tmp_path / "p.ply", n, rest)
    v = ranged.read_points(spark, f"{tmp_path}/p.ply", "vertex", *(["sh"] if rest else []), rows=300)
    assert v.rdd.getNumPartitions() == -(-n // 300) and [c for c in v.columns if "rest" in c] == [f"f_rest_{i}" for i in range(rest)]
    rows = decode_points(v, ranged.read_points(spark, f"file://{tmp_path}/p.ply".replace("file://", ""), "chunk")).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(n)) and {r.degree for r in rows} == {degree}
    for name, values in want.items():
        assert np.allclose(np.array([r[name] for r in rows]).reshape(values.shape), values, atol=2e-5), name


def test_points_that_do_not_fit(spark, tmp_path):
    compressed(tmp_path / "p.ply", 600, 3)
    chunks = ranged.read_points(spark, f"{tmp_path}/p.ply", "chunk")
    with pytest.raises(PySparkException, match="no chunk"):
        decode_points(ranged.read_points(spark, f"{tmp_path}/p.ply"), chunks.where("id < 2")).collect()
    for elements, why in ((("face",), "no element"), (("vertex", "chunk"), "different numbers")):
        with pytest.raises(PySparkException, match=why):
            ranged.read_points(spark, f"{tmp_path}/p.ply", *elements).collect()
    whole = (tmp_path / "p.ply").read_bytes()
    (tmp_path / "q.ply").write_bytes(whole[:-1])
    (tmp_path / "r.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    (tmp_path / "s.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement face 0\nproperty list uchar int v\nend_header\n")
    for name, why in (("q", "announced"), ("r", "not a binary"), ("s", "not read")):
        with pytest.raises(PySparkException, match=why):
            ranged.read_points(spark, f"{tmp_path}/{name}.ply").collect()


def test_plain_points_over_files(spark, tmp_path):
    for k, n in enumerate((5, 0, 3)):
        v = np.array([(i + k / 10, -i, i) for i in range(n)], [("x", "<f8"), ("k_10", "<i4"), ("k_9", "<u2")])
        (tmp_path / f"{k}.ply").write_bytes(f"ply\nformat binary_little_endian 1.0\ncomment c\nelement vertex {n}\nproperty double x\nproperty int k_10\nproperty ushort k_9\nend_header\n".encode() + v.tobytes())
    (tmp_path / "_files.json").write_text("[]")
    df = ranged.read_points(spark, f"{tmp_path}/*.ply", rows=2)
    assert df.columns == ["file", "id", "x", "k_9", "k_10"] and df.rdd.getNumPartitions() == 5
    assert sorted((r.file[-5], r.id, r.x, r.k_10, r.k_9) for r in df.collect()) == [(str(k), i, i + k / 10, -i, i) for k, n in ((0, 5), (2, 3)) for i in range(n)]
    assert ranged.read_points(spark, str(tmp_path)).count() == 8


def test_points_written(spark, tmp_path):
    rows = spark.range(1500).select("id", *[F.lit(0.0).cast("float").alias(f"{m}_{b}") for m in ("min", "max") for b in BOUNDS], *[F.col("id").alias(f"packed_{w}") for w in ("position", "rotation", "scale", "color")], (F.col("id") % 256).cast("short").alias("f_rest_0"))
    parts.write_points(rows, f"{tmp_path}/p", 512)
    names = json.loads((tmp_path / "p" / "_files.json").read_text())
    assert [n[:11] for n in names] == ["part-000000", "part-000001", "part-000002"] and {n for n in os.listdir(tmp_path / "p") if n.startswith("part")} == set(names)
    got = ranged.read_points(spark, f"{tmp_path}/p", "vertex", "sh").withColumn("g", F.regexp_extract("file", r"part-(\d+)", 1).cast("long") * 512 + F.col("id"))
    assert got.where("g = packed_color and f_rest_0 = g % 256").count() == got.count() == 1500
    assert ranged.read_points(spark, f"{tmp_path}/p", "chunk").count() == 6
    with pytest.raises(FileExistsError):
        parts.write_points(rows, f"{tmp_path}/p", 512)
    parts.write_points(rows.limit(0), f"{tmp_path}/p", 512, force=True)
    assert [n for n in os.listdir(tmp_path / "p") if n.startswith("part")] == []
    with pytest.raises(ValueError, match="multiple"):
        parts.write_points(rows, f"{tmp_path}/q", 100)


def test_headers_of_large_files(spark, tmp_path):
    head = json.dumps({"__metadata__": {"a": "b"}, "w": {"dtype": "F16", "shape": [3, 4], "data_offsets": [0, 24]}, "s": {"dtype": "F32", "shape": [], "data_offsets": [24, 28]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head)
    os.truncate(tmp_path / "m.safetensors", 3_000_000_000)  # a file with holes: beyond what one value can hold
    rows = {r.key: (r.dtype, r.shape, r.n_params, r.first_byte, r.last_byte) for r in ranged.read_tensor_headers(spark, f"{tmp_path}/m.safetensors").collect()}
    assert rows == {"w": ("F16", [3, 4], 12, 0, 24), "s": ("F32", [], 1, 24, 28)}
    (tmp_path / "cut.safetensors").write_bytes(struct.pack("<Q", len(head)) + head[:-1])
    with pytest.raises(PySparkException, match="cut off"):
        ranged.read_tensor_headers(spark, f"{tmp_path}/cut.safetensors").collect()


@pytest.mark.parametrize("frames", [1, 3, 100])
def test_grey_frames(spark, tmp_path, frames):
    video = np.random.default_rng(2).integers(0, 256, (11, 7, 10), dtype=np.uint8)
    (tmp_path / "v.raw").write_bytes(video.tobytes() + b"rest")
    df = ranged.read_grey_frames(spark, f"{tmp_path}/v.raw", 10, 7, step=3, scale=3, frames=frames)
    assert df.rdd.getNumPartitions() == -(-4 // frames)
    for r in df.collect():
        want = video[r.frame, :6, :9].reshape(2, 3, 3, 3).mean((1, 3))
        assert (r.height, r.width) == (2, 3) and (np.frombuffer(bytes(r.pixels), np.uint8).reshape(2, 3) == np.floor(want + 0.5)).all()
    assert sorted(r.frame for r in df.collect()) == [0, 3, 6, 9]
    with pytest.raises(PySparkException, match="scale"):
        ranged.read_grey_frames(spark, f"{tmp_path}/v.raw", 10, 7, scale=8).collect()


def test_archives(spark, tmp_path):
    rows = [(1, "a", 0, "<f4", [2, 3], [1.0, 2.0]), (1, "a", 1, "<f4", [2, 3], [3.0, 4.0, 5.0, 6.0]), (1, "n", 0, "<i8", [], [7.0]), (2, "empty", 0, "<f8", [0, 4], [])]
    df = spark.createDataFrame(rows, "archive long, name string, piece long, dtype string, shape array<long>, values array<double>")
    parts.write_arrays(df, f"{tmp_path}/z")
    one, two = (np.load(f"{tmp_path}/z/{n}") for n in json.loads((tmp_path / "z" / "_files.json").read_text()))
    assert (one["a"] == np.arange(1, 7).reshape(2, 3)).all() and one["a"].dtype == "f4" and one["n"] == 7 and two["empty"].shape == (0, 4)
    assert {r.name: r["values"] for r in files.read_arrays(spark, f"{tmp_path}/z/*.npz").collect()} == {"a": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "n": [7.0], "empty": []}
    with pytest.raises(PySparkException, match="too few"):
        parts.write_arrays(df.where("piece = 0"), f"{tmp_path}/y")
    assert not (tmp_path / "y" / "_files.json").exists()


def test_short_files_share_tasks(spark, tmp_path):
    for i in range(500):
        head = json.dumps({f"k{i}": {"dtype": "U8", "shape": [i], "data_offsets": [0, i]}}).encode()
        (tmp_path / f"{i:03d}.bin").write_bytes(len(head).to_bytes(8, "little") + head)
    found = ranged.read_tensor_headers(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= ranged.TASKS
    assert sorted((r.key, r.n_params) for r in found.collect()) == sorted((f"k{i}", i) for i in range(500))


def test_short_ranges_share_tasks(spark, tmp_path):
    points = spark.range(0, 256 * 300, 1, 2).selectExpr("id", "cast(id as float) as x")
    parts.write_points(points, f"{tmp_path}/p", 256 * 100)
    found = ranged.read_points(spark, f"{tmp_path}/p", rows=256)
    assert found.rdd.getNumPartitions() <= ranged.TASKS
    assert sorted(r.x for r in found.select("x").collect()) == list(range(256 * 300))


def test_many_archives(spark, tmp_path):
    parts.write_arrays(spark.range(40).selectExpr("id as archive", "'a' as name", "0L as piece", "'<f8' as dtype", "array(2L) as shape", "array(double(id), cast(null as double)) as values"), f"{tmp_path}/z")
    (tmp_path / "z" / "other.txt").write_text("no archive")
    spark.sparkContext.setJobGroup("listing", "archives are listed")
    found = files.read_arrays(spark, f"{tmp_path}/z", "*.npz")
    spark.sparkContext.setJobGroup("reading", "archives are read")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")  # a pattern would be a task for each file
    assert sorted((r["values"][0], str(r["values"][1])) for r in found.collect()) == [(float(i), "nan") for i in range(40)]


def test_dense_ids(spark):
    rows = [(k * 7 % 1000, k) for k in range(900)]
    got = dense_ids(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], block=50).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows) and [r.id for r in got] == list(range(900))
