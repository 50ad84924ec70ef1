"""Backends by type, chunks on the grid, playback, splits by metadata, cameras and instructions on hand-made rows."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelark.operators.captures import capture
from framelark.operators.instructions import tokenised
from framelark.operators.policies import BACKENDS, held, joined, playback, predict_chunks, repeats
from framelark.plans.run_queries import stage_sums
from framelark.sinks import images
from framelark.sinks.datasets import bounds_of, index_points, split_episodes, write_dataset, write_frames
from framelark.sinks.images import read_frame_files, write_frame_files

ASKED = "`a.b` long, policy string, chunk int, state array<double>, task string"


def test_backends_by_type(spark):
    rows = [(i, ("hold", "ramp", "mock")[i % 3], 2 + i % 2, [float(i), -1.0], "go" if i else None) for i in range(50)]
    got = predict_chunks(spark.createDataFrame(rows, ASKED), rows=7).collect()
    assert len(got) == 50
    for r in got:
        want = BACKENDS[r.policy]().predict(np.array([r.state]), [r.task], r.chunk)[0]
        assert np.array_equal(np.array(r.actions), want) and want.shape == (r.chunk, 2)
    assert predict_chunks(spark.createDataFrame([], ASKED)).collect() == []


class Flat:
    def predict(self, states, tasks, chunk):
        return states


@pytest.mark.parametrize("row, backends, words", [((1, "new", 2, [1.0], ""), BACKENDS, "no backend"), ((1, "hold", 2, None, ""), BACKENDS, "state"), ((1, "flat", 2, [1.0], ""), {"flat": Flat}, "shape")])
def test_backends_refuse(spark, row, backends, words):
    with pytest.raises(PySparkException, match=words):
        predict_chunks(spark.createDataFrame([row], ASKED), backends).collect()


def test_held(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], 10)], "a array<array<double>>, fps int")
    at = lambda n, source=30: df.select(held(F.col("a"), source, F.col("fps"), F.lit(n)).alias("h"), repeats(source, F.col("fps")).alias("r")).first()
    assert [x[0] for x in at(7).h] == [1, 1, 1, 2, 2, 2, 3] and at(9).r == 3 and len(at(9).h) == 9 and [x[0] for x in at(1).h] == [1]
    with pytest.raises(PySparkException, match="covers 0.30s, need 0.33s"):
        at(10)
    with pytest.raises(PySparkException, match="covers 0.00s"):  # faster than the recording
        at(1, 5)


def test_playback(spark):
    f = spark.range(100).select(F.lit(1).alias("ep"), F.col("id").alias("frame"))
    assert [r.frame for r in playback(f, 30, F.lit(10), 5).orderBy("frame").collect()] == [0, 3, 6, 9, 12]
    assert playback(f, 30, F.lit(7), 1000).count() == 25  # every fourth one, until the episode ends
    for rate in (31, None):
        with pytest.raises(PySparkException, match="does not fit"):
            playback(f, 30, F.lit(rate).cast("int"), 5).collect()


def test_joined(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(joined(F.col("w"))).collect()] == ["a+b", "-", "-"]


def test_split_by_metadata(spark, tmp_path):
    frames = spark.createDataFrame([(ep * 10, i, 1.0) for ep in range(16) for i in range(ep + 1)], "ep long, frame long, state double")
    write_dataset(frames, f"{tmp_path}/d", 10.0)
    b = bounds_of(spark, f"{tmp_path}/d")
    assert sorted((r.episode_index, r.start, r.stop) for r in b.collect()) == [(k, k * (k + 1) // 2, (k + 1) * (k + 2) // 2) for k in range(16)]
    val = lambda e: sorted(r[0] for r in e.where("split = 'val'").collect())
    assert val(split_episodes(b)) == [5, 15] and val(split_episodes(b, [0, 3, 3])) == [0, 3] and val(split_episodes(b, [])) == []
    with pytest.raises(ValueError, match="16"):
        split_episodes(b, [3, 16])
    points = sorted(tuple(r) for r in index_points(b.where("episode_index in (4, 5, 11)"), 5, 3).collect())
    assert points == [(5, 15), (11, 66), (11, 69), (11, 72)]  # five rows are not more than five; a start that just fits is left out


def test_captures(spark):
    tag = lambda streams=(), **tags: json.dumps({"format": {"tags": tags}, "streams": [{"codec_type": "data", "tags": {"handler_name": h}} if h else {"codec_type": "data"} for h in streams]})
    rows = [
        (tag(make="Canon"), "Canon", "OPENCV"), (tag(firmware="HD9.01"), "GoPro", "OPENCV_FISHEYE"), (tag(firmware="hd9"), "unknown", "OPENCV"), (tag([None, "\tGoPro AVC"], make="Apple"), "GoPro", "OPENCV_FISHEYE"),
        (tag(make="", **{"com.apple.quicktime.make": "Apple"}), "Apple/iPhone", "OPENCV"), (tag(model="DJI Air", make="x"), "DJI", "OPENCV_FISHEYE"), (tag(["Insta360 eye", "dji"]), "Insta360", "OPENCV_FISHEYE"),
        ("{}", "unknown", "OPENCV"), (None, "unknown", "OPENCV"), ("not json", "unknown", "OPENCV"),
    ]
    got = spark.createDataFrame(rows, "d string, who string, lens string").select("who", "lens", capture(F.col("d")).alias("c")).collect()
    assert [(r.c.detected, r.c.camera_model) for r in got] == [(r.who, r.lens) for r in got]
    assert all((r.c.mapper == "global") == (r.c.camera_model == "OPENCV_FISHEYE") for r in got)


def test_stages(spark):
    t = spark.createDataFrame([("v", "v.b.0.w", [2, 3]), ("v", "v.b.0.x", [4]), ("v", "v.b.10.w", [5]), ("v", "v.norm", [7]), ("z", "z.w", [])], "component string, key string, shape array<long>")
    got = sorted((r.level, r.component, r.stage, r.tensors, r.params) for r in stage_sums(t, {"v.b.": "stage "}).collect())
    assert got == [(0, "total", "", 5, 23), (1, "v", "", 4, 22), (1, "z", "", 1, 1), (2, "v", "stage 0", 2, 10), (2, "v", "stage 10", 1, 5)]


def test_tokenised(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["dig left", "dig left\n", "", None, "word " * 5000, "日本 🦊 é"]
    got = tokenised(spark.createDataFrame(list(enumerate(texts)), "`i.d` long, text string"), "text", path, 6, pad=9).orderBy("`i.d`").collect()
    plain = Tokenizer.from_file(path)
    for text, r in zip(texts, got, strict=True):
        line = (text or "") if (text or "").endswith("\n") else (text or "") + "\n"
        ids = plain.encode(line, add_special_tokens=False).ids[:6]
        assert r.tokens == ids + [9] * (6 - len(ids)) and r.mask == [True] * len(ids) + [False] * (6 - len(ids))
    assert got[0].tokens == got[1].tokens and got[2].tokens == got[3].tokens


def test_frame_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", i, f"a{i}".encode()) for i in range(9, -1, -1)] + [("b", 5, b"x"), ("b", 7, None), (None, 1, b"y")]
    df = spark.createDataFrame(rows, "`cam` string, at long, data binary").repartition(4)
    found = lambda: sorted((r.group, r.name, bytes(r.content)) for r in read_frame_files(spark, path).collect())
    write_frame_files(df, path, "cam", "at", "data")
    assert found() == sorted([("a", f"frame_{i + 1:04d}.jpg", f"a{i}".encode()) for i in range(10)] + [("b", "frame_0001.jpg", b"x")])
    before = found()
    broken = df.withColumn("data", F.when(F.col("at") == 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(PySparkException, match="lost"):
        write_frame_files(broken, path, "cam", "at", "data")
    assert found() == before  # a call that fails changes nothing
    write_frame_files(df.where("cam = 'b'"), path, "cam", "at", "data", suffix=".png")
    assert found() == [("b", "frame_0001.png", b"x")] and len(list((tmp_path / "out").glob("take-*"))) == 1
    write_frame_files(df.limit(0), path, "cam", "at", "data")
    assert found() == []


def test_frame_files_by_tasks(spark, tmp_path):
    path = f"{tmp_path}/out"
    groups = ["_x", ".y", "a/b", "", "100% é"]
    want = [(g, f"frame_{i + 1:04d}.gz", f"{g}:{i}".encode()) for g in groups for i in range(2500 if g == "_x" else 3)]
    df = spark.createDataFrame([(g, i, f"{g}:{i}".encode()) for g in groups for i in range(2500 if g == "_x" else 3)], "cam string, at long, data binary")
    for suffix in (".jpg", ".gz"):
        write_frame_files(df, path, "cam", "at", "data", suffix=suffix)
    r = read_frame_files(spark, path)
    assert r.inputFiles() == []  # the driver holds no list of the files
    assert sorted(map(tuple, r.collect())) == sorted(want)
    (take,) = (tmp_path / "out").glob("take-*")
    assert sum(x.is_file() for x in take.rglob("*")) == len(want)


def test_frame_file_passes_in_its_own_folder(tmp_path, monkeypatch):
    class Store(LocalFileSystem):
        def open_output_stream(self, path, *args, **kwargs):
            opened.append(path.rpartition("/")[0])
            return super().open_output_stream(path, *args, **kwargs)

    opened = []
    monkeypatch.setattr(images, "opened", lambda path: (Store(), path))
    images.FrameFiles(str(tmp_path), "take-1").write(iter([pa.record_batch([pa.array(["a/frame_0001.jpg", "b/frame_0001.jpg"]), pa.array([b"x", b"y"])], ["name", "data"])]))
    assert opened == [f"{tmp_path}/take-1/a", f"{tmp_path}/take-1/b"]  # not one folder for all
    assert {str(x.relative_to(tmp_path)): x.read_bytes() for x in tmp_path.rglob("*") if x.is_file()} == {"take-1/a/frame_0001.jpg": b"x", "take-1/b/frame_0001.jpg": b"y"}


def test_frames_in_order(spark, tmp_path):
    f = spark.range(500).select((F.col("id") % 7).alias("ep"), (F.col("id") * 37 % 500).alias("frame")).repartition(5)
    want = sorted(map(tuple, f.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows make several files
    try:
        write_frames(f, f"{tmp_path}/all", order=["ep", "frame"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "all").glob("*.parquet"))
    assert len(files) > 1 and [tuple(r) for x in files for r in spark.read.parquet(str(x)).collect()] == want
    write_frames(f, f"{tmp_path}/keyed", "ep", order=["frame"])
    for x in (tmp_path / "keyed").rglob("*.parquet"):
        frames = [r.frame for r in spark.read.parquet(str(x)).select("frame").collect()]
        assert frames == sorted(frames)
    assert sorted((r.ep, r.frame) for r in spark.read.parquet(f"{tmp_path}/keyed").collect()) == want
