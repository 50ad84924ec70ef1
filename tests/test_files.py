"""Readers and writers on hand-made files."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framelark.sinks.datasets import camera_view, numbered_names, wire_encoding, write_dataset, write_frames, write_results, write_view
from framelark.sources import files


def test_tagged_and_json(spark, tmp_path):
    (tmp_path / "a.log").write_text('noise\r\nPROBE {"gb": 1.5}\rPROBE {"gb": 2.5}\nPROBELESS {"gb": 9}\n')
    (tmp_path / "b.log").write_text("nothing\n")
    (row,) = files.read_tagged(spark, f"{tmp_path}/*.log", "PROBE", "gb double").collect()
    assert row.file.endswith("a.log") and row.record.gb == 2.5
    (tmp_path / "info.json").write_text('{\n "fps": 30,\n "splits": {"train": "0:3"}\n}')
    assert files.read_json_file(spark, f"{tmp_path}/info.json", "fps int, splits map<string,string>").first().splits == {"train": "0:3"}


def test_memory_info(spark, tmp_path):
    (tmp_path / "m").write_text("MemTotal:       8000000 kB\nName:\tpython\n\nVmRSS:\t  250000 kB\n")
    assert {r.name: r.gb for r in files.read_memory_info(spark, f"{tmp_path}/m").collect()} == {"MemTotal": 8.0, "VmRSS": 0.25}


def test_catalog(spark, tmp_path):
    for k in (5, 40, 300):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "model").write_bytes(bytes(k))
    (tmp_path / "last").write_bytes(b"")
    found = files.list_files(spark, str(tmp_path), r"/(\d+)/model$")
    assert sorted((r.step or 0, r.length) for r in found.collect()) == [(5, 5), (40, 40), (300, 300)]  # the empty file is left out
    assert files.newest_file(found.withColumn("k", F.lit(1)), "k").count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5), (1, 1, None), (2, 0, 0.5)], "ep long, frame long, x double")
    assert write_frames(df, f"{tmp_path}/f", dry_run=True).count() == 3 and not (tmp_path / "f").exists()
    write_frames(df, f"{tmp_path}/f", key="ep")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/f").select("ep", "frame", "x").collect())) == sorted(map(str, df.selectExpr("int(ep) as ep", "frame", "x").collect()))
    with pytest.raises(AnalysisException):
        write_frames(df, f"{tmp_path}/f", key="ep")
    write_frames(df.limit(1), f"{tmp_path}/f", force=True)
    assert spark.read.parquet(f"{tmp_path}/f").count() == 1
    write_results(df, f"{tmp_path}/r")
    assert spark.read.schema("ep long, x double").json(f"{tmp_path}/r").where("x is null").count() == 1
    assert {r.file_name for r in numbered_names(df, "ep", "frame").collect()} == {"frame_0001.jpg", "frame_0002.jpg"}


def test_camera_view(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "`episode_index` long, `videos/observation.images.cam1/from_timestamp` double, `videos/observation.images.cam2/from_timestamp` double")
    assert camera_view(df, ["cam2"]).columns == ["episode_index", "videos/observation.images.cam2/from_timestamp"]
    for bad in (["cam3"], ["cam1", "observation.images.cam2"]):
        with pytest.raises(ValueError):
            camera_view(df, bad)


def test_wire(spark):
    rows = [("observation/image", 3, "uint8", "jpeg"), ("observation/image", 3, "float32", "raw"), ("observation/state", 3, "uint8", "raw"), ("observation/wrist_image", 2, "uint8", "raw")]
    df = spark.createDataFrame(rows, "key string, ndim int, dtype string, want string")
    assert df.where(wire_encoding(F.col("key"), F.col("ndim"), F.col("dtype")) == F.col("want")).count() == 4


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(6, dtype="f4").reshape(2, 3), n=np.array(7), text=np.array("dig"), empty=np.zeros((0, 4)))
    got = {r.name: (r.shape, r["values"], r.texts) for r in files.read_arrays(spark, f"{tmp_path}/*.npz").collect()}
    assert got == {"x": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None), "n": ([], [7.0], None), "text": ([], None, ["dig"]), "empty": ([0, 4], [], None)}


def test_dataset(spark, tmp_path):
    df = spark.createDataFrame([(7, 4, 1.0), (7, 2, 2.0), (9000, 0, 3.0)], "ep long, frame long, x double")
    write_dataset(df, f"{tmp_path}/d", 2.0)
    rows = spark.read.parquet(f"{tmp_path}/d/data").orderBy("index").collect()
    assert [(r.episode_index, r.frame_index, r.timestamp, r["index"], r.x) for r in rows] == [(0, 0, 0.0, 0, 2.0), (0, 1, 0.5, 1, 1.0), (1, 0, 0.0, 2, 3.0)]
    episodes = spark.read.parquet(f"{tmp_path}/d/meta/episodes").orderBy("episode_index").collect()
    assert [(r.source_episode, r.length, r.dataset_from_index, r.dataset_to_index, r["data/file_index"]) for r in episodes] == [(7, 2, 0, 2, 0), (9000, 1, 2, 3, 0)]
    with pytest.raises(AnalysisException):
        write_dataset(df, f"{tmp_path}/d", 2.0)


def test_view_keeps_paths(spark, tmp_path):
    cameras = "`episode_index` long, `videos/observation.images.a/t` double, `videos/observation.images.b/t` double"
    for n, at in enumerate(("chunk-000/file-000", "chunk-001/file-000")):
        (tmp_path / "src" / at).parent.mkdir(parents=True)
        spark.createDataFrame([(n, 1.0, 2.0)], cameras).toPandas().to_parquet(tmp_path / "src" / f"{at}.parquet", index=False)
    with pytest.raises(ValueError):
        write_view(spark, f"{tmp_path}/src", f"{tmp_path}/out", ["c"])
    assert not (tmp_path / "out").exists()
    names = write_view(spark, f"{tmp_path}/src", f"{tmp_path}/out", ["a"])
    assert names == ["chunk-000/file-000.parquet", "chunk-001/file-000.parquet"]
    for n, name in enumerate(names):
        shard = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert shard.columns == ["episode_index", "videos/observation.images.a/t"] and shard.first().episode_index == n
