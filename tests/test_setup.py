"""Checks and errors of the setup operators, on rows that the queries' tables don't have."""

import pytest
from pyspark.sql import functions as F

from framelark.operators import setup
from framelark.sources.frames import event_frames, real_or_gradient

DATA = "/root/testdata/sf0.001"


def test_missing_episode(spark):
    with pytest.raises(ValueError, match="episode -5"):
        setup.one_episode(event_frames(spark, DATA), -5)


def test_positions_must_match(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 3.0)], "k string, at int, v double")
    zipped = setup.zip_by_position(a, a.where("not (k = 'x' and at = 1)"), "k", ["at"], "v", "v")
    assert {(r.k, r.place, r.a, r.b, r.complete) for r in zipped.collect()} == {("x", 0, 1.0, 2.0, False), ("x", 1, 2.0, None, False), ("y", 0, 3.0, 3.0, True)}
    with pytest.raises(ValueError, match="k x"):
        setup.require_complete(zipped, "k")
    assert setup.require_complete(zipped.where("k = 'y'"), "k").count() == 1


def test_missing_configuration(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    table = spark.createDataFrame([("a", 1, 10)], "x string, y int, steps int")
    assert {(r.x, r.known, r.steps) for r in setup.look_up(rows, table, ["x", "y"]).collect()} == {("a", True, 10), ("b", False, None)}
    with pytest.raises(KeyError, match="'y': 2"):
        setup.look_up(rows, table, ["x", "y"], strict=True)


def test_options():
    allowed = {"cpu": ("fp32",), "gpu": ("fp32", "fp16")}
    setup.check_options("gpu", "fp16", allowed)
    for backend, precision in (("tpu", "fp32"), ("cpu", "fp16")):
        with pytest.raises(ValueError):
            setup.check_options(backend, precision, allowed)


def test_hosts(spark):
    hosts = {"127.0.0.1": True, "127.9.9.9": True, "localhost": True, "::1": True, "[::1]": True, "0.0.0.0": False, "localhost.example.com": False, "128.0.0.1": False}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.x for r in df.select("h", setup.is_loopback(F.col("h")).alias("x")).collect()} == hosts
    assert all(setup.bind_allowed(h, False) == ok and setup.bind_allowed(h, True) for h, ok in hosts.items())


def test_roles_in_order(spark):
    rows = [("m", 1, "front image", "u8", 3), ("m", 2, "image", "u8", 3), ("m", 3, "vec", "f32", 1), ("m", 4, "other", "i64", 1), ("m", 5, "more", "i64", 1)]
    df = spark.createDataFrame(rows, "model string, key long, name string, dtype string, rank int")
    roles = [("image", "image", "u8", 3), ("second", "image", "u8", 3), ("state", "state", "f32", 1), ("mask", "mask", "i64", 1)]
    got = {r.role: (r.key, r.via) for r in setup.resolve_roles(df, "model", roles).collect()}
    assert got == {"image": (1, "name"), "second": (2, "name"), "state": (3, "shape"), "mask": (None, "missing")}


def test_texts(spark):
    row = spark.sql("select '\\t a\\n b\\u0007 ' as s, '1, ,x2' as c, cast(null as string) as n, '30000/1001' as r, '5/0' as z")
    got = row.select(setup.stripped(F.col("s")).alias("s"), setup.stripped(F.col("n")).alias("n"), setup.rate(F.col("r")).alias("r"), setup.rate(F.col("z")).alias("z"), setup.first_video(F.lit("{}")).alias("v")).first()
    assert (got.s, got.n, round(got.r, 3), got.z, got.v) == ("a\n b", "", 29.97, None, None)
    halves = spark.sql("select explode(array(0.5D, 1.5D, 2.5D, 2.4D)) as s").select(setup.frames_of(F.col("s"), F.lit(1.0)).alias("f")).collect()
    assert [r.f for r in halves] == [0, 2, 2, 2]


def test_fallback_only_where_nothing_is(spark, tmp_path):
    assert real_or_gradient(spark, f"{DATA}/region.parquet", 1, 1).columns == spark.read.parquet(f"{DATA}/region.parquet").columns
    assert real_or_gradient(spark, str(tmp_path / "none"), 3, 2).count() == 6


def test_samples(spark):
    row = spark.sql("select 'x updt_s:0.25 notupdt_s:9 updt_s:3' as a, 'none' as b, cast(null as string) as c, 'pid 0042 7' as d")
    got = row.select(*[setup.samples(F.col(x), "updt_s").alias(f"s{x}") for x in "abc"], *[setup.first_integer(F.col(x)).alias(f"i{x}") for x in "bcd"]).first()
    assert (got.sa, got.sb, got.sc, got.ib, got.ic, got["id"]) == ([0.25, 3.0], [], None, None, None, 42)
