"""The score cache computes a key once."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelark.operators.cache import cache_key, cached


def test_cache(spark, tmp_path):
    path, counted = f"{tmp_path}/store", spark.sparkContext.accumulator(0)

    def score(rows):
        def run(batches):
            for b in batches:
                counted.add(len(b))
                yield b.assign(score=b["x"] * 2.0)[["_key", "score"]]

        return rows.mapInPandas(run, "_key string, score double")

    def step(rows, *parts):
        before = counted.value
        got = cached(rows, cache_key(1, F.col("name"), F.col("x"), *parts), path, score, ["score"]).collect()
        return sorted((r.name, r.x, r.score, r.hit) for r in got), counted.value - before

    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "name string, x long")
    assert step(one, 4) == ([("a", 1, 2.0, False), ("b", 2, 4.0, False), ("b", 2, 4.0, False)], 2)
    assert step(one, 4) == ([("a", 1, 2.0, True), ("b", 2, 4.0, True), ("b", 2, 4.0, True)], 0)
    more = one.union(spark.createDataFrame([("c", 3), ("a", 5)], one.schema))
    rows, n = step(more, 4)
    assert n == 2 and [r[3] for r in rows] == [True, False, True, True, False]
    assert step(one, 8) == ([("a", 1, 2.0, False), ("b", 2, 4.0, False), ("b", 2, 4.0, False)], 2)
    assert step(one, 4)[1] == 0
    assert step(one.limit(0), 4) == ([], 0)
    with pytest.raises(PySparkException, match="is null"):
        cached(one, F.lit(None).cast("string"), path, score, ["score"]).collect()
    assert one.select(cache_key(1, F.lit(None).cast("string"), "x") != cache_key(1, F.lit(""), "x")).distinct().collect()[0][0]
