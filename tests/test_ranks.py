"""Exact ranks by key against NumPy, with limits so low that every step of the narrowing runs, and no task that holds a key."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators.ranks import order_statistics, percentiles
from framelark.plans import perf_queries, trim_queries

NAN, INF = float("nan"), float("inf")


def values():
    rng = random.Random(4)
    some = {"hot": [rng.lognormvariate(0, 3) for _ in range(3000)], "ties": [float(rng.choice([1, 2, 2, 2, 3])) for _ in range(900)], "one": [7.0] * 500, "few": [3.0, 1.0], "odd": [NAN, INF, -INF, 0.0, -0.0, 1e-300, 1e300, NAN] * 40,
            None: [float(i * 37 % 801) for i in range(801)], "halves": [1.0] * 300 + [2.0] * 300, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(700)]}
    return {k: [x for x in v] for k, v in some.items()}


@pytest.mark.parametrize("limit", [3, 1 << 16])
def test_order_statistics(spark, limit):
    data = values()
    rows = [(k, x) for k, v in data.items() for x in v] + [("few", None), ("nothing", None)]
    random.Random(1).shuffle(rows)
    ranks = {"first": F.lit(0), "middle": F.expr("n div 2"), "late": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.99)), "last": F.col("n") - 1}
    got = {r.k: r for r in order_statistics(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", ranks, limit).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        v, n = np.sort(np.array(v)), len(v)
        want = [v[0], v[n // 2], v[min(n - 1, math.floor(n * 0.99))], v[-1]]
        assert got[k].n == n and np.array_equal([got[k][c] for c in ranks], want, equal_nan=True), k


@pytest.mark.parametrize("limit", [20, 1 << 16])
def test_percentiles(spark, limit):
    data = {k: v for k, v in values().items() if k not in ("odd", "wide")}
    rows = spark.createDataFrame([(k, i % 2, x) for k, v in data.items() for i, x in enumerate(v)], "k string, half int, x double")
    got = {(r.k, r.half): r for r in percentiles(rows, ["k", "half"], "x", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, limit).collect()}
    assert len(got) == 2 * len(data)
    for (k, half), r in got.items():
        assert np.allclose([r.p10, r.p50, r.p95], np.percentile(data[k][half::2], [10, 50, 95]), rtol=1e-12)
    assert percentiles(rows.limit(0), ["k"], "x", {"p": 0.5}).count() == 0


@pytest.mark.parametrize("query", [perf_queries.q_linear, perf_queries.q_index_rule, perf_queries.q_replan_split, perf_queries.q_stages, perf_queries.QUERIES["latency_nearest_rank"], trim_queries.QUERIES["global_feature_stats"]])
def test_plans_have_no_exact_percentile(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
