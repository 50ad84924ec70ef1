"""Every query with SQL gives the same rows in Spark and DuckDB; trim traps on hand-made frames."""

import duckdb
import pytest

from framelark import catalog
from framelark.operators.trim import report, trim_plan

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    a, b = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(a).equals(order(b))


def _frames(spark, states, slew, move, ep=1):
    return spark.createDataFrame([(ep, i, float(s), float(a), float(b)) for i, (s, a, b) in enumerate(zip(states, slew, move))], "ep long, frame long, state double, slew double, move double")


def test_report_names_those_left_out(spark):
    f = _frames(spark, [0, 0, 0], [0, 0, 0], [0, 0, 0], 10)
    for ep, command in ((9, 0), (2, 1), (11, 1), (4, 1)):
        f = f.unionByName(_frames(spark, [0, 9, 0], [0, 0, 0], [0, command, 0], ep))
    r = report(trim_plan(f, 1.0, 0.5, 5.0, 1, (11, 2)), 1.0, 1).first()
    assert (r.episodes, r.kept, r.excluded_ids, r.silent_ids) == (5, 1, "2,11", "9,10")


def test_trim_traps(spark):
    plan = lambda *x: trim_plan(_frames(spark, *x), 1.0, 0.5, 5.0, 1).first()
    silent = plan([0, 0, 0], [0, 0, 0], [0, 0, 0])
    assert (silent.reason, silent.keep, silent.stop) == ("silent", 0, 2)
    late = plan([0, 0, 0, 99, 0], [0] * 5, [1, 0, 0, 0, 0])
    assert late.reason == "degenerate" and late.keep <= 0
    slew = plan([0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1])
    assert (slew.start, slew.stop, slew.keep) == (1, 3, 3)
    assert plan([0], [1], [0]).keep == 1


def test_conservation(spark):
    from framelark.plans.trim_queries import q_apply, q_meta

    meta = q_meta(spark, DATA).toPandas().sort_values("new_ep")
    assert meta.length.sum() == q_apply(spark, DATA).count()
    assert (meta.from_index.iloc[1:].to_numpy() == meta.to_index.iloc[:-1].to_numpy()).all()
