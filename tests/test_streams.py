"""Streams end with the rows that the batch SQL gives, however the input falls into batches."""

import os

import duckdb
import pytest

from framelark.plans import stream_queries as q
from framelark.streaming import live, timers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The events in four files by time, which come as four batches."""
    folder = tmp_path_factory.mktemp("events")
    con = duckdb.connect()
    (folder / "events.parquet").mkdir()
    for k in range(4):
        con.sql(f"copy (select * exclude (n) from (select *, ntile(4) over (order by ts, event_id) as n from '{DATA}/events.parquet') where n = {k + 1}) to '{folder}/events.parquet/{k}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_batches(spark, in_parts, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{DATA}/events.parquet'")
    want = con.sql(q.ORACLE[name]).df()
    got = q.QUERIES[name](spark, in_parts, 1).toPandas()
    cols = sorted(want.columns)
    order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    for name in q.QUERIES:
        assert q.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_late_rows(spark, tmp_path):
    """A row over a day behind counts in the batch after the one that moved the watermark, and is left out from the next on; one within the day counts."""
    import os

    batches = [[("2024-01-01 00:10:00", 1.0)], [("2024-01-05 00:00:00", 2.0)], [("2024-01-01 00:20:00", 4.0), ("2024-01-04 12:00:00", 8.0)], [("2024-01-01 00:30:00", 16.0), ("2024-01-04 12:30:00", 32.0)]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "at string, v double").selectExpr("timestamp(at) as ts", "'k' as k", "v").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in" / f"{n}.parquet", index=False)
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = live.reports(live.stream_table(spark, f"{tmp_path}/in", 1), "ts", "k", "v", "1 hour", "1 day")
    assert sorted((r.n, r.total) for r in live.drain(stream, "update", ["start", "k"]).collect()) == [(1, 2.0), (2, 5.0), (2, 40.0)]


def test_queue_is_reset_within_and_between_batches(spark, tmp_path):
    """The calls of one key over two episodes, cut into batches at every place: the second one plans anew at its first call."""
    calls = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 0)]
    want = [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0), (3, 3, 3.0), (4, 0, 4.0), (5, 1, 4.0), (6, 2, 4.0), (7, 0, 7.0)]
    for cut in (2, 4, 6):
        folder = tmp_path / f"cut{cut}"
        folder.mkdir()
        for n, rows in enumerate((calls[:cut], calls[cut:])):
            spark.createDataFrame([("k", at, ep, float(at)) for at, ep in rows], "k string, at long, ep long, v double").toPandas().to_parquet(folder / f"{n}.parquet", index=False)
            os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
        got = timers.drain_timed(timers.episode_queue(live.stream_table(spark, str(folder), 1), "k", ["at"], "ep", "v", 3)).collect()
        assert sorted((r["at"], r.tick, r.held) for r in got) == want


def test_first_frame_or_timeout(spark, tmp_path):
    """A frame in time, one that comes late, a key whose own later row ends the wait, one that only the watermark ends, and one still waiting."""
    t = "2024-01-01 {}".format
    batches = [[("in", t("00:00:00"), False), ("in", t("00:00:02"), True), ("late", t("00:00:00"), False), ("own", t("00:00:00"), False), ("mark", t("00:00:01"), False)], [("late", t("00:00:09"), True), ("own", t("00:00:08"), False)], [("open", t("00:10:00"), False)], [("open", t("00:10:01"), False)]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, at string, f boolean").selectExpr("k", "timestamp(at) as ts", "f").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in" / f"{n}.parquet", index=False)
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    got = timers.drain_timed(timers.first_frames(live.stream_table(spark, f"{tmp_path}/in", 1), "k", "ts", "f", 5000, "1 minute")).collect()
    assert {r.k: (r.found, r.waited_ms) for r in got} == {"in": (True, 2000), "late": (False, None), "own": (False, None), "mark": (False, None)} and len(got) == 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
