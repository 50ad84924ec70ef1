"""Stateful streams with timers: a queue of planned actions that an episode's end resets, and the wait for a key's first frame.

Their state is in RocksDB, which transformWithState asks for; `drain_timed` sets it for its own run. A batch's rows of one key are
in one worker's memory, so the trigger's size (files_per_batch) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelark.streaming.live import drain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ActionQueue(StatefulProcessor):
    """State of a key: its episode, the calls since that began, and the action that is held."""

    def __init__(self, order: list[str], episode: str, value: str, steps: int, names: list[str]):
        self.order, self.episode, self.value, self.steps, self.names = order, episode, value, steps, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "episode long, tick long, held double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        calls = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        episode, tick, held = self.state.get() if self.state.exists() else (None, 0, 0.0)
        out = []
        for at, now, v in zip(calls[self.order[-1]], calls[self.episode], calls[self.value], strict=True):
            if now != episode:
                episode, tick = int(now), 0  # what was planned in the episode before is void
            held = float(v) if tick % self.steps == 0 else held
            out.append((key[0], at, episode, tick, tick % self.steps == 0, held))
            tick += 1
        self.state.update((episode, tick, held))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def episode_queue(stream: DataFrame, key: str, order: list[str], episode: str, value: str, steps: int) -> DataFrame:
    """(key, last of order, episode, tick, replan, held): one action per call; a plan is made at every steps-th call of an episode
    from the value seen then, and held until the next. An episode (a whole number) that differs from the call before it starts with an empty queue."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    names = [key, order[-1], "episode", "tick", "replan", "held"]
    schema = f"{key} {kinds[key]}, {order[-1]} {kinds[order[-1]]}, episode long, tick long, replan boolean, held double"
    rows = stream.selectExpr(*dict.fromkeys([key, *order, value]), f"cast({episode} as long) as {episode}")
    return rows.groupBy(key).transformWithStateInPandas(ActionQueue(order, episode, value, steps, names), schema, "Append", "None")


class FirstFrame(StatefulProcessor):
    """State of a key: when the wait began (microseconds), and whether it is over."""

    def __init__(self, key: str, ts: str, frame: str, timeout_ms: int):
        self.key, self.ts, self.frame, self.timeout_ms = key, ts, frame, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("wait", "began long, over boolean")

    def _row(self, key, began: int, waited: int | None):
        import pandas as pd

        return pd.DataFrame({self.key: [key[0]], "began": [datetime.fromtimestamp(began / 1e6, timezone.utc).replace(tzinfo=None)], "found": [waited is not None], "waited_ms": pd.array([waited], "Int64")})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        got = pd.concat(list(rows)).sort_values([self.ts], kind="stable")
        began, over = self.state.get() if self.state.exists() else (None, False)
        for at, is_frame in zip(got[self.ts].astype("datetime64[us]").astype("int64"), got[self.frame], strict=True):
            if began is None:
                began = int(at)
                self.handle.registerTimer(began // 1000 + self.timeout_ms)
            if over:
                break
            late = at - began > 1000 * self.timeout_ms
            if late or is_frame:
                over = True
                yield self._row(key, began, None if late else int(at - began) // 1000)
        self.state.update((began, over))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        began, over = self.state.get()
        if not over:
            self.state.update((began, True))
            yield self._row(key, began, None)

    def close(self) -> None:
        pass


def first_frames(stream: DataFrame, key: str, ts: str, frame: str, timeout_ms: int, late: str) -> DataFrame:
    """(key, began, found, waited_ms): a row for each key as soon as its first frame comes, or as soon as it is known that none came
    in time: by a later row of the key, or by the watermark (late behind the newest row of all keys) passing the timeout.

    The wait begins with a key's first row of any kind; frame is a boolean column."""
    kind = {f.name: f.dataType.simpleString() for f in stream.schema}[key]
    rows = stream.withWatermark(ts, late).select(key, ts, frame)
    return rows.groupBy(key).transformWithStateInPandas(FirstFrame(key, ts, frame, timeout_ms), f"{key} {kind}, began timestamp, found boolean, waited_ms long", "Append", "EventTime")


def drain_timed(stream: DataFrame) -> DataFrame:
    """drain() in append mode, with the state store that timers need; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return drain(stream, "append")
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
