"""Policies as batch functions: a run is answered by the backend that its recorded type names, and its chunks are laid on the recording's grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a backend gets at once.
ROWS = 256


class Backend(Protocol):
    """What a policy type is answered by. One is made in each task that meets its type."""

    def predict(self, states: np.ndarray, tasks: list[str], chunk: int) -> np.ndarray:
        """Actions (rows, chunk, dims) for states (rows, width)."""


class Zeros:
    """Predicts nothing: zeros as wide as the state."""

    def predict(self, states: np.ndarray, tasks: list[str], chunk: int) -> np.ndarray:
        return np.zeros((len(states), chunk, states.shape[1]))


class Hold:
    """Repeats the state."""

    def predict(self, states: np.ndarray, tasks: list[str], chunk: int) -> np.ndarray:
        return np.repeat(states[:, None, :], chunk, axis=1)


class Ramp:
    """Lets the state fall to zero evenly over the chunk."""

    def predict(self, states: np.ndarray, tasks: list[str], chunk: int) -> np.ndarray:
        return states[:, None, :] * (1 - np.arange(chunk) / chunk)[None, :, None]


BACKENDS: dict[str, Callable[[], Backend]] = {"mock": Zeros, "hold": Hold, "ramp": Ramp}


def without_state(state: Column, blind: Column) -> Column:
    """Zeros in place of the state where a run was trained without one."""
    return F.when(blind, F.transform(state, lambda x: F.lit(0.0))).otherwise(state)


def predict_chunks(points: DataFrame, backends: dict[str, Callable[[], Backend]] = BACKENDS, rows: int = ROWS) -> DataFrame:
    """points (policy string, chunk int, state array<double>, task string, ...) with actions array<array<double>>.

    Rows of one policy and chunk length go to its backend together, as they come, up to `rows` of them. A policy without a backend, a state that is
    null or of another width than its neighbours', and actions of another shape than asked for are errors."""
    names = points.columns
    at = {n: names.index(n) for n in ("policy", "chunk", "state", "task")}
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Backend] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                policy, chunk, state, task = (b.column(at[n]).to_pylist() for n in ("policy", "chunk", "state", "task"))
                groups: dict[tuple[str, int], list[int]] = {}
                for i, key in enumerate(zip(policy, chunk, strict=True)):
                    groups.setdefault(key, []).append(i)
                actions: list = [None] * b.num_rows
                for (name, length), members in groups.items():
                    if name not in backends:
                        raise ValueError(f"no backend for policy {name!r}; there are {sorted(backends)}")
                    if name not in made:
                        made[name] = backends[name]()
                    states = np.array([state[i] for i in members], np.float64)
                    if states.ndim != 2:
                        raise ValueError(f"policy {name!r} needs a state in every row")
                    found = np.asarray(made[name].predict(states, [task[i] for i in members], length), np.float64)
                    if found.ndim != 3 or found.shape[:2] != (len(members), length):
                        raise ValueError(f"policy {name!r} gave actions of shape {found.shape} for {len(members)} rows of {length} steps")
                    for i, a in zip(members, found.tolist(), strict=True):
                        actions[i] = a
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(actions, pa.list_(pa.list_(pa.float64())))], names=[*names, "actions"])

    plain = points.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # the Arrow functions want names without dots
    return plain.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("actions", kind)]))


def repeats(source_rate: int, rate: Column) -> Column:
    """Frames of the recording for each step of a chunk: 0 where the chunk is faster than the recording."""
    return F.floor(F.lit(source_rate) / rate).cast("int")


def held(actions: Column, source_rate: int, rate: Column, n: Column) -> Column:
    """The first n (1 or more) frames of a chunk at `rate`, each step held until the next one; a chunk that does not reach so far is an error."""
    reps = repeats(source_rate, rate)
    covers = F.size(actions) * reps
    short = F.raise_error(F.format_string("chunk covers %.2fs, need %.2fs", covers / F.lit(float(source_rate)), n / F.lit(float(source_rate))))
    steps = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda t: F.get(actions, F.floor(t / reps).cast("int")))
    return F.when(covers < n, short).otherwise(steps)


def playback(frames: DataFrame, source_rate: int, rate: Column, steps: int) -> DataFrame:
    """The frames (ep, frame, ...) that a policy at `rate` is shown, `steps` of each episode at most, with their stride and number (step).

    A rate above the recording's, or none, is an error."""
    stride = F.floor(F.lit(source_rate) / rate)
    bad = F.raise_error(F.format_string("rate %s does not fit a recording at %d", rate.cast("string"), F.lit(source_rate)))
    out = frames.withColumn("stride", F.when(F.coalesce(stride >= 1, F.lit(False)), stride).otherwise(bad.cast("long")))
    out = out.withColumn("step", F.floor(F.col("frame") / F.col("stride")))
    return out.where((F.col("frame") % F.col("stride") == 0) & (F.col("step") < steps))


def joined(words: Column, sign: str = "+") -> Column:
    """Words in a row with a sign between them, a dash for none."""
    return F.coalesce(F.nullif(F.array_join(words, sign), F.lit("")), F.lit("-"))
