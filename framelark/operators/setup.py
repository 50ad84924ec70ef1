"""Selecting, checking and joining what a run is set up from: names, roles, options, positions, configurations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a dataset manages itself.
AUTO = ("ep", "frame", "event_id", "ts")


def one_episode(frames: DataFrame, episode: int) -> DataFrame:
    """The frames of one episode; an error if there are none."""
    out = frames.where(F.col("ep") == episode)
    if out.isEmpty():
        raise ValueError(f"episode {episode} has no frames")
    return out


def features(frames: DataFrame) -> DataFrame:
    """Without the columns that the dataset manages itself."""
    return frames.drop(*AUTO)


def renamed_keys(c: Column, names: dict[str, str]) -> Column:
    """A map with some keys renamed; the others stay."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(c, lambda k, _: F.coalesce(known[k], k))


def zip_by_position(a: DataFrame, b: DataFrame, key: str, order: list[str], a_value: str, b_value: str) -> DataFrame:
    """(key, place, a, b, complete): the i-th row of a beside the i-th of b; complete says whether a key has as many of both."""
    place = lambda df, v, name: df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("place"), F.col(v).alias(name), F.lit(True).alias(f"has_{name}"))
    both = place(a, a_value, "a").join(place(b, b_value, "b"), [key, "place"], "full")
    whole = F.min(F.col("has_a").isNotNull() & F.col("has_b").isNotNull()).over(Window.partitionBy(key))
    return both.select(key, "place", "a", "b", whole.alias("complete"))


def require_complete(zipped: DataFrame, key: str) -> DataFrame:
    """zip_by_position's rows; an error if a key has more rows on one side."""
    bad = zipped.where("not complete").select(key).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][0]}: the two sides have different numbers of rows")
    return zipped


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """rows with the columns of a table of configurations by its composite key (Spark broadcasts it where it is small); strict: a missing key is an error."""
    out = rows.join(table.withColumn("known", F.lit(True)), keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    missing = out.where("not known").select(*keys).first() if strict else None
    if missing:
        raise KeyError(f"no configuration for {missing.asDict()}")
    return out


def resolve_roles(inputs: DataFrame, model: str, roles: list[tuple[str, str, str, int]]) -> DataFrame:
    """(model, role, key, via): which input serves each role of a model.

    inputs (model, key, name, dtype, rank), keys unique in a model; roles (role, word, dtype, rank) in order. First pass: the
    input of smallest key whose name holds the word, with that dtype and rank; second pass, for roles
    still open: the only unused input of that dtype and rank. No input serves twice; via is `name`,
    `shape` or `missing`.

    For each role the smallest keys that fit it are kept, two more than there are roles (tasks drop all others before the
    shuffle): of so many some is unused whatever the other roles take, and two unused ones are seen as such. The passes
    then fold over a model's lists with a list of used keys.
    """
    n, kind = len(roles), inputs.schema["key"].dataType.simpleString()
    fits = [(F.col("dtype") == dtype) & (F.col("rank") == rank) for _, _, dtype, rank in roles]
    named = [f & F.col("name").contains(word) for f, (_, word, _, _) in zip(fits, roles, strict=True)]
    lists = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate([*named, *fits])])
    each = inputs.select(model, "key", F.explode(F.array_compact(F.array_append(lists, F.lit(2 * n)))).alias("list"))  # list 2n: the model itself
    place = F.row_number().over(Window.partitionBy(model, "list").orderBy("key"))
    few = each.withColumn("place", place).where(F.col("place") <= n + 2).groupBy(model, "list").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    held = few.groupBy(model).agg(F.map_from_entries(F.collect_list(F.struct("list", "keys"))).alias("keys"))
    step = "struct(array_append(s.used, k) AS used, array_append(s.found, named_struct('role', {i}, 'key', k, 'via', '{via}')) AS found)"
    state = f"struct(cast(array() AS array<{kind}>) AS used, cast(array() AS array<struct<role: int, key: {kind}, via: string>>) AS found)"
    for i in range(2 * n):
        free = f"filter(coalesce(keys[{i}], cast(array() AS array<{kind}>)), k -> NOT array_contains(s.used, k))"
        take = step.format(i=i % n, via="name" if i < n else "shape")
        ok = f"size({free}) > 0" if i < n else f"size({free}) = 1 AND NOT exists(s.found, f -> f.role = {i - n})"
        held = held.withColumn("s", F.expr(state if i == 0 else "s")).withColumn("s", F.expr(f"if({ok}, transform(slice({free}, 1, 1), k -> {take})[0], s)"))
    names = F.array(*[F.lit(r[0]) for r in roles])
    wanted = held.select(model, "s", F.posexplode(names).alias("i", "role"))
    found = F.get(F.filter("s.found", lambda f: f["role"] == F.col("i")), F.lit(0))
    return wanted.select(model, "role", found["key"].alias("key"), F.coalesce(found["via"], F.lit("missing")).alias("via"))


def check_options(backend: str, precision: str, allowed: dict[str, tuple[str, ...]]) -> None:
    """An error that names the choices, if a backend does not exist or lacks a precision."""
    if backend not in allowed:
        raise ValueError(f"unknown backend {backend!r}; one of {sorted(allowed)}")
    if precision not in allowed[backend]:
        raise ValueError(f"backend {backend} has no precision {precision!r}; one of {sorted(allowed[backend])}")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(\[[^\]]*\]|[^/:?#]*)", 1))


_LOOPBACK = r"^(localhost|127(\.[0-9]{1,3}){3}|\[?::1\]?)$"


def is_loopback(host: Column) -> Column:
    return host.rlike(_LOOPBACK)


def bind_allowed(host: str, allow_remote: bool) -> bool:
    """A server may listen beyond this machine only when told so."""
    return allow_remote or bool(re.match(_LOOPBACK, host.lower()))


#: Characters below the blank, and delete.
_CONTROL = "".join(map(chr, [*range(32), 127]))


def stripped(c: Column) -> Column:
    """Without control characters and blanks at either end; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_CONTROL + " "))


def frames_of(seconds: Column, fps: Column) -> Column:
    """The nearest whole number of frames, halves to the even one."""
    return F.bround(seconds * fps).cast("long")


def numbers(c: Column) -> Column:
    """Comma-separated numbers; what is blank is null."""
    return F.transform(F.split(c, ","), lambda x: F.nullif(F.trim(x), F.lit("")).cast("double"))


def first_video(document: Column) -> Column:
    """The first video stream of a media description in JSON; null if it has none."""
    streams = F.from_json(document, "streams array<struct<codec_type:string,width:long,height:long,r_frame_rate:string>>")["streams"]
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))


def rate(text: Column) -> Column:
    """A rational such as 30000/1001 as a number; null for denominator 0."""
    return F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).cast("double"), F.coalesce(F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit("")).cast("double"), F.lit(1.0)))


def samples(text: Column, name: str) -> Column:
    """Every value of name:1.25 in a text, in order; null for null text."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\b{name}:([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def first_integer(text: Column) -> Column:
    """The first run of digits in a text, null without one."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("long")
