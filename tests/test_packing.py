"""Greedy chunks and roles against plain loops, with ranges so small that every step runs."""

import random

import pytest

from framelark.operators.packing import greedy_chunks, running
from framelark.operators.setup import resolve_roles


def packed(sizes, budget):
    out, chunk, total = [], -1, 0
    for s in sizes:
        if chunk < 0 or total + s > budget:
            chunk, total = chunk + 1, 0
        total += s
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_greedy_chunks(spark, block):
    rng = random.Random(block)
    groups = {"a": [rng.randint(0, 9) for _ in range(150)], "zeros": [0] * 40, "large": [50, 1, 50, 50, 0, 0, 20, 21], "one": [4], "full": [20] * 9, "mixed": [rng.choice([0, 0, 0, 1, 20, 21]) for _ in range(60)]}
    rows = [(g, 5 * i + 2, s, "own") for g, v in groups.items() for i, s in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, size long, chunks string")
    got = {(r.g, r.at): r.chunk for r in greedy_chunks(df, "g", "at", "size", 20, block).collect()}
    assert got == {(g, 5 * i + 2): c for g, v in groups.items() for i, c in enumerate(packed(v, 20))}
    assert greedy_chunks(df.limit(0), "g", "at", "size", 20, block).count() == 0


def test_running(spark):
    rng = random.Random(2)
    rows = [(g, at, rng.randint(-5, 5)) for g in ("x", None) for at in rng.sample(range(-100, 100), 60)]
    got = {(r.g, r.at): r.s for r in running(spark.createDataFrame(rows, "g string, at long, v long"), ["g"], "at", {"s": "v"}, 8).collect()}
    assert got == {(g, at): sum(v for h, b, v in rows if h == g and b <= at) for g, at, _ in rows}


def resolved(inputs, roles):
    used, found = set(), {}
    for via in ("name", "shape"):
        for role, word, dtype, rank in roles:
            fits = [k for k, name, d, r in sorted(inputs) if k not in used and d == dtype and r == rank and (via == "shape" or word in name)]
            if role not in found and (fits if via == "name" else len(fits) == 1):
                found[role] = (fits[0], via)
                used.add(fits[0])
    return {role: found.get(role, (None, "missing")) for role, *_ in roles}


def test_roles(spark):
    rng = random.Random(7)
    roles = [("image", "img", "f", 4), ("state", "state", "f", 2), ("noise", "x", "f", 4), ("mask", "mask", "b", 2), ("extra", "img", "f", 4)]
    models = {m: [(k, rng.choice(["img", "state", "x_img", "mask", "other"]), rng.choice("fb"), rng.choice([2, 4])) for k in range(rng.choice([1, 2, 5, 8, 60]))] for m in range(120)}
    rows = [(m, *i) for m, v in models.items() for i in v]
    rng.shuffle(rows)
    out = resolve_roles(spark.createDataFrame(rows, "model long, key long, name string, dtype string, rank int"), "model", roles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.model, {})[r.role] = (r.key, r.via)
    assert got == {m: resolved(v, roles) for m, v in models.items()}
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "WindowGroupLimit" in plan
