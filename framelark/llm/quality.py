"""Quality rules: two base rules and robust multivariate outliers.

Per language and source, the minimum covariance determinant of transformed statistics is estimated
over all documents that pass the base rules. Three deterministic starts at the medians (deviations
from the quartiles, from the narrower side of the median, and the granted ones alone) take
concentration steps: mean and covariance of the core, the (n + p + 1) / 2 of n documents with the
smallest distances, so that junk up to nearly a half does not enter it. After SCREEN steps the start
with the smallest determinant goes on alone until no group's determinant falls any more (a warning
says so if STEPS are taken before). One last step reweights: mean and covariance of the documents
within REWEIGHT of the scaled core.

The same is done for each language and for all documents, and by one formula, whatever their sizes,
each estimate is shrunk toward the wider one: that of n documents weighs m / (m + PRIOR), where m =
n - p - 1 is what n has beyond the documents that a covariance of p statistics takes (0 if less);
means and covariances mix as those of a mixture do. A document is rejected when its squared
Mahalanobis distance exceeds CUTOFF.

A step is one pass: each task adds up counts, sums and products by group, start and bin of distance
(BINS to a doubling), and a group's core is its nearest bins and a share of the one that its edge
cuts. So a source that holds a third of all rows is no hot task. The estimates join the rows as a
table, which is broadcast only when its counted rows are few.

A share that is zero in nearly all documents has no variance in the core; FLOOR is the deviation that
every statistic is granted, so that one symbol in a clean text is no outlier. CUTOFF is set far
beyond the chi-square tail, as texts are not normal: it is meant for documents of another kind.

Defined results: null text has no words and fails the base rules; null language or source is a group
value like any other; texts are taken whole; repeated rows are judged alike; an input column named
like an output column gives way; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few_tasks, map_docs, numbered, opened, sealed, small, window_hashes, without, word_hashes

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Parameters of the estimate.
STARTS, SCREEN, STEPS, PRIOR, CUTOFF = 3, 2, 30, 60, 64.0
#: Bins of distance to a doubling, the bin of distance 1, the number of bins; the edge of reweighting is a bin's edge.
BINS, ONE, LAST = 4, 32, 255
REWEIGHT = 2**4.25
#: A fall of the log determinant that is worth another step.
SETTLED = 0.01
#: Statistics and the deviation that each is granted at least. Repeats have a base rule of their own, so theirs is wide.
FLOOR = {"word_length": 0.04, "symbols": 0.035, "dup_lines": 0.12, "repeats": 0.12, "upper": 0.04, "punct": 0.04, "stutter": 0.04, "digits": 0.1}

_UPPER = bytes(range(65, 91))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS = b"0123456789"
_P = len(FLOOR)
_RIDGE = np.diag([f * f for f in FLOOR.values()])
#: Places of a symmetric matrix above and on its diagonal.
_UP = np.triu_indices(_P)
_SUMS = 1 + _P + len(_UP[0])
#: Bytes of a group's row, at most about.
_ROW_BYTES = 8 * STARTS * _SUMS + 200


def counts(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics."""
    text = text or ""
    body = text.encode()
    words = body.split()
    n = len(words)
    word_bytes = sum(map(len, words))
    word_chars = len(text) - (len(body) - word_bytes)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in body.split(b"\n") if x.strip()]  # bytes.strip() takes the same white space as the word pattern
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        w = window_hashes(word_hashes(words), WINDOW)
        _, of, times = np.unique(w, return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        again = times[of] > 1
        edge[: len(w)] += again
        edge[WINDOW : WINDOW + len(w)] -= again
        repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    if not n:
        return 0, word_chars, symbols, dup, repeat, [0.0] * _P
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    upper, punct, digits = (1 - len(body.translate(None, some)) / len(body) for some in (_UPPER, _PUNCT, _DIGITS))
    shares = [symbols / max(word_chars, 1), dup / max(len(lines), 1), repeat / n, upper, punct, stutter / n, digits]
    return n, word_chars, symbols, dup, repeat, [math.log(word_chars / n), *map(math.sqrt, shares)]


def failed(n_words, n_repeat_words):
    """The base rules, of numbers or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    def run(texts):
        return list(zip(*map(counts, texts), strict=True)) if texts else [[] for _ in range(6)]

    keep = [c for c in (keep or docs.columns) if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__x"}]
    out = map_docs(docs, run, [text_col], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, __x array<double>", keep)
    return out.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def _chi2(x: float, p: int) -> float:
    """Distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def consistency(core: float, p: int = _P) -> float:
    """Factor that makes the covariance of the nearest share of a normal sample that of all of it (p even)."""
    if core >= 1:
        return 1.0
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, p) < core else (lo, mid)
    return core / _chi2(lo, p + 2)


def core_size(n: int, p: int = _P) -> float:
    return min(n, (n + p + 1) / 2)


def packed(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """Mean and the inverse of the covariance with what is granted, as one list."""
    return [*mean.tolist(), *np.linalg.inv(cov + _RIDGE)[_UP].tolist()]


def raw(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    return [*mean.tolist(), *cov[_UP].tolist()]


def shrunk(levels: list[tuple[int, list[float] | None]]) -> list[float] | None:
    """The packed estimate from (n, raw estimate) of the widest group to the narrowest; null without any."""
    mean = cov = None
    for n, e in levels:
        if e is None:
            continue
        own, c = np.array(e[:_P]), np.empty((_P, _P))
        c[_UP] = e[_P:]
        c.T[_UP] = c[_UP]
        if mean is None:
            mean, cov = own, c
            continue
        m, off = max(0, n - _P - 1), own - mean
        w = m / (m + PRIOR)
        mean, cov = mean + w * off, (1 - w) * cov + w * c + w * (1 - w) * np.outer(off, off)
    return None if mean is None else packed(mean, cov)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distances(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances: a row for each document, a column for each packed estimate."""
    starts = e.shape[1] // (_P + len(_UP[0]))
    e = e.reshape(len(e), starts, -1)
    y = x[:, None, :] - e[:, :, :_P]
    twice = np.where(_UP[0] == _UP[1], 1.0, 2.0)
    return (e[:, :, _P:] * twice * y[:, :, _UP[0]] * y[:, :, _UP[1]]).sum(2)


def bins(d: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(d, 1e-9)) * BINS).astype(np.int64) + ONE, 0, LAST)


def nearest(by_bin: np.ndarray, v: np.ndarray, size: float) -> np.ndarray:
    """Of sums v by ascending bin, those over the nearest size documents; of the last bin an even share."""
    order = np.argsort(by_bin)
    v = v[order]
    before = np.cumsum(v[:, 0]) - v[:, 0]
    share = np.clip((size - before) / np.maximum(v[:, 0], 1e-300), 0, 1)
    return (v * share[:, None]).sum(0)


def moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = s[1 : 1 + _P] / s[0], np.empty((_P, _P))
    cov[_UP] = s[1 + _P :] / s[0]
    cov.T[_UP] = cov[_UP]
    return mean, cov - np.outer(mean, mean)


def _started(quartiles: DataFrame) -> DataFrame:
    """(__k, __n, __q), three quartiles of each statistic -> (__k, __n, __e, __det, __fall): the packed starts."""

    def run(quartiles):
        out = []
        for one in quartiles:
            lo, mid, hi = np.array(one).T
            spreads = [(hi - lo) / 1.349, np.minimum(mid - lo, hi - mid) / 0.6745, np.zeros(_P)]
            out.append([v for spread in spreads for v in packed(mid, np.diag(spread**2))])
        return out, [np.inf] * len(out), [np.inf] * len(out)

    return cut(map_docs(quartiles, run, ["__q"], "__e array<double>, __det double, __fall double", ["__k", "__n"]))


def _sums(rows: DataFrame) -> DataFrame:
    """Of (__k, __x, __e): per group, (start, bin, count, sums and products of __x) of every bin, added up in each task first."""

    def run(batches):
        total: dict[tuple[str, int, int], np.ndarray] = {}

        def out():
            keys = list(total)
            v = np.array([total[k] for k in keys])
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)], *[pa.array(np.ascontiguousarray(c)) for c in v.T]], names=names)

        for b in batches:
            x = _matrix(b.column(1), _P)
            d = bins(distances(x, np.stack(b.column(2).to_numpy(zero_copy_only=False))))
            of = b.column(0).dictionary_encode()
            groups, at = of.dictionary.to_pylist(), of.indices.to_numpy().astype(np.int64)
            features = np.column_stack([np.ones(len(x)), x, x[:, _UP[0]] * x[:, _UP[1]]])
            for start in range(d.shape[1]):
                key = at * (LAST + 1) + d[:, start]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                for k, v in zip(key[order][first].tolist(), np.add.reduceat(features[order], first), strict=True):
                    name = (groups[k // (LAST + 1)], start, k % (LAST + 1))
                    total[name] = total[name] + v if name in total else v
            if len(total) > 50_000:
                yield out()
                total.clear()
        if total:
            yield out()

    names = ["__k", "start", "bin", *[f"v{i}" for i in range(_SUMS)]]
    schema = "__k string, start int, bin int, " + ", ".join(f"v{i} double" for i in range(_SUMS))
    each = rows.select("__k", "__x", "__e").mapInArrow(run, schema)
    return each.groupBy("__k", "start", "bin").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(_SUMS)])


def _by_start(sums: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    start, at = np.array([s["start"] for s in sums]), np.array([s["bin"] for s in sums])
    v = np.array([s["v"] for s in sums])
    return {k: (at[start == k], v[start == k]) for k in np.unique(start).tolist()}


def concentrated(sums: list, n: int, screen: bool, last: bool) -> tuple[list[float], float]:
    """Packed estimates after a step and the smallest log determinant; screen keeps the best start alone; last scales it."""
    cores = [moments(nearest(*s, core_size(n))) for s in _by_start(sums).values()]
    dets = [float(np.linalg.slogdet(cov + _RIDGE)[1]) for _, cov in cores]
    if screen or last:
        mean, cov = cores[int(np.argmin(dets))]
        return packed(mean, cov * (consistency(core_size(n) / n) if last else 1.0)), min(dets)
    return [v for c in cores for v in packed(*c)], min(dets)


def reweighted(sums: list) -> list[float]:
    """The raw estimate over the bins within REWEIGHT."""
    ((at, v),) = _by_start(sums).values()
    near = v[at < round(np.log2(REWEIGHT) * BINS) + ONE]
    mean, cov = moments(near.sum(0) if len(near) else v.sum(0))
    return raw(mean, cov * _chi2(REWEIGHT, _P) / _chi2(REWEIGHT, _P + 2))


def _joined(rows: DataFrame, groups: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """groups: n rows; null keys are values."""
    g = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    match = on[0]
    for c in on[1:]:
        match = match & c
    return rows.join(small(g, n, _ROW_BYTES), match, "left").drop(*[f"__g_{k}" for k in keys])


def estimates(rows: DataFrame, groups: int) -> DataFrame:
    """(__k, __e): location and scatter (raw) of __x per group __k, of which there are groups at most."""
    quartiles = rows.groupBy("__k").agg(F.count("*").alias("__n"), F.array(*[F.percentile_approx(F.col("__x")[i], [0.25, 0.5, 0.75], 2000) for i in range(_P)]).alias("__q"))
    now = _started(few_tasks(quartiles, groups))

    def stepped(now: DataFrame, fn, added: str) -> DataFrame:
        sums = few_tasks(_sums(rows.join(small(now.select("__k", "__e"), groups, _ROW_BYTES), "__k")), groups * 100)
        v = F.array(*[f"v{i}" for i in range(_SUMS)]).alias("v")
        lists = few_tasks(sums.groupBy("__k").agg(F.collect_list(F.struct("start", "bin", v)).alias("__s")), groups)  # at most STARTS * LAST structs
        return cut(map_docs(few_tasks(lists.join(small(now.select("__k", "__n", F.col("__det").alias("__was")), groups, _ROW_BYTES), "__k"), groups), fn, ["__s", "__n", "__was"], added, ["__k", "__n"]))

    for step in range(1, STEPS + 1):

        def concentrate(sums, sizes, was, step=step, last=False):
            out = [concentrated(s, n, step >= SCREEN, last) for s, n in zip(sums, sizes, strict=True)]
            return [e for e, _ in out], [d for _, d in out], [w - d for w, (_, d) in zip(was, out, strict=True)]

        now = stepped(now, concentrate, "__e array<double>, __det double, __fall double")
        fall = now.agg(F.max("__fall")).first()[0] or 0
        if step > SCREEN and fall < SETTLED:
            break
    else:
        warnings.warn(f"a determinant still fell by {fall:.3f} (its logarithm) in the last of {STEPS} steps", stacklevel=2)

    def scale(sums, sizes, was):
        out = [concentrated(s, n, True, True) for s, n in zip(sums, sizes, strict=True)]
        return [e for e, _ in out], [d for _, d in out], [0.0] * len(out)

    now = stepped(now, scale, "__e array<double>, __det double, __fall double")
    return stepped(now, lambda sums, sizes, was: ([reweighted(s) for s in sums],), "__e array<double>").select("__k", "__e")


def _levels(s: DataFrame) -> tuple[DataFrame, int, int]:
    """Per language and source: the keys of its three groups, from itself to all documents, and how many past the base rules each has; groups and rows of s."""
    sizes = cut(s.groupBy("__lang", "__source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("__n0"), F.count("*").alias("__rows")))
    n, rows, passed = sizes.agg(F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.sum("__n0"), F.lit(0))).first()
    sizes = few_tasks(sizes, n)
    groups = _joined(sizes, few_tasks(sizes.groupBy("__lang").agg(F.sum("__n0").alias("__n1")), n), n, ["__lang"])
    # One name for each group; a null language or source is a value, so the level is part of the name.
    key = lambda level, *parts: F.to_json(F.struct(F.lit(level).alias("__level"), *parts))
    keys = [key(0, "__lang", "__source").alias("__k0"), key(1, "__lang").alias("__k1"), key(2).alias("__k2")]
    return cut(few_tasks(groups.select("__lang", "__source", *keys, "__n0", "__n1", F.lit(passed).cast("long").alias("__n2")), n)), n, rows


def fit(s: DataFrame) -> tuple[DataFrame, int]:
    """(__lang, __source, __e), and how many rows, from statistics (__lang, __source, base_failed, __x) of all documents."""
    levels, groups, rows = _levels(s)
    fed = _joined(few_tasks(s.where("not base_failed"), rows), levels, groups, ["__lang", "__source"])
    most = 2 * groups + 1
    fitted = estimates(few_tasks(cut(fed.select(F.explode(F.array("__k0", "__k1", "__k2")).alias("__k"), "__x")), rows), most)
    for k in range(3):
        levels = levels.join(small(fitted.select(F.col("__k").alias(f"__k{k}"), F.col("__e").alias(f"__e{k}")), most, _ROW_BYTES), f"__k{k}", "left")

    def shrink(*columns):
        n, e = columns[:3], columns[3:]
        return ([shrunk([(n[k][i], e[k][i]) for k in (2, 1, 0)]) for i in range(len(n[0]))],)

    out = map_docs(few_tasks(levels, groups), shrink, ["__n0", "__n1", "__n2", "__e0", "__e1", "__e2"], "__e array<double>", ["__lang", "__source"])
    return cut(out), groups


def _judged(s: DataFrame, fitted: DataFrame, groups: int) -> DataFrame:
    """s without __lang, __source and __x, with distance (null only where no document passes the base rules) and kept."""
    keep = [f for f in s.schema.fields if f.name not in {"__lang", "__source", "__x"}]
    k = len(keep)

    def run(batches):
        for b in batches:
            known = b.column(k + 1).is_valid()
            at = known.to_numpy(zero_copy_only=False)
            d = np.zeros(b.num_rows)
            if at.any():
                some = b.filter(known)
                d[at] = distances(_matrix(some.column(k), _P), np.stack(some.column(k + 1).to_numpy(zero_copy_only=False)))[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(d, mask=~at)], names=[*[f.name for f in keep], "distance"])

    rows = _joined(s, fitted, groups, ["__lang", "__source"]).select(*numbered([f.name for f in keep]), "__x", "__e")
    out = rows.mapInArrow(run, T.StructType([*keep, T.StructField("distance", T.DoubleType())]))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, distance (double, null only where no document passes the base rules), kept."""
    docs = without(docs, *_ADDED)
    keep = [c for c in (keep or docs.columns) if c in docs.columns]
    own = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(own.alias("own"), *[F.col(f"`{c}`").alias(name) for name, c in (("text", text_col), ("__lang", lang_col), ("__source", source_col))])
    s = cut(statistics(rows, "text", ["own", "__lang", "__source"]))
    return opened(_judged(s, *fit(s)), keep, {}, *_ADDED)


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns as they came, whatever their names.

    The estimates are made from numbers alone; a second scan judges, so that no text is written twice.
    """
    rows = sealed(docs, text="text", __lang="lang", __source="source")
    fitted, groups = fit(cut(statistics(rows.select("text", "__lang", "__source"), "text", ["__lang", "__source"])))
    copies = rows.withColumns({"lang": F.col("__lang"), "source": F.col("__source")})
    known = _joined(copies, fitted, groups, ["__lang", "__source"]).select("own", "text", "lang", "source", "__e")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                good = []
                for text, e in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                    n, _, _, _, repeat, x = counts(text)
                    good.append(not failed(n, repeat) and (e is None or float(distances(np.array([x]), np.array([e]))[0, 0]) <= CUTOFF))
                yield b.filter(pa.array(good, pa.bool_())).select([0, 1, 2, 3])

    kept = known.mapInArrow(run, known.drop("__e").schema)
    return opened(kept, docs.columns, {c: F.col(c) for c in ("text", "lang", "source")})


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
