"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors come from all documents. Words fall into WORDS buckets by a hash; each bucket has a
sparse random index vector (NONZERO entries of +1 or -1 among DIM), and a word's vector is the sum of
its neighbours' index vectors (up to REACH words away) over the whole corpus: whole numbers, so their
sum does not depend on order or on retried tasks. A task sends one row for each bucket at most, and Spark adds
them; the driver gets the WORDS * (DIM + 1) numbers of the result, however large the corpus.

A document is pooled from its words' vectors (centred and scaled to one length, rare words weighing more): the mean over
words, the mean over distinct words, their lengths, and the share of distinct words and the number of
words. The network is fitted on a bounded sample of labelled documents, SAMPLE per class on average,
drawn by a hash of the id and weighted back to the classes' true shares; a fifth of it, also by hash, is
kept from the fit, chooses the epoch, and calibrates the temperature that divides the logit.

Defined results: null or empty text is pooled from no words and scored like any other; labels that are null are not
learned, nor are those of an id whose rows disagree; of several documents of one id one is learned from; without labels of
both classes every score is the share of positives (0.5 without labels); repeated rows are scored
alike; texts are taken whole; an input column named like an output column gives way; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_docs, without

WORDS, DIM, NONZERO, REACH = 1 << 15, 32, 2, 2
SAMPLE, HIDDEN, EPOCHS, RATE, DECAY, SEED = 4000, 24, 300, 0.01, 1e-4, 12
#: Words in these words' share of the corpus weigh half of what the rarest do.
RARE = 1e-3
FLUSH_WORDS = 1 << 19
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
#: Hashes a worker remembers; more are computed anew.
_REMEMBERED = 1 << 18


class _Buckets(dict):
    """word -> bucket; a capital at the start alone does not make another word."""

    def __missing__(self, word: str) -> int:
        k = xxhash.xxh3_64_intdigest(word.lower() if word[1:].islower() else word) & (WORDS - 1)
        if len(self) < _REMEMBERED:
            self[word] = k
        return k


_buckets = _Buckets()


def word_ids(text: str | None) -> np.ndarray:
    words = _WORD.findall(text or "")
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket NONZERO places and signs, made from SEED."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (WORDS, NONZERO)), rng.choice([-1, 1], (WORDS, NONZERO))


def contexts(ids: np.ndarray, doc: np.ndarray, total: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to total (WORDS * DIM) the index vectors of the neighbours of every word within its document."""
    place, sign = index
    for k in range(1, REACH + 1):
        same = doc[:-k] == doc[k:]
        a, b = ids[:-k][same], ids[k:][same]
        for of, near in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(of * DIM + place[near, j], weights=sign[near, j], minlength=len(total)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, count, index = np.zeros(WORDS * DIM, np.int64), np.zeros(WORDS, np.int64), index_vectors()
    held, n = [], 0

    def flush() -> None:
        ids = np.concatenate(held)
        contexts(ids, np.repeat(np.arange(len(held)), [len(x) for x in held]), total, index)
        count[:] += np.bincount(ids, minlength=WORDS)
        held.clear()

    for b in batches:
        for text in b.column(0):
            held.append(word_ids(text.as_py()))
            n += len(held[-1])
            if n >= FLUSH_WORDS:
                flush()
                n = 0
    if held:
        flush()
    used = np.flatnonzero(count)
    cols = [pa.array(used), pa.array(count[used]), *[pa.array(c) for c in total.reshape(WORDS, DIM)[used].T]]
    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "n", *[f"v{k}" for k in range(DIM)]])


class Vectors:
    """Word vectors scaled to one length, with the weight of each word in a pool."""

    def __init__(self, count: np.ndarray, total: np.ndarray):
        mean = total.sum(0) / max(1, count.sum())
        x = total / np.maximum(count, 1)[:, None] - mean
        length = np.linalg.norm(x, axis=1, keepdims=True)
        self.x = (x / np.where(length > 0, length, 1)).astype(np.float32)
        self.weight = (RARE / (RARE + count / max(1, count.sum()))).astype(np.float32)

    def pooled(self, text: str | None) -> np.ndarray:
        ids = word_ids(text)
        n, (distinct, times) = len(ids), np.unique(ids, return_counts=True)
        w = self.weight[distinct]
        pools = [(self.x[distinct] * (w * t)[:, None]).sum(0) / max(1e-9, float((w * t).sum())) for t in (times, np.ones(len(distinct)))]
        shape = [*map(np.linalg.norm, pools), len(distinct) / max(1, n), np.log1p(n), float((w * times).sum()) / max(1, n)]
        return np.concatenate([*pools, shape]).astype(np.float32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> Vectors:
    """Vectors of all words of all documents."""
    sums = ", ".join(f"v{k} long" for k in range(DIM))
    parts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_gathered, f"bucket long, n long, {sums}")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)]).toArrow()
    count, total, at = np.zeros(WORDS, np.int64), np.zeros((WORDS, DIM), np.int64), found["bucket"].to_numpy()
    count[at] = found["n"].to_numpy()
    for k in range(DIM):
        total[at, k] = found[f"v{k}"].to_numpy()
    return Vectors(count, total)


class Network:
    """Two layers: tanh, then a logit, divided by a temperature. flat: the only answer, where there is nothing to learn."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray):
        self.flat = None if len(set(y[~held].tolist())) == 2 else float((y * weight).sum() / weight.sum()) if len(y) else 0.5
        if self.flat is not None:
            return
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-6
        z = self._scaled(x)
        rng = np.random.default_rng(SEED)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        best, least = [a.copy() for a in p], np.inf
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        judge = held if held.any() and len(set(y[held].tolist())) == 2 else ~held
        zt, yt, wt = z[~held], y[~held], weight[~held] / weight[~held].sum()
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(zt @ p[0] + p[1])
            err = (_sigmoid(hidden @ p[2] + p[3]) - yt) * wt
            back = np.outer(err, p[2]) * (1 - hidden**2)
            grads = [zt.T @ back + DECAY * p[0], back.sum(0), hidden.T @ err + DECAY * p[2], err.sum(keepdims=True)]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            loss = _loss(np.tanh(z[judge] @ p[0] + p[1]) @ p[2] + p[3], y[judge], weight[judge])
            if loss < least:
                best, least = [a.copy() for a in p], loss
        self.p = best
        logit = np.tanh(z[judge] @ best[0] + best[1]) @ best[2] + best[3]
        # Targets short of 0 and 1, by the count of each class: few documents that all fall right are no proof of certainty.
        n = [int((y[judge] == k).sum()) for k in (0, 1)]
        aim = np.where(y[judge] == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        tried = np.exp(np.linspace(np.log(0.1), np.log(10), 185))
        self.temperature = float(tried[np.argmin([_loss(logit / t, aim, weight[judge]) for t in tried])])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return _sigmoid((np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]) / self.temperature)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _loss(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, s) - y * s)).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Network from documents whose ids have a label 0 or 1; SAMPLE per class on average bound what is broadcast and collected."""
    marks = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("y")).where("i is not null and y in (0, 1)")
    marks = marks.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("i", "y")
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("quality"), "i"), F.lit(1 << 30)) / float(1 << 30)
    share = {y: min(1.0, SAMPLE / n) for y, n in sizes.items()}
    some = marks.where(F.coalesce(*[F.when(F.col("y") == y, draw < s) for y, s in share.items()], F.lit(False)))
    rows = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), F.col("d") == F.col("i"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    found = map_docs(rows, lambda texts: ([shared.value.pooled(t).tobytes() for t in texts],), ["text"], "x binary", ["i", "y"])
    found = sorted(found.groupBy("i", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: r["i"])
    y = np.array([r["y"] for r in found], np.float64)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64).reshape(-1, 2 * DIM + 5)
    held = np.array([xxhash.xxh3_64_intdigest(f"held {r['i']}") % 5 == 0 for r in found], bool)
    return Network(x, y, np.array([1 / share[v] for v in y]), held)


def score(docs: DataFrame, vectors: Vectors, network: Network, text_col: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))  # WORDS * (DIM + 1) numbers and the network

    def run(texts):
        v, net = shared.value
        p = net.probability(np.array([v.pooled(t) for t in texts], np.float64)) if texts else np.empty(0)
        return p.tolist(), (p >= 0.5).astype(int).tolist()

    return map_docs(without(docs, "score", "predicted"), run, [text_col], "score double, predicted int")


def learns(doc_id: Column) -> Column:
    """Whether the labels of this id may be learned (a null id's may not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = word_vectors(docs)
    network = fit(docs, table(spark, sf_dir, "labels").where(learns(F.col("doc_id"))), vectors)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs.withColumn("held_out", held_out), vectors, network).select("doc_id", "held_out", "score", "predicted")
