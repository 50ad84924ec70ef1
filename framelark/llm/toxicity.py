"""Toxicity by a classifier chain over hashed word features.

Categories are predicted in order. Each has a linear (logistic) model on the presence of hashed words and of
the text's shape (levels of its shares of symbols, capitals, repeated and distinct words), and on the probabilities of
the categories before it. While training, those probabilities come from out-of-fold
models (FOLDS folds by a hash of the id), so that a later model learns from predictions as good as it
will get on unseen text, not from fitted labels. Out-of-fold scores also set the scale and the offset that make each
category's score a probability of the corpus: documents are weighted back to the true shares of the classes they were drawn from.

The default chain is low quality, then toxic. Training uses a bounded sample: about SAMPLE labelled
documents per class of the last category, drawn by a hash of the id. Prediction reads whole texts; a
word counts once per text.

Defined results: null text or text without words gets the models' prior and the shape's evidence; labels that are null are
left out of that category's training; repeated rows are predicted alike; without labels of both
classes the category's probability is its share of positives (0 without labels); an input column
named like an output column gives way; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_docs, without

DIM = 1 << 18
SAMPLE, FOLDS, EPOCHS, RATE, PENALTY = 4000, 5, 150, 0.5, 2e-4
MARGIN = 0.5
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
_WORD = re.compile(r"[^\W\d_]+")


_SYMBOLS = "#$%&*|<>!~^"
_CAPITALS = bytes(range(65, 91))


def shape(text: str) -> list[str]:
    """Levels of a text's shares, four to a doubling from a thousandth on, as words that no text holds."""
    body = text.encode()
    words = body.split()
    n = max(1, len(words))
    shares = {
        "symbols": sum(map(text.count, _SYMBOLS)) / max(1, len(text)), "capitals": 1 - len(body.translate(None, _CAPITALS)) / max(1, len(body)),
        "again": sum(map(bytes.__eq__, words, words[1:])) / n, "distinct": len(set(words)) / n,
    }
    return [f"\0{name} {round(2 * np.log2(share + 2**-10))}" for name, share in shares.items()]


def word_ids(text: str | None) -> np.ndarray:
    """Distinct hashed words of the whole text, in lower case, and its shape."""
    words = set(_WORD.findall((text or "").lower())) | set(shape(text or ""))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) & (DIM - 1) for w in words), np.int64, len(words)))


def _probability(score: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(score, -40, 40))))


def scaled(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores s probabilities of y, with targets short of 0 and 1 by the classes' counts; (1, 0) without both classes."""
    n = [int((y == k).sum()) for k in (0, 1)]
    if not min(n):
        return 1.0, 0.0
    aim, x, w = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)), np.column_stack([s, np.ones(len(s))]), weight / weight.sum()
    p, ridge = np.array([1.0, 0.0]), np.diag([1e-4, 1e-6])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - aim)) + ridge @ (p - [1.0, 0.0]))
        p = p - np.clip(step, -2, 2)
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


class Linear:
    """Logistic regression on word presence (only words seen in several texts) and dense extras, with a weight for each text."""

    def __init__(self, texts: list[np.ndarray], extra: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        n, k = len(texts), extra.shape[1]
        weight = np.ones(n) if weight is None else weight
        self.w, self.v, self.b = np.zeros(DIM), np.zeros(k), 0.0
        share = float(y.mean()) if n else 0.0
        self.flat = None if 0 < share < 1 else share
        if self.flat is not None:
            return
        rows = np.repeat(np.arange(n), [len(t) for t in texts])
        cols = np.concatenate(texts) if n else np.empty(0, np.int64)
        # Evidence of a word: the excess of its texts over its share of them, kept where it is significant. Rare words tell
        # nothing, and texts of the same words count once, or a word of one text with many copies would tell much.
        seen: set[bytes] = set()
        once = np.array([(same := t.tobytes()) not in seen and not seen.add(same) for t in texts], bool)[rows]
        total = np.bincount(cols[once], minlength=DIM)
        hit = np.bincount(cols[once], weights=y[rows[once]], minlength=DIM)
        expect = total * share
        z = (hit - expect) / np.sqrt(expect * (1 - share) + 1)
        self.use = (total >= 5) & (np.abs(z) >= 4)
        used, keep = np.flatnonzero(self.use), self.use[cols]
        rows, cols, m = rows[keep], np.searchsorted(used, cols[keep]), len(used)
        w, self.b = np.zeros(m), np.log(share / (1 - share))
        g2w, g2v, g2b = np.full(m, 1e-8), np.full(k, 1e-8), 1e-8
        weight = weight / weight.sum()
        for _ in range(EPOCHS):
            s = np.bincount(rows, weights=w[cols], minlength=n) + extra @ self.v + self.b
            err = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight
            gw = np.bincount(cols, weights=err[rows], minlength=m) + PENALTY * w / n**0.5
            gv, gb = extra.T @ err + PENALTY * self.v, err.sum()
            g2w, g2v, g2b = g2w + gw * gw, g2v + gv * gv, g2b + gb * gb
            w -= RATE * gw / np.sqrt(g2w)
            self.v -= RATE * gv / np.sqrt(g2v)
            self.b -= RATE * gb / np.sqrt(g2b)
        self.w[used] = w

    def score(self, ids: np.ndarray, extra: np.ndarray) -> float:
        if self.flat is not None:
            return 30.0 if self.flat else -30.0
        return float(np.clip(self.w[ids].sum() + extra @ self.v + self.b, -30, 30))

    def packed(self) -> dict:
        used = np.flatnonzero(self.w)
        return {"at": used, "w": self.w[used].astype(np.float32), "v": self.v, "b": self.b, "flat": self.flat}


class Chain:
    def __init__(self, names: list[str], ids: list[int], texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray | None = None):
        """labels: one column per category, NaN where unknown; weight: how many documents of the corpus each one stands for."""
        self.names, self.models, self.scales = names, [], []
        weight = np.ones(len(texts)) if weight is None else weight
        fold = np.array([xxhash.xxh3_64_intdigest(str(i)) % FOLDS for i in ids], np.int64)
        extra = np.zeros((len(texts), 0))
        for c in range(len(names)):
            y = labels[:, c] if len(texts) else np.empty(0)
            known = ~np.isnan(y)
            self.models.append(self._fit(texts, extra, y, known, weight))
            score = np.zeros(len(texts))
            for f in range(FOLDS):
                part = self._fit(texts, extra, y, known & (fold != f), weight)
                for i in np.flatnonzero(fold == f):
                    score[i] = part.score(texts[i], extra[i])
            slope, offset = scaled(score[known], y[known], weight[known]) if self.models[-1].flat is None else (1.0, 0.0)
            self.scales.append((slope, offset))
            extra = np.column_stack([extra, [_probability(slope * s + offset) for s in score]])

    @staticmethod
    def _fit(texts, extra, y, rows, weight) -> Linear:
        at = np.flatnonzero(rows)
        return Linear([texts[i] for i in at], extra[at], y[at], weight[at])

    def predict(self, text: str | None) -> list[float]:
        ids, extra, out = word_ids(text), np.empty(0), []
        for m, (slope, offset) in zip(self.models, self.scales, strict=True):
            out.append(m.flat if m.flat is not None else _probability(slope * m.score(ids, extra) + offset))
            extra = np.append(extra, out[-1])
        return out


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Chain from labelled documents; the sample, SAMPLE per class of the last category on average, bounds what is broadcast."""
    names = [n for n, _ in chain]
    target = F.expr(chain[-1][1])
    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__i"), *[F.expr(e).cast("double").alias(f"__y{k}") for k, (_, e) in enumerate(chain)], target.alias("__t"))
    sizes = {r["__t"]: r["count"] for r in marks.groupBy("__t").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "__i"), F.lit(1 << 30)) / float(1 << 30)
    want = F.when(F.col("__t"), draw < min(1.0, SAMPLE / max(1, sizes.get(True, 0)))).otherwise(F.coalesce(~F.col("__t"), F.lit(False)) & (draw < min(1.0, SAMPLE / max(1, sizes.get(False, 0)))))
    rows = docs.select(F.col(f"`{id_col}`").alias("__d"), F.col(f"`{text_col}`").alias("__x")).join(F.broadcast(marks.where(want)), F.col("__d") == F.col("__i"))

    def words(texts):
        return ([word_ids(t).astype(np.int32).tobytes() for t in texts],)

    found = map_docs(rows, words, ["__x"], "__w binary", ["__i", "__t", *[f"__y{k}" for k in range(len(chain))]]).collect()
    found = sorted(found, key=lambda r: (r["__i"], bytes(r["__w"])))
    share = {t: min(1.0, SAMPLE / max(1, sizes.get(t, 0))) for t in (True, False)}
    weight = np.array([1 / share[bool(r["__t"])] for r in found], np.float64)
    y = np.array([[np.nan if r[f"__y{k}"] is None else r[f"__y{k}"] for k in range(len(chain))] for r in found], np.float64).reshape(-1, len(chain))
    return Chain(names, [r["__i"] for r in found], [np.frombuffer(r["__w"], np.int32).astype(np.int64) for r in found], y, weight)


def classify(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """Adds p_<category> (double) for each category and <category>_pred (boolean, probability >= MARGIN)."""
    names = model.names
    added = [f"p_{n}" for n in names] + [f"{n}_pred" for n in names]
    docs = without(docs, *added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers per category

    def run(texts):
        p = [shared.value.predict(t) for t in texts]
        cols = [[row[k] for row in p] for k in range(len(names))]
        return cols + [[x >= MARGIN for x in c] for c in cols]

    return map_docs(docs, run, [text_col], ", ".join([f"p_{n} double" for n in names] + [f"{n}_pred boolean" for n in names]))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).drop("text")
