"""Language identification by nearest centroids of TF-IDF byte n-gram vectors.

A text becomes hashed counts of byte 2- and 3-grams of its lower-cased letters (within a word and across its
ends), damped by log, weighted by inverse document frequency and normalised. Each language has up
to CENTROIDS clusters (spherical k-means); a text takes the language of the centroid with the highest
cosine. Distance-based rejection: below the REJECT quantile of that centroid's own training cosines
the row is marked rejected (lang_pred still names the nearest language).

Training uses a bounded sample: about PER_LANG labelled documents per language, drawn by a hash of the
id. Every language is learned; each one's clusters are found in one task from its own sample. The driver
and the workers hold the centroids of about BLOCK languages at a time: where there are more, they stay in
a table in the shared folder, and every text meets one block of them after the other and keeps the
nearest. Texts are always taken whole.

Defined results: null text or text without a letter is `und` with score 0; null languages are not
learned; without any learned language everything is `und`; repeated rows are predicted alike; an
input column named like an output column gives way; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_docs, small, without

DIM = 1 << 12
CENTROIDS, PER_LANG, REJECT, ROUNDS = 4, 300, 0.001, 12
#: Languages of a block, whose centroids take 128 KB each.
BLOCK = 256
_LETTER = re.compile(r"[^\W\d_]")
_PART = 1 << 20
#: ASCII other than letters separates words; other bytes stay.
_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of byte 2- and 3-grams of the whole text."""
    letters = text.lower().encode().translate(_SPACED).split()
    b = np.frombuffer(b" " + b" ".join(letters) + b" ", np.uint8)
    out = np.zeros(DIM)
    for at in range(0, len(b), _PART):
        x = b[at : at + _PART + 2].astype(np.uint32)
        two = x[:-1] * np.uint32(251) + x[1:]
        three = two[:-1] * np.uint32(31337) + x[2:] * np.uint32(2654435761 % 2**32)
        # Of a later part's start, the 2-gram that the part before has already counted is left out.
        two = two[: _PART] if at + _PART < len(b) else two
        three = three[: _PART]
        for g, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            out += np.bincount(((g * np.uint32(salt)) >> np.uint32(20)).astype(np.int64), minlength=DIM)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def clusters(x: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Centroids of one language's vectors by spherical k-means, each with the cosine below which it rejects."""
    c = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = _unit(np.array([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))]))
    cosine = x @ c.T
    of = cosine.argmax(1)
    return [(c[k], float(np.quantile(cosine[of == k, k], REJECT)) * 0.8) for k in range(len(c)) if (of == k).any()]


class Centroids:
    """The fitted model: idf, centroids, their languages and rejection cosines."""

    def __init__(self, idf: np.ndarray, found: list[tuple[str, np.ndarray, float]]):
        self.idf, self.of = idf, [lang for lang, _, _ in found]
        self.centres, self.least = np.array([c for _, c, _ in found]).reshape(-1, DIM), np.array([least for _, _, least in found])

    def parts(self) -> Iterator[Centroids]:
        yield self

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language of the nearest centroid (the smaller one's on ties), its cosine, and whether it rejects the text."""
        if not text or not self.of or not _LETTER.search(text):
            return "und", 0.0, True
        cosine = self.centres @ vectors(gram_counts(text), self.idf)
        k = int(cosine.argmax())
        return self.of[k], float(cosine[k]), bool(cosine[k] < self.least[k])


class Blocks:
    """A model of more languages: its table of centroids (l, k, c, least, part), of which one part at a time comes to the driver."""

    def __init__(self, idf: np.ndarray, table: DataFrame, n: int):
        self.idf, self.table, self.n = idf, table, n

    def parts(self) -> Iterator[Centroids]:
        for part in range(self.n):
            yield _centroids(self.idf, self.table.where(F.col("part") == part))


def _centroids(idf: np.ndarray, rows: DataFrame) -> Centroids:
    found = rows.select("l", "k", "c", "least").collect()  # CENTROIDS * DIM numbers for each language of a block
    return Centroids(idf, [(r["l"], np.frombuffer(r["c"]), r["least"]) for r in sorted(found, key=lambda r: (r["l"], r["k"]))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids | Blocks:
    """Model from labelled rows, PER_LANG per language on average."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").alias("l"), F.col(f"`{text_col}`").alias("t")).where("l is not null and t is not null")
    sizes = cut(labelled.groupBy("l").agg(F.count("*").alias("n")))
    languages = sizes.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "i", F.length("t")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(small(sizes, languages, 200), "l").where(draw < PER_LANG / F.col("n"))

    def features(texts):
        return ([gram_counts(t).astype(np.uint32).tobytes() if _LETTER.search(t) else None for t in texts],)

    rows = cut(map_docs(sample, features, ["t"], "g binary", ["i", "l"]).where("g is not null"))

    def document_counts(batches):
        total = np.zeros(DIM + 1, np.int64)
        for b in batches:
            for g in b.column(0).to_pylist():
                total[:DIM] += np.frombuffer(g, np.uint32) > 0
                total[DIM] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(total)], names=["at", "n"])

    found = rows.select("g").mapInArrow(document_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # DIM + 1 numbers
    n = np.zeros(DIM + 1)
    for r in found:
        n[r["at"]] = r["n"]
    idf = np.log((1 + n[DIM]) / (1 + n[:DIM])) + 1

    def learn(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["i"].to_pylist(), table["g"].to_pylist(), strict=True), key=lambda r: (str(r[0]), r[1]))
        some = clusters(vectors(np.array([np.frombuffer(g, np.uint32) for _, g in order], np.float64), idf))
        return pa.table({"l": [table["l"][0].as_py()] * len(some), "k": pa.array(range(len(some)), pa.int32()), "c": [c.tobytes() for c, _ in some], "least": [least for _, least in some]})

    made = rows.groupBy("l").applyInArrow(learn, "l string, k int, c binary, least double")
    if languages <= BLOCK:
        return _centroids(idf, made)
    n = -(-languages * 5 // (4 * BLOCK))  # by a hash, so blocks are about four fifths full
    return Blocks(idf, cut(made.withColumn("part", F.pmod(F.xxhash64("l"), F.lit(n)))), n)


def _nearer(new: tuple, old: tuple) -> tuple:
    return new if (-new[1], new[0]) < (-old[1], old[0]) else old


def identify(docs: DataFrame, model: Centroids | Blocks, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (string), score (double, 0 to 1) and rejected (boolean)."""
    added = ("lang_pred", "score", "rejected")
    docs, before = without(docs, *added), None
    names = docs.columns
    for part in model.parts():
        if before:
            docs = cut(docs)  # what the block before has found; its centroids can go
            before.unpersist()
        docs, before = _against(docs, part, text_col, before is not None)
    return docs.select(*[F.col(f"`{c}`") for c in names], "lang_pred", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), "rejected")


def _against(docs: DataFrame, part: Centroids, text_col: str, later: bool):
    """docs with what one block says, or the nearer of that and what docs say already; and the broadcast of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(part))  # the centroids of about BLOCK languages
    held = {}

    def run(texts, *found):
        if "m" not in held:
            held["m"] = pickle.loads(shared.value)
        new = [held["m"].predict(t) for t in texts]
        if found:
            new = [_nearer(n, o) for n, o in zip(new, zip(*found, strict=True), strict=True)]
        return list(zip(*new, strict=True)) if new else [[], [], []]

    inputs = [text_col, "lang_pred", "score", "rejected"] if later else [text_col]
    return map_docs(docs, run, inputs, "lang_pred string, score double, rejected boolean"), shared


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", out)
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
