"""Substring dedup by level-wise doubling of repeated word windows.

A level has windows of one length: a quarter of the wanted length, half of it, all of it. Of a level
below the last only anchors are looked at: the smallest hash among the short windows of each full
window, so that equal full windows have equal anchors. Only full windows whose anchor repeats in
another document are extended to anchors of twice the length, until the wanted length; a level at
which nothing repeats leaves nothing to extend. `longest_repeats` goes on doubling from the wanted
length until no window survives.

Documents are dealt into batches by a hash of the id. A batch sends each of its windows once, with
its smallest id, however many of its documents hold it, and is told which of them other batches hold
too. So a window that a third of all documents share is one row for each batch, never one for each
document. Windows are equal when 96 bits of hash are, from two unlike polynomials over word hashes;
the second 32 go back to the batches only for a first half that has two of them.

Defined results: null or empty text has no words and stays as it is; rows with a null id are never
matched nor changed; rows that share an id do not remove each other's words; texts of any length are
taken whole; ids are integers; an input column named like an output column gives way; an empty table
gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, emit, map_docs, opened, sealed, signed, sliding_min, window_hashes, without, word_hashes

_PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
#: Bytes of input files that make a batch of documents.
BATCH_BYTES = 8 << 20
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def levels(n: int) -> list[int]:
    """Window lengths of the levels: each is twice the one before (or one less), the last is n."""
    out = [n]
    while len(out) < 3 and out[0] > 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Batch:
    """The documents of a batch by ascending id, their words one after another, and the places where windows of n words start."""

    def __init__(self, table: pa.Table, n: int):
        self.table = table.take(np.argsort(table["id"].to_numpy(), kind="stable"))
        self.words = [(b or b"").split() for b in self.table["body"].to_pylist()]
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.h = word_hashes([w for words in self.words for w in words])
        self.n = n
        starts = np.arange(len(self.h)) + n <= np.repeat(self.edges[1:], sizes)
        self.at = np.flatnonzero(starts)
        self.ids = np.repeat(self.table["id"].to_numpy(), sizes)[self.at]

    def anchors(self, size: int) -> np.ndarray:
        """For each window, the hash of size words that equal windows share; at the full size its own."""
        return sliding_min(window_hashes(self.h, size), self.n - size + 1)[self.at] if len(self.at) else self.h[:0]

    def checks(self) -> np.ndarray:
        """The second part of each window's bits."""
        if not len(self.at):
            return np.empty(0, np.uint32)
        return (window_hashes(self.h ^ (self.h >> np.uint64(23)) * _CHECK, self.n)[self.at] >> np.uint64(32)).astype(np.uint32)

    def repeated(self, keys: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Of the windows' keys, sorted: those that other batches hold (told), or two ids of this one."""
        order = np.argsort(keys, kind="stable")  # ids ascend among equal keys
        k, ids = keys[order], self.ids[order]
        return np.union1d(told, k[1:][(k[1:] == k[:-1]) & (ids[1:] != ids[:-1])])


def _firsts(keys: np.ndarray, ids: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Distinct keys (and checks) with the smallest id of each; ids ascend."""
    order = np.argsort(keys, kind="stable")
    k, new = keys[order], np.ones(len(keys), bool)
    new[1:] = k[1:] != k[:-1]
    if checks is not None:
        c = checks[order]
        new[1:] |= c[1:] != c[:-1]  # of two checks under one key, one may come twice, which does no harm
    order = np.sort(order[new])  # rows of one id side by side make smaller shuffle files
    return (keys[order], ids[order]) if checks is None else (keys[order], checks[order], ids[order])


def _told(table: pa.Table, name: str = "w") -> np.ndarray:
    return table[name].to_numpy().view(np.uint64)


def _batch_of(id_: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(batches))


def _level(dealt: DataFrame, before: DataFrame | None, sizes: list[int], step: int, n: int) -> DataFrame:
    """(w, c, lo): what each batch sends at a level; before: (batch, w) of the level below that other batches hold too."""
    size, below = sizes[step], sizes[step - 1] if step else 0
    last = size == n

    def sent(docs: pa.Table, told: np.ndarray | None) -> pa.Table:
        b = Batch(docs, n)
        alive = np.ones(len(b.at), bool)
        if told is not None:
            keys = b.anchors(below)
            alive = _among(keys, b.repeated(keys, told))
        keys, ids, checks = b.anchors(size)[alive], b.ids[alive], b.checks()[alive] if last else None
        if not last:  # neighbours mostly have the same anchor
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[new], ids[new]
        k, *c, lo = _firsts(keys, ids, checks)
        return pa.table({"w": signed(k), **({"c": c[0].view(np.int32)} if last else {}), "lo": lo})

    schema = "w long, c int, lo long" if last else "w long, lo long"
    if before is None:
        return dealt.groupBy("batch").applyInArrow(lambda docs: sent(docs, None), schema)
    return dealt.groupBy("batch").cogroup(before.groupBy("batch")).applyInArrow(lambda docs, told: sent(docs, _told(told)), schema)


def _shared(rows: DataFrame, batches: int) -> DataFrame:
    """(batch, w): the keys of each batch that another batch holds too."""
    many = rows.withColumn("k", F.count("*").over(Window.partitionBy("w"))).where("k > 1")
    return many.select(_batch_of(F.col("lo"), batches).alias("batch"), "w")


def _earlier(rows: DataFrame, batches: int) -> DataFrame:
    """(batch, w, c): the full windows of each batch that a smaller id of another batch holds; c is null where w says it all."""
    of_w, of_both = Window.partitionBy("w"), Window.partitionBy("w", "c")
    known = rows.repartition("w").withColumn("least", F.min("lo").over(of_both))  # one sort, by both, serves both windows
    least = known.withColumn("one", F.min("c").over(of_w) == F.max("c").over(of_w)).where("least < lo")
    return least.select(_batch_of(F.col("lo"), batches).alias("batch"), "w", F.when(~F.col("one"), F.col("c")).alias("c"))


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """(own, id, body, batch), in batches of about BATCH_BYTES, and the number of batches.

    Every level stands on this one exchange, which Spark reuses.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    batches = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 52) // BATCH_BYTES)
    return rows.where("id is not null").withColumn("batch", _batch_of(F.col("id"), batches)).repartition("batch"), batches


def _covered(bodies: list, words_of: list[list[bytes]], gone_of: list[np.ndarray]) -> tuple[list, list, list, list]:
    """n_words, n_removed, kept_words and the text without the words that are gone."""
    total, removed, kept, texts = [], [], [], []
    for body, words, gone in zip(bodies, words_of, gone_of, strict=True):
        total.append(len(words))
        n = int(np.count_nonzero(gone))
        removed.append(n)
        if n:
            left = (~gone).tolist()
            kept.append(b" ".join(itertools.compress(words, left)).decode())
            pieces = _PIECE.findall(body)
            head = body[: len(body) - sum(map(len, pieces))]
            texts.append((head + b"".join(itertools.compress(pieces, left))).decode())
        else:
            kept.append(b" ".join(words).decode())
            texts.append(None if body is None else body.decode())
    return total, removed, kept, texts


def _starts(b: Batch, told: pa.Table) -> np.ndarray:
    """Of the batch's windows, which a smaller id holds, in another batch (told) or in this one."""
    every = b.anchors(b.n)
    alone = told["c"].is_null().to_numpy()
    other = _told(told)
    lone, other, check = np.unique(other[alone]), other[~alone], told["c"].fill_null(0).to_numpy()[~alone].view(np.uint32)
    gone = _among(every, lone)
    some = np.flatnonzero(_among(every, b.repeated(every, np.unique(other))) & ~gone)
    if len(some):
        # Windows told of come first in their group.
        k, c = np.concatenate([other, every[some]]), np.concatenate([check, b.checks()[some]])
        mine = np.concatenate([np.zeros(len(other), np.int64), np.ones(len(some), np.int64)])
        ids = np.concatenate([np.zeros(len(other), np.int64), b.ids[some]])
        order = np.lexsort((ids, mine, c, k))
        k, c = k[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = np.empty(len(order), bool)
        hit[order] = (mine[first] == 0) | (ids[first] < ids[order])
        gone[some] = hit[len(other) :]
    return gone


def _gone(b: Batch, told: pa.Table) -> list[np.ndarray]:
    """Per document, which words are covered."""
    edge = np.zeros(len(b.h) + 1, np.int64)
    at = b.at[_starts(b, told)]
    edge[at] += 1
    edge[at + b.n] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return [covered[lo:hi] for lo, hi in zip(b.edges[:-1], b.edges[1:], strict=True)]


def dedup_substrings(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of n words that also starts in a document with a smaller id.

    Adds n_words, n_removed (long), kept_words (kept words joined by one space) and rewrites the text
    column: kept words stay with the white space that followed them.
    """
    docs = without(docs, "n_words", "n_removed", "kept_words")
    rows = sealed(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    rows = rows.select("own", F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("body"))
    dealt, batches = _dealt(rows)
    sizes, alive = levels(n), None
    for step in range(len(sizes) - 1):
        alive = _shared(_level(dealt, alive, sizes, step, n), batches)
    hits = _earlier(_level(dealt, alive, sizes, len(sizes) - 1, n), batches)
    added = T._parse_datatype_string("n_words long, n_removed long, kept_words string, text string")
    schema = T.StructType([rows.schema["own"], rows.schema["id"], *added.fields])

    def cover(docs: pa.Table, told: pa.Table) -> pa.Table:
        b = Batch(docs, n)
        out = _covered(b.table["body"].to_pylist(), b.words, _gone(b, told))
        columns = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.Table.from_arrays([b.table["own"], b.table["id"], *columns], names=schema.names)

    named = dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(cover, schema)

    def untouched(bodies):
        words = [(b or b"").split() for b in bodies]
        return _covered(bodies, words, [np.zeros(0, bool)] * len(words))

    nameless = map_docs(rows.where("id is null"), untouched, ["body"], "n_words long, n_removed long, kept_words string, text string", ["own", "id"])
    out = named.unionByName(nameless)
    return opened(out, docs.columns, {id_col: F.col("id").cast(kind), text_col: F.col("text")}, *[F.col(c) for c in ("n_words", "n_removed", "kept_words")])


def longest_repeats(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): per document the largest n * 2**k of which a window repeats elsewhere; documents without one are left out."""
    keyed = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))

    def windows(ids, bodies, alive, size):
        for i, body, live in zip(ids, bodies, alive, strict=True):
            h = word_hashes((body or b"").split())
            if len(h) >= size:
                w = window_hashes(h, size)
                if live is not None:
                    ok = np.isin(signed(window_hashes(h, size // 2)), np.array(live, np.int64))
                    w = w[ok[: len(w)] & ok[size // 2 :]]
                w = np.unique(w)
                yield signed(w), np.full(len(w), i, np.int64)

    def repeated(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w")
        return cut(rows.join(least, "w").groupBy("id").agg(F.collect_set("w").alias("alive")))

    first = emit(keyed, lambda ids, bodies: windows(ids, bodies, [None] * len(ids), n), ["id", "body"], "w long, id long")
    alive, size, best = repeated(first), n, None
    while not alive.isEmpty():
        level = alive.select("id", F.lit(size).cast("long").alias("words"))
        best = level if best is None else cut(best.unionByName(level))
        size *= 2
        alive = repeated(emit(keyed.join(alive, "id"), lambda i, b, a, size=size: windows(i, b, a, size), ["id", "body", "alive"], "w long, id long"))
    if best is None:
        best = alive.select("id", F.lit(0).cast("long").alias("words"))
    return best.groupBy(F.col("id").alias(id_col)).agg(F.max("words").alias("words"))


def query(spark, sf_dir):
    from .common import table

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))
