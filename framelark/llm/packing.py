"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

A length is between 1 and the capacity, so the whole corpus has at most `capacity` distinct lengths:
the driver plans bins on (length, count) rows alone. Large-item matching: pieces above a third of the
capacity go at most two to a bin, each with the largest partner that still fits, longest first. Then
smaller lengths, longest first, go to the tightest gap that holds them; what fits no gap opens new
bins. A plan row places a run of equal pieces into a run of equal bins, so the plan's size depends on
the capacity, not on the corpus. Pieces find their place by their rank within their length, counted
over sub-buckets of about BUCKET pieces, however common a length is, and a range lookup in the plan.

Defined results: null or empty text is one piece holding the end id alone; rows with the same id are
packed one by one (their pieces are interchangeable); a piece of full capacity is a bin of its own;
texts of any length are tokenised whole; a kept column named like an output column gives way; empty
tables give no rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_docs

CAPACITY = 2048
#: Pieces of one length that are ranked in one task, about.
BUCKET = 500


@lru_cache(2)
def encoder(path: str):
    """Byte-level BPE of a tokenizers file, run by tiktoken: the same ids (tested), at five times the speed."""
    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    byte_of = {c: b for b, c in _byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies show printable bytes as themselves and the rest as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text, then id 0."""
    try:
        ids = encoder(path).encode(text or "", allowed_special="all")
    except ValueError:  # its pattern engine refuses runs of about a million white spaces; the library itself does not
        ids = _library(path).encode(text, add_special_tokens=False).ids
    return np.array([*ids, 0], np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int, text_col: str, keep: list[str]) -> DataFrame:
    """One row per piece: (own: the kept columns, piece, start, length, ids_crc32); only documents above the capacity are cut."""

    def tokenised(texts):
        out = []
        for text in texts:
            ids = token_ids(text, path)
            head = len(ids) % capacity or capacity
            at = [0, *range(head, len(ids), capacity)] if len(ids) > capacity else [0]
            ends = [*at[1:], len(ids)]
            out.append([(k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(at, ends, strict=True))])
        return ([[dict(zip(("piece", "start", "length", "ids_crc32"), p, strict=True)) for p in doc] for doc in out],)

    own = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = docs.select(own.alias("own"), F.col(f"`{text_col}`").alias("text"))
    return map_docs(rows, tokenised, ["text"], "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>", ["own"]).select("own", F.inline("pieces"))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, first_bin, per_bin, offset): pieces of that length and rank range
    go, per_bin at a time, into consecutive bins from first_bin on, at that offset and the next ones."""
    left, used, plan = dict(counts), defaultdict(int), []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first bin, bins)
    bins = 0

    def place(length: int, n_bins: int, first_bin: int, per_bin: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n_bins * per_bin - 1, first_bin, per_bin, offset))
        used[length] += n_bins * per_bin
        left[length] -= n_bins * per_bin

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        top = large[-1]
        if not left[top]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - top) - 1
        while k >= 0 and (not left[large[k]] or large[k] == top and left[top] < 2):
            k -= 1
        mate = large[k] if k >= 0 else 0
        n = left[top] if not mate else left[top] // 2 if mate == top else min(left[top], left[mate])
        place(top, n, bins, 2 if mate == top else 1, 0)
        if mate and mate != top:
            place(mate, n, bins, 1, top)
        gaps[capacity - top - mate].append((bins, n))
        bins += n
    for size in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        open_gaps = sorted(g for g in gaps if g >= size and gaps[g])
        while left[size] and open_gaps:
            gap = open_gaps[0]
            first, n = gaps[gap].pop()
            # The tightest gap takes one, is then tighter still and so takes the next, until none fits.
            per = gap // size
            full = min(n, left[size] // per)
            if full:
                place(size, full, first, per, capacity - gap)
                gaps[gap - per * size].append((first, full))
            if full < n:
                part = left[size] if left[size] < per else 0
                if part:
                    place(size, 1, first + full, part, capacity - gap)
                    gaps[gap - part * size].append((first + full, 1))
                rest = n - full - bool(part)
                if rest:
                    gaps[gap].append((first + full + bool(part), rest))
            if not gaps[gap]:
                open_gaps.pop(0)
        per = capacity // size
        if n := left[size] // per:
            place(size, n, bins, per, 0)
            gaps[capacity - per * size].append((bins, n))
            bins += n
        if n := left[size]:
            place(size, 1, bins, n, 0)
            gaps[capacity - n * size].append((bins, 1))
            bins += 1
    return plan


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the kept columns, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    keep = [c for c in (keep or [id_col]) if c.lower() not in {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"}]
    rows = cut(pieces(docs, path, capacity, text_col, keep))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = spark.createDataFrame([(x, -(-n // BUCKET)) for x, n in counts.items()], "length long, buckets long")
    rows = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("own", "piece", "ids_crc32"), "buckets"))
    groups = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    groups = cut(groups.select("length", "bucket", before.alias("before")))
    plan = spark.createDataFrame(plan_bins(counts, capacity), "length long, r0 long, r1 long, bin0 long, per long, off0 long")
    within = Window.partitionBy("length", "bucket").orderBy("own", "piece", "ids_crc32")
    ranked = rows.withColumn("k", F.row_number().over(within) - 1).join(groups, ["length", "bucket"]).withColumn("r", F.col("before") + F.col("k"))
    runs = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("r0", "r1", "bin0", "per", "off0"))).alias("runs"))
    placed = ranked.join(F.broadcast(runs), "length").withColumn("run", F.filter("runs", lambda x: (x.r0 <= F.col("r")) & (F.col("r") <= x.r1))[0])
    nth = F.col("r") - F.col("run.r0")
    return placed.select(
        *[F.col("own")[c].alias(c) for c in keep], "piece", "start", "length", "ids_crc32",
        (F.col("run.bin0") + F.floor(nth / F.col("run.per"))).cast("long").alias("sequence_id"),
        (F.col("run.off0") + F.pmod(nth, F.col("run.per")) * F.col("length")).cast("long").alias("offset"),
    )


def query(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path("byte_bpe_50k.json"))
