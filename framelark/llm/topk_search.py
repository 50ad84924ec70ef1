"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are held vertically, one row per block of dimensions. Partial scores of a tile of queries and
candidates grow block by block of dimensions; a pair whose partial score plus the bound |rest of
query| * |rest of candidate| (Cauchy-Schwarz) lies below the query's k-th best score so far is out.
Candidates that no query of the tile wants any more, and queries that want none, are compacted away.
Ties with the k-th best survive, as the smaller id wins.

Queries are handled in blocks of at most `block` rows: a block is what is broadcast, and the only
vectors that the driver ever holds. Each block makes one pass over the candidates, and a task keeps k
rows per query; of several blocks each is done, and its broadcast gone, before the next. Scores are
integers: exact in float64 while dim * max|q| * max|x| < 2**53, else in Python integers.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; empty vectors score 0; vectors meet only vectors of their own length; a candidate
with the query's own id is left out; repeated rows count as often as they occur as candidates and
once as a query; fewer than k candidates give all; a score must fit a long; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
DIMS = 8
BLOCK = 8192
#: Candidates and queries of a tile: two matrices of these sizes are held at a time.
_ROWS, _QUERIES = 4096, 512


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))


def quantised(vectors: list) -> np.ndarray:
    x = np.floor(np.array(vectors, np.float64) * SCALE)
    return x if x.size == 0 or np.abs(x).max() ** 2 * x.shape[1] < 2**52 else np.array([[int(c) for c in row] for row in x.tolist()], object)


def _tails(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of each row's components from each block edge on, rounded up."""
    squares = x.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, e:].sum(1)) * (1 + 1e-9) for e in edges])


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, best: list, k: int) -> None:
    """Merge the candidates x into best: per query a list of (-score, id), sorted, at most k."""
    edges = [*range(0, x.shape[1], DIMS)]
    spread = np.argsort(-x.astype(np.float64).var(0), kind="stable")  # dimensions that tell most come first
    vertical = np.ascontiguousarray(x[:, spread].T)
    rest = _tails(vertical.T, edges)
    for at in range(0, len(q), _QUERIES):
        mine = np.ascontiguousarray(q[at : at + _QUERIES, spread])
        floor = np.array([-float(b[-1][0]) if len(b) >= k else -np.inf for b in best[at : at + _QUERIES]]) - 0.5
        _search_tile(mine, qid[at : at + _QUERIES], vertical, xid, rest, edges, floor, best[at : at + _QUERIES], k)


def _search_tile(q, qid, vertical, xid, rest, edges, floor, best, k) -> None:
    """One tile; best holds the lists of its queries, which are changed in place."""
    queries, rows = np.arange(len(q)), np.arange(len(xid))
    qrest, score = _tails(q, edges), None
    due = gap = 1  # bounds that shut out little are looked at less and less often
    for b, e in enumerate(edges):
        part = q[queries, e : e + DIMS] @ vertical[e : e + DIMS, rows]
        score = part if score is None else score + part
        if due <= b + 1 < len(edges) and np.isfinite(floor[queries]).any():
            alive = score.astype(np.float64) + qrest[b + 1, queries][:, None] * rest[b + 1, rows][None, :] >= floor[queries][:, None]
            some, wanted = alive.any(1), alive.any(0)
            if some.sum() * wanted.sum() < 0.8 * alive.size:
                queries, rows, score = queries[some], rows[wanted], score[np.ix_(some, wanted)]
            else:
                due, gap = b + 1 + gap, 2 * gap
            if not score.size:
                return
    level = score.astype(np.float64)
    if level.shape[1] > k:  # what is below a query's k-th best of this tile alone need not be merged either
        level = np.where(xid[rows][None, :] == qid[queries][:, None], -np.inf, level)
        cutoff = np.maximum(floor[queries], np.partition(level, level.shape[1] - k, axis=1)[:, -k])
    else:
        cutoff = floor[queries]
    at, hit = np.nonzero(level >= cutoff[:, None])
    found: dict[int, list] = defaultdict(list)
    for i, s, v in zip(at.tolist(), score[at, hit].tolist(), xid[rows[hit]].tolist(), strict=True):
        found[i].append((-int(s), v))
    for i, new in found.items():
        own = qid[queries[i]]
        best[queries[i]][:] = sorted([*best[queries[i]], *(x for x in new if x[1] != own)])[:k]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product."""
    from .common import cut

    spark = queries.sparkSession
    pool = usable(candidates, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).distinct()
    salt = F.xxhash64("id")
    total = asked.count()
    parts = max(1, -(-total * 5 // (4 * block)))  # by a hash, so blocks are about four fifths full
    asked = cut(asked.withColumn("part", F.pmod(salt, F.lit(parts)))) if parts > 1 else asked.withColumn("part", F.lit(0))
    found = None
    for p in range(parts):
        rows = asked.where(F.col("part") == p).select("id", "v").collect()  # a bounded block of the stated queries
        by_dim = defaultdict(list)
        for r in rows:
            by_dim[len(r["v"])].append((r["id"], r["v"]))
        held = {d: (np.array([i for i, _ in rs], np.int64), quantised([v for _, v in rs])) for d, rs in by_dim.items()}
        shared = spark.sparkContext.broadcast(held)

        def scan(batches, shared=shared):
            import pyarrow as pa

            held = shared.value
            best = {d: [[] for _ in ids] for d, (ids, _) in held.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    b = batch.slice(at, _ROWS)
                    ids, lists = b.column(0).to_numpy(), b.column(1)
                    dims = np.asarray(lists.value_lengths())
                    for d in held.keys() & set(dims.tolist()):
                        mine = np.flatnonzero(dims == d)
                        values = lists.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), d)
                        x = quantised(values)
                        q = held[d][1]
                        if q.dtype != x.dtype or x.dtype != object and x.size and q.size and np.abs(x).max() * np.abs(q).max() * d >= 2**52:
                            q, x = (np.array([[int(c) for c in row] for row in m.tolist()], object) for m in (q, x))
                        if d:
                            search_block(q, held[d][0], x, ids[mine], best[d], k)
                        else:
                            for i, own in enumerate(held[d][0]):
                                best[d][i] = sorted([*best[d][i], *((0, j) for j in ids[mine].tolist() if j != own)])[:k]
            out = [(int(own), i, -s) for d, (ids, _) in held.items() for own, found in zip(ids, best[d], strict=True) for s, i in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

        near = pool.mapInArrow(scan, "query_id long, vec_id long, score long")
        if parts > 1:
            near = cut(near)
            shared.destroy()
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    from .common import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
