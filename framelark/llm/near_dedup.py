"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has BLOCKS x WIDTH symbols of 16 bits. Two signatures that differ in at most
BLOCKS * (ERRORS + 1) - 1 symbols agree in some block up to ERRORS symbols (pigeonhole), so indexing
each block under every way of leaving out ERRORS symbols finds all pairs under that distance: 23 of
72 symbols. At similarity 0.8 a pair differs in 14.4 symbols on average, and a pair beyond 23 is
still met unless all 12 blocks miss, 3 times in a million.

Equal shingle sets are one class first, so copies never meet in a bucket. Pairs within a bucket are
not listed: members are compared with the bucket's hub, then those that are not in the hub's component
with all members of the hub, in blocks of bounded size. Links are confirmed on full shingle sets; no
pair that meets is dropped because its signatures are far apart.

Defined results: null text or text without words has no shingles and is linked with nothing; a text
with fewer words than a shingle is one shingle; rows with a null id are kept and linked with nothing;
rows that share an id share a component, and stay or go together; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_tasks, map_docs, mixed, signed, window_hashes, word_hashes
from .components import components

BLOCKS, WIDTH, ERRORS = 12, 6, 1
SYMBOLS = BLOCKS * WIDTH
#: Shingles on one side of a block of comparisons, about.
BLOCK_SHINGLES = 200_000
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 16


def shingle_set(body: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the lower-cased text."""
    words = (body or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(n, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _CHUNK):
        part = s[at : at + _CHUNK]
        for k, seed in enumerate(_SEEDS):
            low[k] = min(low[k], (part * seed ^ (part >> np.uint64(31)) * seed).min())
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


_LEFT_OUT = [(b, [b * WIDTH + i for i in range(WIDTH) if i not in gone]) for b in range(BLOCKS) for gone in combinations(range(WIDTH), ERRORS)]


def index_keys(sig: bytes) -> list[int]:
    """A key for each block and each choice of left-out symbols."""
    s = np.frombuffer(sig, np.uint16).astype(np.uint64)
    chosen = np.array([c for _, c in _LEFT_OUT])
    key = np.arange(1, len(_LEFT_OUT) + 1, dtype=np.uint64)
    for column in chosen.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[column])
    return signed(key).tolist()


def classes(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, sig) per document that has words: set size, set fingerprint, signature."""

    def features(bodies):
        n, h1, h2, sig = [], [], [], []
        for body in bodies:
            s = shingle_set(body, shingle)
            x = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            h1.append((x >> 64) - 2**63)
            h2.append((x & (2**64 - 1)) - 2**63)
            sig.append(signature(s).tobytes() if len(s) else None)
        return n, h1, h2, sig

    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return cut(map_docs(keyed, features, ["body"], "n long, h1 long, h2 long, sig binary", ["id"]))


def _confirm(pairs: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of (a, b): the pairs with 100 * intersection >= percent * union of their full sets."""
    left = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    both = left.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    kept = {"text": None, "set": None}

    def linked(texts_a, texts_b):
        out = []
        for x, y in zip(texts_a, texts_b, strict=True):
            if y != kept["text"]:  # rows come sorted by b
                kept.update(text=y, set=shingle_set(y, shingle))
            s, t = shingle_set(x, shingle), kept["set"]
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * common >= percent * (len(s) + len(t) - common))
        return (out,)

    return cut(map_docs(both, linked, ["body_a", "body_b"], "linked boolean", ["a", "b"]).where("linked").select("a", "b"))


def block_links(asked: list[np.ndarray], asked_in: np.ndarray, sets: list[np.ndarray], sets_in: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(i, j): asked[i] is linked with sets[j], which is in another component; one j for each i and component."""
    sizes = np.array([len(s) for s in sets])
    postings = np.concatenate(sets)
    order = np.argsort(postings, kind="stable")
    postings, of = postings[order], np.repeat(np.arange(len(sets)), sizes)[order]
    found = []
    for i, s in enumerate(asked):
        first = np.searchsorted(postings, s, "left")
        times = np.searchsorted(postings, s, "right") - first
        ends = np.cumsum(times)
        at = np.repeat(first - (ends - times), times) + np.arange(ends[-1])
        common = np.bincount(of[at], minlength=len(sets))
        near = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (sets_in != asked_in[i]))
        found += [(i, int(near[k])) for k in np.unique(sets_in[near], return_index=True)[1]]
    return found


def _left_over(stars: DataFrame, m: int, done: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of a hub (stars: hub, id, n, at most m rows) that its own links leave in different components.

    Two members in different components are not both in the hub's, so those outside of it are compared with
    all members of the hub, block by block: both sides are dealt by hash into blocks of about BLOCK_SHINGLES.
    """
    placed = few_tasks(stars.join(done.withColumnRenamed("node", "id"), "id", "left"), m).withColumn("c", F.coalesce("component", "id")).drop("component")
    placed = placed.join(done.select(F.col("node").alias("hub"), "component"), "hub", "left").withColumn("asks", F.col("c") != F.coalesce("component", "hub")).drop("component")
    placed = cut(few_tasks(placed, m))
    blocks = placed.groupBy("hub").agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("asks"), F.col("n"))).alias("ask_n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    blocks = blocks.where("c0 < c1").select("hub", F.expr(f"ceil(all_n / {BLOCK_SHINGLES})").cast("int").alias("of_all"), F.expr(f"ceil(ask_n / {BLOCK_SHINGLES})").cast("int").alias("of_asking"))
    dealt = placed.join(cut(blocks), "hub").join(bodies, "id")
    deal = F.xxhash64("id")
    every = dealt.select("hub", "id", "c", "body", F.lit(False).alias("asks"), F.pmod(deal, "of_all").alias("block"), F.explode(F.sequence(F.lit(0), F.col("of_asking") - 1)).alias("asking"))
    asking = dealt.where("asks").select("hub", "id", "c", "body", "asks", F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("block"), F.pmod(deal, "of_asking").alias("asking"))
    columns = ["hub", F.col("block").cast("int"), F.col("asking").cast("int"), "id", "c", "asks", "body"]

    def compare(rows: pa.Table) -> pa.Table:
        ids, c = rows["id"].to_numpy(), rows["c"].to_numpy()
        asks = rows["asks"].to_numpy().astype(bool)
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        links = []
        if len(x) and len(y):
            bodies = rows["body"].to_pylist()
            sets = [shingle_set(bodies[k], shingle) for k in y]
            links = block_links([shingle_set(bodies[k], shingle) for k in x], c[x], sets, c[y], percent)
        pairs = np.array([(ids[x[i]], ids[y[j]]) for i, j in links], np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cut(every.select(*columns).union(asking.select(*columns)).groupBy("hub", "block", "asking").applyInArrow(compare, "a long, b long"))


def link_classes(reps: DataFrame, keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the similarity graph over classes (id, n, sig); classes without a link don't appear.

    keyed: (id, body) of all documents, of which only those that meet another class are read on.
    """

    def keys(sig):
        return ([index_keys(s) for s in sig],)

    rows = map_docs(reps.select("id", "n", "sig"), keys, ["sig"], "keys array<long>", ["id", "n"]).select("id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    members = cut(rows.join(shared, "key"))
    m = members.count()
    members = few_tasks(members, m)
    # A bucket's hub is the member that meets most others over all its buckets: the text nearest to the group's middle.
    met = members.groupBy("id").agg(F.sum("met").alias("met"))
    known = few_tasks(members.drop("met").join(met, "id"), m)
    hubs = known.groupBy("key").agg(F.max(F.struct("met", -F.col("id"), "n")).alias("h"))
    hubs = hubs.select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    stars = cut(few_tasks(few_tasks(members.join(hubs, "key").where("id <> hub"), m).select("hub", "hub_n", "id", "n").distinct(), m))
    wanted = stars.select("id").union(stars.select("hub")).distinct()
    bodies = cut(keyed.join(wanted, "id"))
    likely = stars.where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("b"), F.col("id").alias("a"))
    links = _confirm(likely, bodies, shingle, percent)
    done = cut(components(links))
    more = _left_over(stars.select("hub", "id", "n"), m, done, bodies, shingle, percent)
    if more.isEmpty():
        return done
    return components(done.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles (set size), component_id (smallest linked id, or its own), kept (id = component)."""
    found = classes(docs, shingle, id_col, text_col)
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    full = found.where("n > 0 and id is not null")
    reps = cut(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    parts = link_classes(reps, keyed, shingle, percent)
    of_class = reps.join(parts.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    of_id = full.select("id", "h1", "h2", "n").join(of_class, ["h1", "h2", "n"]).groupBy("id").agg(F.min("component").alias("component"))
    out = found.select("id", "n").join(of_id, "id", "left")
    group = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"), (F.col("id").isNull() | (F.col("id") == group)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of each group, columns as they came."""
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col(f"`{id_col}`").alias("gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["gone"], "left_anti")


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, 2, 80).select("doc_id", "n_shingles", "component_id", "kept")
