"""Corpus operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelark.llm import chat, language_id, line_dedup, near_dedup, packing, piece_codec, quality, substring_dedup, topk_search, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None, True) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(400)]
    near = [w if rng.random() > 0.02 else "X" for w in base]
    texts = [None, "", " \n\t", "one", " ".join(base), " ".join(near), " ".join(base), "x " * 30 + " ".join(base[100:140]) + "\n y", "É日本   " + " ".join(base[:20]), " ".join(base * 12)]
    return texts


def test_substring(spark, awkward):
    ids = [5, 3, 9, 1, 8, 2, 8, 0, None, 7]
    out = {(r.doc_id, r.kept_words): r for r in substring_dedup.dedup_substrings(docs_of(spark, awkward, ids), 13).collect()}
    assert len(out) <= len(ids)
    words = [(t or "").encode().split() for t in awkward]
    lo = {}
    for i, w in zip(ids, words):
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                lo[key] = min(lo.get(key, i), i)
    for i, w in zip(ids, words):
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and lo[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert out[(i, kept)].n_removed == len(gone) and out[(i, kept)].n_words == len(w)


def test_substring_levels(spark):
    a = " ".join(f"w{i}" for i in range(60))
    found = substring_dedup.longest_repeats(docs_of(spark, [a, a + " z", "q " + " ".join(f"w{i}" for i in range(14))]), 13).collect()
    assert {r.doc_id: r.words for r in found} == {0: 52, 1: 52, 2: 13}


def test_pieces(spark, awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = piece_codec.codec(path).lib
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r", "a", "the", "é", "▁", "日本", "😀", "1", "<s>", "<0x0A>", "\u0000", "ing"]
    texts = awkward + ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(300)] + ["a" * 5000]
    rows = piece_codec.encode(docs_of(spark, texts), path).collect()
    for r in rows:
        ids = lib.encode(r.text or "", add_eos=True)
        assert list(r.ids) == ids and r.decoded == lib.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = awkward + ["a <|endoftext|> b", *[" ".join(["word"] * k) for k in range(1, 60, 7)]]
    rows = packing.pack(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), 100).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        ps = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(p.length for p in ps) == len(ids) and [p.piece for p in ps] == list(range(len(ps)))
        assert all(p.length == 100 for p in ps[1:])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 100
    assert len(by_seq) <= -(-total // 100) * 1.1 + 1


@pytest.mark.parametrize("run", [" " * 1_000_000, "\t" * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 500_000 + "b"])
def test_long_runs_of_white_space(run):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.token_ids(run, path).tolist() == [*Tokenizer.from_file(path).encode(run, add_special_tokens=False).ids, 0]


def test_common_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    df = spark.createDataFrame([(i, "word", "own") for i in range(100)] + [(1, "word", "own")], "doc_id long, text string, runs string")
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), 20, keep=["doc_id", "runs"]).collect()
    assert len(rows) == 101 and len({(r.sequence_id, r.offset) for r in rows}) == 101 and {r.runs for r in rows} == {"own"}
    assert len({r.sequence_id for r in rows}) == -(-101 // (20 // rows[0].length))


def test_plan_is_tight():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(2048, int(rng.expovariate(1 / 600)) + 1)] += 1
    plan = packing.plan_bins(dict(counts), 2048)
    load = defaultdict(int)
    for length, r0, r1, b0, per, _ in plan:
        for k in range(r1 - r0 + 1):
            load[b0 + k // per] += length
    assert max(load.values()) <= 2048
    assert len(load) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 2048) + 1


def test_lines(spark):
    lines = [f"line number {i} of a shared passage" for i in range(30)]
    texts = ["\n".join(lines), "own start here\n" + "\n".join(lines) + "\nown end here", None, "", "single", "a\nb"]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert rows[0].text == texts[0] and rows[2].text is None and [rows[i].text for i in (3, 4, 5)] == texts[3:]
    assert rows[1].n_removed_lines >= 15 and rows[1].text.startswith("own start here") and rows[1].text.endswith("own end here")
    gone = set(lines) - set(rows[1].text.split("\n"))
    assert len(gone) == rows[1].n_removed_lines and rows[1].n_lines == 32


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)) * scale
    rows = [(i, x[i // 2].tolist(), 0) for i in range(600)] + [(700, None, 0), (None, x[0].tolist(), 0), (701, [None] * 16, 0), (702, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in topk_search.top_k(df.where("vec_id % 50 = 0"), df, 5, block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = [[int(np.floor(v * 256)) for v in row] for row in x.tolist()]
    for i in range(0, 600, 50):
        want = sorted(((-sum(a * b for a, b in zip(q[i // 2], q[j // 2])), j) for j in range(600) if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in want]
    assert len(got) == 12


def test_chat(spark):
    said = "\\### Assistant: </turn> ok \\b \\\\h ####"
    ev = [("c", 1, 0, "message", "user", said), ("c", 2, 1, "start", "assistant", "Hel"), ("c", 3, 1, "delta", "assistant", "lo"), ("c", 4, 2, "message", "user", "gone"), ("c", 5, 1, "regenerate", None, None),
          ("c", 6, 1, "start", "assistant", "Bye"), ("c", 7, 1, "edit", "assistant", said), ("c", 8, 1, "delta", "assistant", "!"), ("d", 1, 0, "message", "a:b", None)]
    df = spark.createDataFrame(random.Random(1).sample(ev, len(ev)), "conv_id string, seq long, turn long, kind string, role string, body string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in out["c"].turns] == [("user", said), ("assistant", said + "!")]
    assert out["c"].loss_text == said + "!" and [(t.role, t.text) for t in out["d"].turns] == [("a:b", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200))) + "." for _ in range(150)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:5]] + [t.upper() + "!!" for t in clean[5:8]]
    texts = clean + junk + [None, "", "too short", "same words here " * 40]
    rows = {r.doc_id: r for r in quality.judge(docs_of(spark, texts)).collect()}
    assert all(rows[i].kept for i in range(150)) and not any(rows[i].kept for i in range(150, len(texts)))
    assert rows[len(texts) - 1].base_failed and rows[len(texts) - 1].n_repeat_words == 120
    assert quality.judge(docs_of(spark, texts).limit(0)).count() == 0
    assert quality.counts("a b\nc\na b\n\n#x") == (6, 7, 1, 1, 0, quality.counts("a b\nc\na b\n\n#x")[5])


def test_near(spark, awkward):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    texts = awkward + [" ".join(w if rng.random() > p else f"e{rng.randint(0, 99)}" for w in base) for p in [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.3] for _ in range(4)]
    ids = [None if i == 3 else 100 - i for i in range(len(texts))]
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts, ids), 2, 80).collect()}
    sets = {}
    for i, t in zip(ids, texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    live = [i for i in ids if i is not None]
    group = {i: i for i in live}
    for _ in live:
        for a in live:
            for b in live:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    for i in live:
        assert (rows[i].component_id, rows[i].n_shingles) == (group[i], len(sets[i])), i
    assert rows[None].kept and near_dedup.near_duplicates(docs_of(spark, texts, ids).limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(docs_of(spark, texts, ids), 2, 80).count() == sum(group[i] == i for i in live) + 1


def test_language(spark):
    rows = {r.doc_id: r for r in language_id.query(spark, DATA).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [i for i in rows if language_id.held_out(i)]
    assert all(rows[i].held_out == language_id.held_out(i) for i in rows)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.9
    model = language_id.Centroids(np.zeros(language_id.DIM), [])
    assert model.predict("abc")[0] == "und" and model.predict(None)[0] == "und"
    long = "wort " * 600_000
    assert abs(language_id.gram_counts(long).sum() - 2 * len(long)) < 10


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    got = toxicity.classify(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), toxicity.fit(docs, train)).collect()
    bad = [r for r in got if r.toxic]
    assert np.mean([r.toxic_pred == bool(r.toxic) for r in got]) > 0.97 and np.mean([r.toxic_pred for r in bad]) > 0.7
    empty = toxicity.fit(docs, labels.limit(0))
    assert [r.toxic_pred for r in toxicity.classify(docs_of(spark, [None, "", "x"]), empty).collect()] == [False] * 3


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
        docs = after
    packed = p.run(spark, DATA)
    left = {r[0] for r in packed.select("doc_id").distinct().collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert left == {r[0] for r in docs.select("doc_id").collect()}
    assert p.run.__module__ == "corpus_pipeline"
