"""The whole job of the corpus operators, row by row against small brute-force versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelark.llm import language_id, line_dedup, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def spark_hash(x, seed=42):
    """Spark's xxhash64 of a text or of whole numbers, in turn."""
    if isinstance(x, str):
        h = xxhash.xxh64_intdigest(x.encode(), seed)
        return h - (1 << 64) if h >> 63 else h
    for v in x:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed % (1 << 64))
    return seed - (1 << 64) if seed >> 63 else seed


def line_chunks(lines, known):
    """The chunks of a text as (first line, last line): plain loops over its lines with content that known holds."""
    at = [k for k, x in enumerate(lines) if any(c.isalnum() for c in x)]
    together = [lines[a] in known and lines[b] in known for a, b in zip(at, at[1:])]
    bound = [spark_hash([spark_hash(lines[a]), spark_hash(lines[b])]) % line_dedup.CUT > 0 for a, b in zip(at, at[1:])]
    found = set()
    for step, ends in ((1, range(len(at))), (-1, range(len(at)))):
        for a in ends:
            b, n = a, 1
            while n < line_dedup.MOST:
                pair = b if step > 0 else b - 1
                if not 0 <= pair < len(together) or not together[pair]:
                    b = None
                    break
                b, n = b + step, n + 1
                if bound[pair]:
                    break
            if b is not None:
                lo, hi = sorted((a, b))
                if sum(len(lines[k]) for k in at[lo : hi + 1]) >= line_dedup.CONTENT:
                    found.add((at[lo], at[hi]))
    return found


def lines_left(rows):
    """(id, text) -> (text, n_lines, n_removed): the chunks that an earlier place holds go."""
    split = [(i, t, t.split("\n")) for i, t in rows if i is not None and t is not None]
    counts = {}
    for _, _, lines in split:
        for x in lines:
            counts[x] = counts.get(x, 0) + 1
    known = {x for x, n in counts.items() if n > 1}
    chunks = {(i, t): line_chunks(lines, known) for i, t, lines in split}
    first = {}
    for (i, t), found in chunks.items():
        for a, b in found:
            key, place = "\n".join(t.split("\n")[a : b + 1]), (i, spark_hash(t), a)
            first[key] = min(place, first.get(key, place))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for a, b in chunks.get((i, t), ()):
            if first["\n".join(lines[a : b + 1])] < (i, spark_hash(t), a):
                gone |= set(range(a, b + 1))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


@pytest.mark.parametrize(("length", "least"), [(2, 0.7), (3, 0.9), (5, 0.98), (10, 0.99), (20, 0.99)])
def test_line_runs_of_any_length(spark, length, least):
    """The share of planted runs that is removed, whatever stands around them; the first copy and all other lines stay."""
    texts, own = [], 0
    for p in range(100):
        run = [f"{length} shared line {p} {i}" for i in range(length)]
        for d in range(3):
            texts.append("\n".join([f"own {p} {d} {i}" for i in range(4)] + run + [f"end {p} {d} {i}" for i in range(3)]))
            own += 7
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[3 * p].text == texts[3 * p] for p in range(100))
    assert sum(r.n_removed_lines for r in rows.values()) >= least * 200 * length
    assert sum(line.startswith(("own", "end")) for r in rows.values() for line in r.text.split("\n")) == own


def test_lines_without_content_stay(spark):
    texts = ["a\n\n\nb", "c\n\n\nd", "y {\n}\n\nv", "z {\n}\n\nw", "---\n***\n---", "---\n***\n---", "if (x) {\n  f();\n}", "if (x) {\n  f();\n}"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == texts
    between = ["top\nfirst of two lines\n\nsecond of two lines\nend", "own\nfirst of two lines\n\nsecond of two lines\nother", "own\nfirst of two lines\n}\nsecond of two lines\nother"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(between)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text == between[0] and [(r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got] == [(i, *x[1:]) for i, x in enumerate(lines_left(list(enumerate(between))))]


def test_lines_brute_force(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice("abcdefghijkl") * rng.choice([0, 1, 1, 30]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["alpha beta gamma", "delta epsilon", "zeta eta theta iota", "", "}", "mu"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[3], "a\na\na\na", "one\nline\n", "one\nline\n", None, "", "alone", "alone", "\n".join(["the very same line"] * 50), "\n".join(["the very same line"] * 50)]
    rows = [(1000 - i if i % 40 else None, t) for i, t in enumerate(texts)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, lines_left(rows)))


def test_lines_whose_hashes_collide(spark, monkeypatch):
    """With a hash of few values every decision is left to the bytes: what goes is there before, and copies go whole."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c, real=F.xxhash64: real(*c) % 5 if len(c) == 1 and c[0] == "text" else real(*c))
    monkeypatch.setattr(line_dedup, "_EACH", line_dedup._EACH.replace("xxhash64(get(lines, x.at))", "xxhash64(get(lines, x.at)) % 5").replace("x.at - x.since + 1), '\n'))", "x.at - x.since + 1), '\n')) % 5"))
    texts = ["\n".join(f"text {d} and line {i}" for i in range(6)) for d in range(8)]
    rows = list(enumerate(texts + texts[:2]))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows[:8])
    assert got[8].n_removed_lines >= 4 and got[9].n_removed_lines >= 4


def prose(rng, n):
    return [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200))) + "." for _ in range(n)]


JUNK = {
    "hashes": lambda t: " ".join(w + "###" for w in t.split()),
    "upper": lambda t: " ".join(w.upper() + "!!" for w in t.split()),
    "bars": lambda t: " | ".join(t.split()),
}


@pytest.mark.parametrize("kind", sorted(JUNK))
def test_junk_in_two_fifths_of_a_source(spark, kind):
    rng = random.Random(4)
    texts = prose(rng, 100)
    rows = [(i, JUNK[kind](t) if i < 40 else t, "en", "s") for i, t in enumerate(texts)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[i] for i in range(40, 100))


def robust(x):
    """Mean and covariance of the reweighted core of the smallest determinant, with exact cores."""
    n, p = x.shape
    low = np.sort(x, 0)
    q = [low[max(0, int(np.ceil(share * n)) - 1)] for share in (0.25, 0.5, 0.75)]
    spreads = [(q[2] - q[0]) / 1.349, np.minimum(q[1] - q[0], q[2] - q[1]) / 0.6745, np.zeros(p)]
    ridge = np.diag([f * f for f in quality.FLOOR.values()])
    away = lambda m, c: ((x - m) @ np.linalg.inv(c + ridge) * (x - m)).sum(1)
    found = []
    for spread in spreads:
        m, c = q[1], np.diag(spread**2)
        for _ in range(60):
            core = x[np.argsort(away(m, c))[: int(quality.core_size(n))]]
            m, c = core.mean(0), np.cov(core.T, bias=True)
        found.append((np.linalg.slogdet(c + ridge)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    near = x[away(m, c * quality.consistency(quality.core_size(n) / n)) < quality.REWEIGHT]
    return near.mean(0), np.cov(near.T, bias=True) * quality._chi2(quality.REWEIGHT, p) / quality._chi2(quality.REWEIGHT, p + 2)


def away(x, *levels):
    """Squared distances of the rows of x from the estimates of these groups, the widest first, each shrunk toward the one before."""
    m, c = robust(levels[0])
    for group in levels[1:]:
        own, cov = robust(group)
        extra = max(0, len(group) - x.shape[1] - 1)
        w = extra / (extra + quality.PRIOR)
        c = (1 - w) * c + w * cov + w * (1 - w) * np.outer(own - m, own - m)
        m = (1 - w) * m + w * own
    ridge = np.diag([f * f for f in quality.FLOOR.values()])
    return ((x - m) @ np.linalg.inv(c + ridge) * (x - m)).sum(1)


def test_distances_brute_force(spark):
    rng = random.Random(6)
    texts = prose(rng, 90)
    texts = [list(JUNK.values())[i % 3](t) if i < 30 else t for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)).collect()}
    x = np.array([quality.counts(t)[5] for t in texts])
    want = away(x, x)
    assert np.allclose([got[i].distance for i in range(90)], want, rtol=0.25)  # the operator's cores end in a share of a bin
    assert [got[i].kept for i in range(90)] == (want <= quality.CUTOFF).tolist()


def test_small_groups_are_judged(spark):
    rng = random.Random(5)
    spoilt = JUNK["hashes"]
    rows = [(t, "en", "large") for t in prose(rng, 70)] + [(t, "en", "small") for t in prose(rng, 6)] + [(spoilt(t), "en", "small") for t in prose(rng, 4)]
    rows += [(t, "fr", "one") for t in prose(rng, 5)] + [(spoilt(t), "fr", None) for t in prose(rng, 2)] + [(spoilt(t), None, None) for t in prose(rng, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    junk = {i for i, r in enumerate(rows) if "#" in r[0]}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i in got if not got[i].kept} == junk
    x = np.array([quality.counts(r[0])[5] for r in rows])
    en, fr = x[:80], x[80:87]
    parts = [away(x[:70], x, en, x[:70]), away(x[70:80], x, en, x[70:80]), away(x[80:85], x, fr, x[80:85]), away(x[85:87], x, fr, x[85:87]), away(x[87:], x, x[87:], x[87:])]
    assert np.allclose([got[i].distance for i in range(len(rows))], np.concatenate(parts), rtol=0.4)


def test_groups_of_every_size(spark):
    """A fifth of junk in sources of 5, 50 and 500 documents: it goes, clean documents stay, by one formula."""
    rng = random.Random(11)
    rows = [(junk(t) if i % 5 == 0 else t, "en", f"of {n}") for n in (5, 50, 500) for i, (t, junk) in enumerate(zip(prose(rng, n), rng.choices(list(JUNK.values()), k=n)))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)).collect()}
    for n in (5, 50, 500):
        of = [(i, k) for k, i in enumerate(i for i, r in enumerate(rows) if r[2] == f"of {n}")]
        assert not any(got[i].kept for i, k in of if k % 5 == 0)
        assert sum(got[i].kept for i, k in of if k % 5) >= 0.99 * sum(k % 5 > 0 for _, k in of)


def test_language_brute_force(spark):
    rng = random.Random(12)
    words = {"aa": "lorem ipsum dolor sit amet elit".split(), "bb": "zwar und nicht wieder kein haus".split(), "cc": "pero nunca siempre donde casa".split()}
    train = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 12)] + [(99, "123 456", "aa"), (100, None, "bb"), (101, "etwas", None)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    known = [(t, lang) for _, t, lang in train if t and lang and re.search("[a-z]", t)]
    counts = np.array([language_id.gram_counts(t) for t, _ in known])
    idf = np.log((1 + len(known)) / (1 + (counts > 0).sum(0))) + 1
    assert np.allclose(model.idf, idf) and sorted(set(model.of)) == sorted(words)
    unit = lambda c: (v := np.log1p(c) * idf) / np.linalg.norm(v)
    texts = [" ".join(rng.choices(words[lang], k=30)) for lang in list(words) * 10] + ["\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "", None, "12 34"]
    rows = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cosine = [float(c @ unit(language_id.gram_counts(r.text))) for c in model.centres]
        best = int(np.argmax(cosine))
        assert r.lang_pred == model.of[best] and abs(r.score - max(0.0, cosine[best])) < 1e-9 and r.rejected == (cosine[best] < model.least[best])
    assert all(r.lang_pred == list(words)[r.doc_id % 3] and not r.rejected for r in rows[:30]) and rows[30].rejected


def test_many_languages(spark):
    rng = random.Random(3)
    names = [f"l{i:03d}" for i in range(230)]
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4)] for n in names}
    df = spark.createDataFrame([(k, " ".join(rng.choices(words[n], k=25)), n) for k, n in enumerate(names * 3)], "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.fit(df)).collect()
    assert {r.lang_pred for r in got} == set(names) and np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_languages_in_blocks(spark, monkeypatch):
    """Blocks of languages, one after the other, find what all at once do."""
    rng = random.Random(4)
    names = [f"l{i:02d}" for i in range(40)]
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4)] for n in names}
    rows = [(k, " ".join(rng.choices(words[n], k=25)), n) for k, n in enumerate(names * 3)]
    rows += [(900, rows[0][1], "twin"), (901, None, "l01"), (902, "12", "l02"), (903, "\u65e5\u672c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "the.id")
    whole = language_id.identify(df, language_id.fit(df, "the.id")).collect()
    monkeypatch.setattr(language_id, "BLOCK", 9)
    model = language_id.fit(df, "the.id")
    parts = list(model.parts())
    assert isinstance(model, language_id.Blocks) and len(parts) == model.n == 6 and sorted({n for p in parts for n in p.of}) == sorted({*names, "twin"})
    blocks = language_id.identify(df, model)
    assert blocks.columns == ["the.id", "text", "lang", "lang_pred", "score", "rejected"]
    bare = lambda found: sorted((r["the.id"], r.lang_pred, round(r.score, 12), r.rejected) for r in found)
    assert bare(blocks.collect()) == bare(whole)


def test_chain_brute_force():
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(240):
        low, toxic = rng.random() < 0.4, rng.random() < 0.3
        texts.append(toxicity.word_ids(" ".join(rng.choices(["plain", "calm", "word", "text"], k=6) + ["bad"] * low + ["vile"] * (toxic and low) + ["rude"] * toxic)))
        labels.append([float(low), float(toxic)])
    y = np.array(labels)
    chain = toxicity.Chain(["low_quality", "toxic"], list(range(240)), texts, y)
    fold = np.array([xxhash.xxh3_64_intdigest(str(i)) % toxicity.FOLDS for i in range(240)])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def out_of_fold(extra, y):
        """Scores by models of the other folds, and the slope and offset of the best logistic curve through them, by a plain descent."""
        s = np.zeros(240)
        for f in range(toxicity.FOLDS):
            at = np.flatnonzero(fold != f)
            part = toxicity.Linear([texts[i] for i in at], extra[at], y[at])
            for i in np.flatnonzero(fold == f):
                s[i] = part.w[texts[i]].sum() + extra[i] @ part.v + part.b
        aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200_000):
            e = sigmoid(a * s + b) - aim
            a, b = a - 0.05 * ((e * s).mean() + 1e-4 * (a - 1)), b - 0.05 * (e.mean() + 1e-6 * b)
        return s, a, b

    s, a, b = out_of_fold(np.zeros((240, 0)), y[:, 0])
    assert np.allclose(chain.scales[0], [a, b], atol=0.02)
    out = sigmoid(chain.scales[0][0] * s + chain.scales[0][1])
    second = toxicity.Linear(texts, out[:, None], y[:, 1])
    assert np.allclose(chain.models[1].v, second.v) and np.allclose(chain.models[1].w, second.w)
    assert np.allclose(chain.scales[1], out_of_fold(out[:, None], y[:, 1])[1:], atol=0.02)
    for said in ("plain bad rude", "calm text", None):
        first, (a, b), (c, d) = chain.models[0], *chain.scales
        ids = toxicity.word_ids(said)
        p = sigmoid(a * (first.w[ids].sum() + first.b) + b)
        q = sigmoid(c * (second.w[ids].sum() + second.v[0] * p + second.b) + d)
        assert np.allclose(chain.predict(said), [p, q])


def test_toxicity_on_held_out_labels(spark):
    """Learned from four fifths of the labels: probabilities are calibrated, and few good or harmless documents are accused."""
    import zlib

    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.classify(docs.join(labels.where(held), "doc_id"), model).select("doc_id", "quality", "toxic", "p_low_quality", "p_toxic", "low_quality_pred", "toxic_pred").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    for name, truth, recall, precision in (("low_quality", lambda r: r.quality == 0, 0.9, 0.95), ("toxic", lambda r: r.toxic == 1, 0.85, 0.9)):
        yes, told = [r for r in rows if truth(r)], [r for r in rows if r[f"{name}_pred"]]
        right = sum(map(truth, told))
        assert right >= recall * len(yes) and right >= precision * len(told)
        assert abs(np.mean([r[f"p_{name}"] - truth(r) for r in rows])) < 0.02 and np.mean([(r[f"p_{name}"] - truth(r)) ** 2 for r in rows]) < 0.03


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + min(n, len(w))]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_stages_brute_force(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs, now = {}, docs
    for name, stage in p.STAGES:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), stage(spark, now, folder).schema)
        outs[name] = {r.doc_id: r for r in now.collect()}
    kept = quality.judge(docs).where("kept").collect()
    assert {r.doc_id: r.text for r in kept} == {i: r.text for i, r in outs["quality_rules"].items()}
    rows = sorted((i, r.text) for i, r in outs["quality_rules"].items())
    assert {i: t for i, t, _, _ in lines_left(rows)} == {i: r.text for i, r in outs["line_dedup"].items()}
    sets = {i: shingles(r.text, 5) for i, r in outs["line_dedup"].items()}
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= (group[a], group[b]) != (low, low)
            group[a] = group[b] = low
    assert set(outs["near_dedup"]) == {i for i in group if group[i] == i}
    words = {i: (r.text or "").encode().split() for i, r in outs["near_dedup"].items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        assert (outs["substring_dedup"][i].text or "").encode().split() == [x for k, x in enumerate(w) if k not in gone]
    assert set(outs["best_fit_packing"]) == set(words)
