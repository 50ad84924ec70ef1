"""Every operator on null ids and columns, repeated rows, empty tables, and extra columns with clashing names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelark.llm import chat, language_id, line_dedup, near_dedup, packing, piece_codec, quality, substring_dedup, topk_search, toxicity

NAMES = "id k b h n w x i s words word line lines piece start length offset sequence_id n_tokens ids n_lines n_words kept score lang_pred toxic_pred component_id n_shingles n_removed kept_words group value row __k a.b __id __doc __gone __hits __lines __left __doc2 own text2 doc gone at batch body lo told __x __e __lang __source runs bucket r run before linked hub component key met tile".split()
LINES = "\n".join(f"passage line {i} of many words that comes back" for i in range(30))
TEXTS = [None, "", LINES, LINES, "short", "top\n" + LINES, "long " * 60_000, "É日本\r\n\x0b# x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, LINES, None, None), (None, None, None, None), (3, LINES, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).cache()


def model_of_languages(spark):
    return language_id.fit(spark.createDataFrame([(i, f"the {i} house and", "en") for i in range(20)] + [(i, f"das {i} haus und", "de") for i in range(20, 40)], "doc_id long, text string, lang string"))


OPS = {
    "substring": lambda spark, d: substring_dedup.dedup_substrings(d, 13),
    "codec": lambda spark, d: piece_codec.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "packing": lambda spark, d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "lines": lambda spark, d: line_dedup.dedup_lines(d),
    "quality": lambda spark, d: quality.judge(d),
    "good": lambda spark, d: quality.drop_low_quality(d),
    "near": lambda spark, d: near_dedup.near_duplicates(d, 5, 80),
    "kept": lambda spark, d: near_dedup.drop_near_duplicates(d, 5, 80),
    "language": lambda spark, d: language_id.identify(d, model_of_languages(spark)),
    "toxicity": lambda spark, d: toxicity.classify(d, toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_awkward_rows(spark, docs, name):
    rows = OPS[name](spark, docs).collect()
    if name in ("codec", "lines", "quality", "language", "toxicity", "substring", "near"):
        assert len(rows) == docs.count()
    assert rows or name == "good"


def test_columns_as_they_came(spark, docs):
    rng = random.Random(1)
    prose = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    own = docs.limit(1).drop("doc_id", "text")
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(prose)], "doc_id long, text string").crossJoin(own).select(*[F.col(f"`{c}`") for c in docs.columns])
    for keeps in (quality.drop_low_quality, lambda d: near_dedup.drop_near_duplicates(d, 5, 80)):
        assert sorted(map(str, keeps(more).collect())) == sorted(map(str, more.collect()))


@pytest.mark.parametrize("name", sorted(OPS))
def test_no_rows(spark, docs, name):
    assert OPS[name](spark, docs.limit(0)).count() == 0


def test_chat_rows(spark):
    rows = [(1, 2, "user", "hi"), (1, 2, "user", "hi"), (1, None, "assistant", "late"), (1, None, "user", "ask"), (2, 0, None, None), (None, 1, "assistant", ""), (3, 1, "assistant", "x" * 100_000 + "###\\</turn>: \U0001f600")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.messages_as_events(df))).collect()}
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert said == {1: [("user", "hi"), ("user", "hi"), ("assistant", "late"), ("user", "ask")], 2: [("", "")], None: [("assistant", "")], 3: [("assistant", rows[-1][3])]}
    assert {k: r.loss_text for k, r in got.items()} == {1: "late", 2: "", None: "", 3: rows[-1][3]}
    assert chat.format_chats(chat.messages_as_events(df.limit(0))).count() == 0


def test_topk_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, []), (4, []), (5, [0.5]), (6, None), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, query_id int")
    got = {}
    for r in topk_search.top_k(df.where("vec_id in (0, 3, 5, 6)"), df, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 65536), (2, 65536)], 3: [(4, 0)]}
    assert topk_search.top_k(df.limit(0), df, 3).count() == topk_search.top_k(df, df.limit(0), 3).count() == 0


def test_names_with_dots(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "other words here and there in a row"]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dotted = plain.toDF("the.id", "the.text")
    found = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert found(near_dedup.near_duplicates(dotted, 5, 80, "the.id", "the.text")) == found(near_dedup.near_duplicates(plain, 5, 80))
    assert found(near_dedup.drop_near_duplicates(dotted, 5, 80, "the.id", "the.text")) == found(plain.where("doc_id <> 1"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "`vec.id` long, `a.b` array<double>")
    assert found(topk_search.top_k(vectors, vectors, 2, "vec.id", "a.b")) == found(topk_search.top_k(vectors.toDF("vec_id", "embedding"), vectors.toDF("vec_id", "embedding"), 2))
