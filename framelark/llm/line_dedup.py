"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines with content sets the boundaries, so that they move with the text.
From each line a chunk goes on to the next boundary, and to each line one comes from the boundary before: a repeated
passage keeps its chunks whatever stands around it, up to its first and last line. A chunk whose lines occur
earlier (smaller document id, then place) is removed; the first occurrence stays, and no line's last copy goes.

Chunks hold two or more lines with content (a letter or digit), which have CONTENT characters in all; lines
without content belong to a chunk only between two that have some, and never start, end or make one. Chunks
have MOST lines with content at most; where no boundary comes for so long, one is set there.

Hashes select candidates without moving text. Then bytes decide: the text of every line of a repeated chunk
is a grouping key beside its hash, and chunks with a hash that two texts share are compared by their texts.

Defined results: null text stays null, empty text stays empty; a text that loses every line becomes
empty; rows with a null id are left alone; rows with one id each count as a document, in order of a hash of the text
(rows of equal id and text are judged alike); a line that repeats without a neighbour stays; texts are
taken whole; an input column named like an output column gives way; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, opened, sealed, without, written

#: Of two neighbouring lines one pair in CUT is no boundary; the most lines of a chunk; its least characters.
CUT, MOST, CONTENT = 5, 16, 20
#: A chunk with more than one in HEAVY of all rows is joined by a broadcast, so there are fewer than HEAVY, of WIDE lines at most.
HEAVY, WIDE = 1000, 64


def _split(text):
    return F.split(text, "\n", -1)


#: The places of the lines with content, and for each one: the place after the one before, its length, and hashes of the line alone and with what lies between.
_LINES = "filter(transform(lines, (l, i) -> struct(i AS at, l RLIKE '[\\\\p{L}\\\\p{N}]' AS c)), x -> x.c).at"
_EACH = """transform(transform(kept, (at, k) -> struct(k, at, coalesce(get(kept, k - 1) + 1, at) AS since)), x -> struct(x.k, x.at, x.since, length(get(lines, x.at)) AS n,
  xxhash64(get(lines, x.at)) AS h, xxhash64(array_join(slice(lines, x.since + 1, x.at - x.since + 1), '\n')) AS e))"""


def _chunks(marked: DataFrame) -> DataFrame:
    """(id, doc, at, upto, ids, parts): the chunks of a document's marked lines m, hashes that tell their text, and where each one's text is."""
    last = "cast(size(m) AS int) - 2"
    # Between lines i and i + 1: 2, an unmarked line comes between; 1, a boundary; 0, neither.
    state = f"CASE WHEN size(m) < 2 THEN array() ELSE transform(sequence(0, {last}), i -> CASE WHEN m[i + 1].k <> m[i].k + 1 THEN 2 WHEN pmod(xxhash64(m[i].h, m[i + 1].h), {CUT}) > 0 THEN 1 ELSE 0 END) END"
    w = MOST - 1
    onward = f"transform(state, (s, a) -> struct(a AS a, array_position(transform(slice(state, a + 1, {w}), x -> x > 0), true) AS p, size(slice(state, a + 1, {w})) AS n))"
    back = f"transform(state, (s, b) -> struct(b AS b, array_position(reverse(transform(slice(state, greatest(b - {w - 2}, 1), least(b + 1, {w})), x -> x > 0)), true) AS p, least(b + 1, {w}) AS n))"
    # b counts pairs: pair b joins lines b and b + 1, so a chunk that ends with line b + 1 begins p pairs before.
    ends = f"transform(filter(onward, x -> (x.p > 0 AND state[x.a + cast(x.p AS int) - 1] = 1) OR (x.p = 0 AND x.n = {w})), x -> struct(x.a AS a, x.a + if(x.p > 0, cast(x.p AS int), {w}) AS b))"
    starts = f"transform(filter(back, x -> (x.p > 0 AND state[x.b + 1 - cast(x.p AS int)] = 1) OR (x.p = 0 AND x.n = {w})), x -> struct(x.b + 1 - if(x.p > 0, cast(x.p AS int), {w}) AS a, x.b + 1 AS b))"
    rows = marked.withColumn("state", F.expr(state)).withColumn("onward", F.expr(onward)).withColumn("back", F.expr(back))
    rows = rows.select("id", "doc", "m", F.explode_outer(F.array_distinct(F.concat(F.expr(ends), F.expr(starts)))).alias("c")).where("c is not null")
    rows = rows.select("id", "doc", F.expr("slice(m, c.a + 1, c.b - c.a + 1)").alias("x")).where(f"aggregate(x, 0L, (s, l) -> s + l.n) >= {CONTENT}")
    ids, parts = "transform(x, (l, i) -> if(i = 0, l.h, l.e))", "transform(x, (l, i) -> struct(l.at AS at, if(i = 0, l.at, l.since) AS since))"
    return rows.select("id", "doc", F.expr("x[0].at").alias("at"), F.expr("element_at(x, -1).at").alias("upto"), F.expr(ids).alias("ids"), F.expr(parts).alias("parts"))


def _repeated(chunks: DataFrame, key: str) -> DataFrame:
    """The chunks whose key another place has too; later tells those that have an earlier one."""
    place = F.struct("id", "doc", "at")
    firsts = cut(chunks.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    rows = firsts.agg(F.sum("n")).first()[0] or 0
    heavy = (F.col("n") * HEAVY > rows) & (F.size(key) <= WIDE)
    common = F.broadcast(firsts.where(heavy).select(F.col(key).alias("_heavy"), F.col("first").alias("_first")))
    met = chunks.join(common, F.col(key) == F.col("_heavy"), "left")
    rare = met.where("_heavy is null").drop("_heavy", "_first").join(firsts.where(~heavy).select(key, "first"), key)
    hot = met.where("_heavy is not null").withColumnRenamed("_first", "first").select(*rare.columns)
    return rare.unionByName(hot).withColumn("later", F.col("first") < place).drop("first")


def _texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hash, text) of every line of the chunks, alone where it starts one, else with what lies before it; each pair once."""
    parts = chunks.select("id", "doc", F.explode("parts").alias("part")).groupBy("id", "doc").agg(F.collect_set("part").alias("parts"))
    each = rows.join(parts, ["id", "doc"]).select(F.explode(F.expr("transform(parts, x -> array_join(slice(lines, x.since + 1, x.at - x.since + 1), '\n'))")).alias("text"))
    return each.select(F.xxhash64("text").alias("hash"), "text").distinct()


def _repeats(keyed: DataFrame) -> DataFrame:
    """Of (id, text): (id, doc, gone), the places of the lines of chunks that an earlier place has."""
    rows = keyed.select("id", F.xxhash64("text").alias("doc"), _split("text").alias("lines"))
    each = rows.withColumn("kept", F.expr(_LINES)).withColumn("x", F.expr(_EACH)).select("id", "doc", F.explode_outer("x").alias("x")).where("x is not null").select("id", "doc", "x.*")
    seen = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = each.join(seen, "h")
    marked = found.groupBy("id", "doc").agg(F.array_sort(F.collect_list(F.struct("k", "at", "since", "n", "h", "e"))).alias("m"))
    chunks, chunks_at = written(_chunks(marked))
    same, same_at = written(_repeated(chunks, "ids"))
    # Bytes decide: each line's text is a grouping key beside its hash.
    mixed = cut(_texts(rows, same).groupBy("hash").count().where("count > 1").select("hash"))
    later = same
    if not mixed.isEmpty():  # some hash stands for two texts: chunks that hold it are compared by their texts
        held = same.select("id", "doc", "at", "upto", "parts", F.explode("ids").alias("hash")).join(mixed, "hash", "left_semi").drop("hash").dropDuplicates(["id", "doc", "at", "upto"])
        texts = F.expr("transform(parts, x -> array_join(slice(lines, x.since + 1, x.at - x.since + 1), '\n'))")
        doubtful = cut(held.join(rows, ["id", "doc"]).select("id", "doc", "at", "upto", texts.alias("texts")).distinct())
        later = same.join(doubtful, ["id", "doc", "at", "upto"], "left_anti").select("id", "doc", "at", "upto", "later")
        later = later.unionByName(_repeated(doubtful, "texts").drop("texts"))
    gone = cut(later.where("later").groupBy("id", "doc").agg(F.collect_set(F.struct("at", "upto")).alias("gone")))
    for path in (chunks_at, same_at):
        delete(keyed.sparkSession, path)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rewrites the text column; adds n_lines and n_removed_lines (long)."""
    docs = without(docs, "n_lines", "n_removed_lines")
    rows = sealed(docs, id=id_col, text=text_col)
    gone = _repeats(rows.where("id is not null").select("id", "text"))
    marked = rows.withColumn("doc", F.xxhash64("text")).join(gone, ["id", "doc"], "left").withColumn("lines", _split("text"))
    left = F.expr("array_except(sequence(0, size(lines) - 1), flatten(transform(gone, g -> sequence(g.at, g.upto))))")
    marked = marked.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    changed = F.col("gone").isNotNull()
    text = F.when(changed, F.expr("array_join(transform(left, i -> get(lines, i)), '\n')")).otherwise(F.col("text"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    gone_lines = F.when(changed, F.size("lines") - F.size("left")).otherwise(F.lit(0)).cast("long")
    return opened(marked, docs.columns, {id_col: F.col("id"), text_col: text}, n.alias("n_lines"), gone_lines.alias("n_removed_lines"))


def query(spark, sf_dir):
    from .common import table

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
