"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log row is an event (conversation, seq, turn, kind, role, body). Kinds: `message` and `start` open a
turn with a role and text, `delta` appends streamed text, `edit` replaces the turn's text, and
`regenerate` drops the turn and all later ones as far as they were logged before it. The log is
partitioned by conversation and sorted by sequence, folded into final messages, then rendered.

Template: "### ", role, ": ", text, "</turn>", line feed per turn. Inside texts and roles a backslash
becomes \\b, "###" becomes \\h, "</turn>" becomes \\t and in roles ":" becomes \\c; a backslash only ever
starts such a mark, so unescaping is exact and no control string occurs inside a text.

Defined results: null text is empty text, null role an empty role; events with equal sequence numbers
are ordered by kind, then text, so a repeated event repeats its text (a repeated row of a table of
messages is a message of its own, and a null turn comes last); a delta without a start opens its
turn with an empty role; a null kind is a message; a null conversation id is a conversation of its
own; conversations left without a turn give no row; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
_ESCAPES = [("\\", "\\b"), ("###", "\\h"), (CLOSE, "\\t")]
_ROLE_ESCAPES = [*_ESCAPES, (":", "\\c")]


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, role: bool = False) -> Column:
    return _replaced(c, _ROLE_ESCAPES if role else _ESCAPES)


def unescape(c: Column, role: bool = False) -> Column:
    pairs = _ROLE_ESCAPES if role else _ESCAPES
    return _replaced(c, [(new, old) for old, new in reversed(pairs)])


def messages_as_events(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as the log that streaming them leaves.

    A row is a message of its own, in order of turn (null last), role and text. An assistant's message
    is a draft that is regenerated, then started anew and completed by a delta; any other one is
    started with the front of its text and edited to the whole of it.
    """
    text = F.coalesce("text", F.lit(""))
    order = [F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), text]
    said = rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long").alias("turn"), "role", text.alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    front, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    event = lambda at, kind, body: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), body.alias("body"))
    streamed = F.array(event(0, "start", front), event(1, "regenerate", F.lit(None).cast("string")), event(2, "start", front), event(3, "delta", rest))
    edited = F.array(event(0, "start", front), event(1, "edit", F.col("text")))
    events = said.select("conv_id", "turn", "role", F.inline(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return events.select("conv_id", (F.col("turn") * 4 + F.col("at")).alias("seq"), "turn", "kind", "role", "body")


def fold(events: DataFrame) -> DataFrame:
    """One row per conversation: messages, an array of (turn, seq, role, text) in order.

    Events are first folded per turn (the group is one turn's stream), then turns per conversation. A
    regeneration outdates events of its turn and later ones; a running maximum over the turns says
    which one reaches each.
    """
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("body", F.lit("")).alias("body"))
    part = e.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "regenerate", F.struct("seq", "kind", "body", "role")))).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    since = F.max("again").over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    live = part.withColumn("since", since).withColumn("log", F.filter("log", lambda x: F.col("since").isNull() | x.seq.isNull() | (x.seq > F.col("since"))))
    live = live.where(F.size("log") > 0).withColumn("edits", F.filter("log", lambda x: x.kind == "edit")).withColumn("last", F.try_element_at("edits", F.lit(-1)))
    later = F.filter("log", lambda x: (x.kind != "edit") & (x.seq > F.col("last.seq")))
    text = F.concat(F.coalesce("last.body", F.lit("")), F.array_join(F.transform(F.when(F.size("edits") == 0, F.col("log")).otherwise(later), lambda x: x.body), ""))
    role = F.coalesce(F.get(F.filter("log", lambda x: x.role != ""), F.lit(0)).role, F.lit(""))
    message = F.struct("turn", F.get("log", F.lit(0)).seq.alias("seq"), role.alias("role"), text.alias("text"))
    return live.select("conv_id", message.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """Adds formatted (text) and loss_mask, the (start, length) of assistant texts in it, in code points."""
    turns = folded.select("conv_id", F.posexplode("messages").alias("at", "m"))
    head, body = F.concat(F.lit(OPEN), escape(F.col("m.role"), True), F.lit(MIDDLE)), escape(F.col("m.text"))
    sized = turns.select("conv_id", "at", F.col("m.role").alias("role"), F.concat(head, body, F.lit(CLOSE + "\n")).alias("said"), F.char_length(head).alias("h"), F.char_length(body).alias("b"))
    order = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("start", (F.coalesce(F.sum(F.col("h") + F.col("b") + len(CLOSE) + 1).over(order), F.lit(0)) + F.col("h")).cast("int"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.col("b").alias("length")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x.said)
    return sized.groupBy("conv_id").agg(F.array_join(texts, "").alias("formatted"), F.array_sort(F.collect_list(span)).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse formatted and loss_mask alone: (conv_id, turns, loss_text, formatted)."""
    marked = F.filter(F.split("formatted", "</turn>\\n", -1), lambda s: s != "")
    parsed = F.transform(marked, lambda s: F.struct(unescape(F.regexp_extract(s, "^### ([^:]*): ", 1), True).alias("role"), unescape(F.substring(s, F.locate(MIDDLE, s) + len(MIDDLE), F.length(s))).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda x: unescape(F.substring("formatted", x.start + 1, x.length))), "")
    return rendered.select("conv_id", parsed.alias("turns"), loss.alias("loss_text"), "formatted")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def query(spark, sf_dir):
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = read_back(format_chats(messages_as_events(rows.unionByName(extra))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS et,
        replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS er FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
