"""Chat formatting by quotation linking.

A line that begins with quote marks (">", also repeated and spaced) is quoted,
at the level of their number.  Neighbouring lines of one level are a passage.
Passages and the unquoted bodies of messages, whole, by paragraph, by line and
by sentence (of joined lines, after . ! ? before white space), are
normalised (lower case, white space collapsed, edges trimmed) and hashed; a
passage is joined to the first message of its conversation that wrote it
before.  A passage that no message wrote as a whole goes to the earlier
message that wrote most of its lines and sentences.  The shallowest linked passage names
the message replied to; a message without one starts a thread.  Messages are
ordered by their path of replies, and the quoted lines are gone.

Only built-in functions run: explodes, joins on (conversation, hash) with one
original a key, and pointer doubling along replies.

Defined cases: a null text is an empty message; null conversation ids or turns
are never linked and start threads; rows that repeat a (conversation, turn)
are all returned, and can be replied to as one message; empty passages and
lines link nothing.  Quotes of what nobody wrote are removed and link
nothing.  A very long message is handled whole.  An empty table gives an empty
result; other columns are ignored, whatever their names.

A path repeats the turns above a message, so a chain of n replies holds
n * (n + 1) / 2 turns in all: conversations are taken to be of bounded depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

MARKS = r"^[ \t]*>[ \t>]*"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _sentences(text: Column) -> Column:
    """The sentences of a text, over single line feeds."""
    return F.flatten(F.transform(_paragraphs(text), lambda x: F.split(F.regexp_replace(x, r"([.!?])\s+", "$1\u0000"), "\u0000")))


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, part, line, text) of the quoted lines; rows of messages (conv_id, turn, text)."""
    quoted = messages.where("conv_id is not null and turn is not null").where(F.col("text").rlike("(?m)" + MARKS)).dropDuplicates(["conv_id", "turn", "text"])
    quoted = quoted.withColumn("row", F.xxhash64("text"))
    lines = quoted.select("conv_id", "turn", "row", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    marks = F.regexp_extract("text", MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).where("level > 0").withColumn("text", F.regexp_replace("text", MARKS, ""))
    # Lines of one passage have one difference between their place in the message and their place in the level.
    own = Window.partitionBy("conv_id", "turn", "row", "level").orderBy("line")
    lines = lines.withColumn("passage", F.col("line") - F.row_number().over(own))
    return lines.select("conv_id", "turn", "row", "level", "passage", "line", "text")


def bodies(messages: DataFrame) -> DataFrame:
    """``messages`` with ``body``: the text without quoted lines, edges trimmed."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    own = F.array_join(F.filter(lines, lambda x: ~x.rlike(MARKS)), "\n")
    plain = F.when(F.col("text").rlike("(?m)" + MARKS), own).otherwise(F.coalesce("text", F.lit("")))
    return messages.withColumn("body", F.regexp_replace(plain, r"^\s+|\s+\z", ""))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): the earlier message whose words a message quotes first of all."""
    quote = passages(messages).withColumn("text", _normal(F.col("text"))).where("text <> ''")
    keys = ["conv_id", "turn", "row", "level", "passage"]
    whole = quote.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), " ").alias("text"))
    asked = whole.select(*keys, F.lit(1).alias("whole"), F.md5("text").alias("hash")).unionByName(quote.select(*keys, F.lit(0).alias("whole"), F.md5("text").alias("hash")))
    # A sentence that is a line as well, or the whole passage, has one vote as such.
    by_sentence = whole.select(*keys, F.explode(_sentences(F.col("text"))).alias("text")).where("text <> ''").select(*keys, F.lit(0).alias("whole"), F.md5("text").alias("hash"))
    asked = asked.unionByName(by_sentence.join(asked.drop("whole"), [*keys, "hash"], "left_anti"))
    # Only conversations with quotes are searched for originals.
    wrote = messages.where("conv_id is not null and turn is not null").join(quote.select("conv_id").distinct(), "conv_id", "left_semi")
    wrote = bodies(wrote).select("conv_id", "turn", "body")
    pieces = wrote.select("conv_id", "turn", F.explode(F.concat(F.array("body"), _paragraphs(F.col("body")), F.split("body", "\n"), _sentences(F.col("body")))).alias("text"))
    pieces = pieces.withColumn("text", _normal(F.col("text"))).where("text <> ''")
    first = pieces.groupBy("conv_id", F.md5("text").alias("hash")).agg(F.min("turn").alias("origin"))
    met = asked.join(first, ["conv_id", "hash"]).where("origin < turn")
    votes = met.groupBy(*keys, "whole", "origin").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", F.negative("whole").alias("w"), F.negative("n").alias("n"), "passage", "origin")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.origin").alias("reply_to"))


def link_quotations(spark: SparkSession, messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, body, reply_to, thread, depth, path; sorted by (conv_id, path).

    ``path`` holds the turns from the thread's first message down to this one.
    """
    scratch = Scratch(spark, "quotations")
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    reply = scratch.store(links(rows), "links")
    # Pointer doubling: after k rounds a path covers 2^k replies.  Replies point to smaller turns, so it ends.
    path = reply.select("conv_id", "turn", F.col("reply_to").alias("next"), F.array("turn").alias("path"))
    while not path.where("next is not null").isEmpty():
        up = path.select("conv_id", F.col("turn").alias("next"), F.col("next").alias("after"), F.col("path").alias("above"))
        step = path.join(up, ["conv_id", "next"], "left")
        above = F.when(F.col("next").isNull(), F.array().cast("array<long>")).otherwise(F.coalesce("above", F.array("next")))
        path = scratch.store(step.select("conv_id", "turn", F.col("after").alias("next"), F.concat(above, "path").alias("path")), "paths")
    out = bodies(rows).join(reply, ["conv_id", "turn"], "left").join(path.select("conv_id", "turn", "path"), ["conv_id", "turn"], "left")
    out = out.withColumn("path", F.coalesce("path", F.array("turn")))
    return out.select("conv_id", "turn", "role", "body", "reply_to", F.element_at("path", 1).alias("thread"), (F.size("path") - 1).alias("depth"), "path").sort("conv_id", "path")


def conversations(linked: DataFrame) -> DataFrame:
    """(conv_id, thread, messages): reply-ordered messages without quotes, one row a thread.

    A message is (turn, role, content, reply_to, depth, path).  Messages
    without a conversation or a turn are threads of their own.
    """
    item = F.struct("path", "turn", "role", F.col("body").alias("content"), "reply_to", "depth")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    threads = linked.where(known).groupBy("conv_id", "thread").agg(F.array_sort(F.collect_list(item)).alias("messages"))
    threads = threads.unionByName(linked.where(~known).select("conv_id", "thread", F.array(item).alias("messages")))
    message = lambda x: F.struct(*(x[c].alias(c) for c in ("turn", "role", "content", "reply_to", "depth", "path")))
    return threads.select("conv_id", "thread", F.transform("messages", message).alias("messages"))


_WS = r"[ \t\n\v\f\r]"
_MARKS = r"^[ \t]*>[ \t>]*"


def _sql_normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{_WS}+', ' ', 'g'), ' ')"


def _sql_sentences(text: str) -> str:
    return f"flatten(list_transform(regexp_split_to_array({text}, '\\n{_WS}*\\n'), lambda x: string_split(regexp_replace(x, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))))"


#: The result of op5_quotations in DuckDB's SQL.
ORACLE = rf"""
WITH RECURSIVE split AS (
  SELECT conv_id, turn, md5(text) AS row_, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line, unnest(l) AS text
  FROM (SELECT DISTINCT conv_id, turn, text, regexp_split_to_array(text, '\r?\n') AS l FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
),
marked AS (
  SELECT conv_id, turn, row_, line, length(regexp_replace(regexp_extract(text, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(text, '{_MARKS}', '') AS text
  FROM split WHERE regexp_matches(text, '{_MARKS}')
),
placed AS (SELECT *, line - row_number() OVER (PARTITION BY conv_id, turn, row_, level ORDER BY line) AS passage FROM marked),
quoted AS (SELECT * FROM (SELECT conv_id, turn, row_, level, passage, line, {_sql_normal("text")} AS text FROM placed) WHERE text <> ''),
whole AS (SELECT conv_id, turn, row_, level, passage, string_agg(text, ' ' ORDER BY line) AS text FROM quoted GROUP BY ALL),
lines_ AS (SELECT conv_id, turn, row_, level, passage, 1 AS whole, md5(text) AS hash FROM whole UNION ALL SELECT conv_id, turn, row_, level, passage, 0, md5(text) FROM quoted),
parts AS (SELECT * FROM (SELECT conv_id, turn, row_, level, passage, unnest({_sql_sentences("text")}) AS text FROM whole) WHERE text <> ''),
asked AS (
  SELECT * FROM lines_
  UNION ALL SELECT conv_id, turn, row_, level, passage, 0, md5(text) FROM parts p
  WHERE NOT EXISTS (SELECT 1 FROM lines_ l WHERE (l.conv_id, l.turn, l.row_, l.level, l.passage, l.hash) = (p.conv_id, p.turn, p.row_, p.level, p.passage, md5(p.text)))
),
bodies AS (
  SELECT conv_id, turn, role, regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: NOT regexp_matches(x, '{_MARKS}')), chr(10)), '^{_WS}+|{_WS}+$', '', 'g') AS body, text
  FROM conversations
),
own AS (
  SELECT conv_id, turn, role, CASE WHEN coalesce(len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '{_MARKS}'))), 0) > 0 THEN body ELSE regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') END AS body
  FROM bodies
),
pieces AS (
  SELECT conv_id, turn, {_sql_normal("piece")} AS text
  FROM (SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n{_WS}*\n'), string_split(body, chr(10)), {_sql_sentences("body")})) AS piece FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
),
origins AS (SELECT conv_id, md5(text) AS hash, min(turn) AS origin FROM pieces WHERE text <> '' GROUP BY ALL),
votes AS (
  SELECT a.conv_id, a.turn, a.row_, level, passage, whole, origin, count(*) AS n
  FROM asked a JOIN origins o ON a.conv_id = o.conv_id AND a.hash = o.hash WHERE origin < a.turn GROUP BY ALL
),
best AS (SELECT conv_id, turn, origin AS reply_to FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, whole DESC, n DESC, passage, origin) = 1),
walk AS (
  SELECT conv_id, turn, reply_to AS up, [turn] AS path FROM best
  UNION ALL
  SELECT w.conv_id, w.turn, b.reply_to, list_prepend(w.up, w.path) FROM walk w LEFT JOIN best b ON b.conv_id = w.conv_id AND b.turn = w.up WHERE w.up IS NOT NULL
),
linked AS (
  SELECT o.conv_id, o.turn, role, body, reply_to, coalesce(path, [o.turn]) AS path
  FROM own o LEFT JOIN best b ON b.conv_id = o.conv_id AND b.turn = o.turn LEFT JOIN (SELECT * FROM walk WHERE up IS NULL) w ON w.conv_id = o.conv_id AND w.turn = o.turn
)
SELECT conv_id, turn, role, md5(body) AS body_md5, CAST(length(body) AS INT) AS body_chars, reply_to, path[1] AS thread, CAST(len(path) - 1 AS INT) AS depth, coalesce(array_to_string(path, '>'), '') AS path,
       CAST(CASE WHEN conv_id IS NULL OR turn IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path, turn, role NULLS FIRST, body) - 1 END AS INT) AS place
FROM linked
"""
