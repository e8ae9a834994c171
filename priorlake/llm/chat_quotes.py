"""Quotation linking: nested quotes of chat messages are joined by hash to the messages they quote, and conversations
are put in reply order without the quotes. DataFrame functions only.

A quoted line begins with one '>' per level. Neighbouring lines of one level are a passage; passages and their lines are
normalised (lower case, blanks squeezed) and hashed, and joined to the first message of the conversation that says the same
as a whole, a paragraph or a line of its own. A message replies to the latest message found at the lowest level, passages
before lines; it belongs to the thread its reply chain starts from. The order is: threads by their first turn, then turns.

Scale: only quoting messages are exploded; originals fold to one row per conversation and hash, so a line in a third of all
messages is one row a conversation and no pairs are made; positions are counts of earlier rows in two levels, so a hot
conversation is no single task. Chains are shortened by doubling, each round a written table.

Defined cases: null text counts as empty, null ids and turns form their own conversation and the turn before all others;
repeated rows are numbered one after the other and share their links; a quote of nothing earlier links nothing; an empty
table gives no rows. Turns must be within 30 bits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.llm.shared import stored
from priorlake.operators.prefix import position

QUOTED = r"^(?:[ \t]*>)+[ \t]?"
BLANKS = r"[ \t\n\x0B\f\r]+"
NO_ID = -(1 << 63)
NO_TURN = -(1 << 30)


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+", ""), r"[ \t\n\x0B\f\r]+\z", "")


def digest(text: Column) -> Column:
    """MD5 of the normalised text, null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))
    return F.when(F.length(plain) > 0, F.md5(plain))


def messages(chats: DataFrame) -> DataFrame:
    """conv, t (turn or the turn before all), raw text, own text, whether anything is quoted, and a key of the row's content."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    conv, t = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    own = trimmed(F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTED)), "\n"))
    return chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        conv.alias("conv"), t.alias("t"), text.alias("raw"), F.when(text.contains(">"), own).otherwise(trimmed(text)).alias("own"),
        F.exists(lines, lambda x: x.rlike(QUOTED)).alias("quotes"), F.md5(text).alias("content"),
    )


def passages(rows: DataFrame) -> DataFrame:
    """(conv, t, content, level, whole, digest) of quoted passages, and of their lines (whole false)."""
    line = rows.where("quotes").select("conv", "t", "content", "raw").distinct().select("conv", "t", "content", F.posexplode(F.split("raw", "\n", -1)).alias("at", "line"))
    line = line.withColumn("level", level(F.col("line")))
    # A passage ends where the level changes: the line before it in the message has another level.
    before = line.select("conv", "t", "content", (F.col("at") + 1).alias("at"), F.col("level").alias("_above"))
    heads = line.join(before, ["conv", "t", "content", "at"], "left").where("level > 0")
    inside = Window.partitionBy("conv", "t", "content").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = heads.withColumn("_p", F.sum(F.when(F.col("_above") == F.col("level"), 0).otherwise(1)).over(inside))
    body = F.regexp_replace("line", QUOTED, "")
    whole = numbered.groupBy("conv", "t", "content", "level", "_p").agg(F.array_sort(F.collect_list(F.struct("at", body.alias("b")))).alias("l"))
    whole = whole.select("conv", "t", "content", "level", "_p", F.lit(True).alias("whole"), digest(F.array_join(F.transform("l", lambda x: x["b"]), "\n")).alias("digest"))
    single = numbered.select("conv", "t", "content", "level", "_p", F.lit(False).alias("whole"), digest(body).alias("digest"))
    return whole.unionByName(single).where("digest is not null")


def originals(rows: DataFrame) -> DataFrame:
    """(conv, digest, said): the first turn that says a text as a whole, a paragraph or a line of its own."""
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n", -1), F.split("own", "\n", -1))
    units = rows.select("conv", "t", F.explode(F.array_distinct(F.transform(parts, digest))).alias("digest"))
    return units.where("digest is not null").groupBy("conv", "digest").agg(F.min("t").alias("said"))


def replies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, t, content, reply, n_quotes, n_linked) of quoting messages, and (conv, t, thread) of turns that reply."""
    quoted = stored(passages(rows), "passages")
    found = quoted.join(originals(rows), ["conv", "digest"], "left").withColumn("said", F.when(F.col("said") < F.col("t"), F.col("said")))
    best = F.max(F.when(F.col("said").isNotNull(), F.struct((-F.col("level")).alias("l"), "whole", "said")))
    per_message = found.groupBy("conv", "t", "content").agg(
        best["said"].alias("reply"), F.sum(F.col("whole").cast("long")).alias("n_quotes"), F.count(F.when(F.col("whole"), F.col("said"))).alias("n_linked")
    )
    per_message = stored(per_message, "replies")
    chain = stored(per_message.where("reply is not null").groupBy("conv", "t").agg(F.max("reply").alias("thread")), "chain")
    while True:
        up = chain.select("conv", F.col("t").alias("thread"), F.col("thread").alias("_up"))
        longer = stored(chain.join(up, ["conv", "thread"], "left").select("conv", "t", F.coalesce("_up", "thread").alias("thread"), F.col("_up").isNotNull().alias("_moved")), "chain")
        chain = longer.select("conv", "t", "thread")
        if longer.where("_moved").isEmpty():
            return per_message, chain


def reply_ordered(chats: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position (reply order, from 0), thread (its first turn), reply_to
    (turn), n_quotes and n_linked (passages), text (without quotes)."""
    rows = stored(messages(chats), "messages")
    per_message, chain = replies(rows)
    joined = rows.drop("raw").join(chain, ["conv", "t"], "left").join(per_message, ["conv", "t", "content"], "left")
    joined = joined.withColumn("thread", F.coalesce("thread", "t")).withColumn("_order", F.col("thread") * (1 << 32) + (F.col("t") + (1 << 31)))
    placed = position(joined, ["conv"], "_order", ["role", "content"], "position", block=lambda t: F.floor(t / 1024))
    return placed.select(
        "conv_id", "turn", "role", "position", F.when(F.col("thread") != NO_TURN, F.col("thread")).alias("thread"), F.when(F.col("reply") != NO_TURN, F.col("reply")).alias("reply_to"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias("text"),
    )


SQL = r"""with recursive rows as (
  select row_number() over () as id, conv_id, turn, role, coalesce(text, '') as raw, coalesce(conv_id, -9223372036854775808) as conv, coalesce(turn, -1073741824) as t
  from conversations),
lines as (
  select id, conv, t, unnest(string_split(raw, chr(10))) as line, generate_subscripts(string_split(raw, chr(10)), 1) as k from rows),
marked as (
  select *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) as level,
         regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') as body from lines),
own as (
  select id, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by k) filter (level = 0), ''), '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+\z', '') as own
  from marked group by id),
islands as (
  select *, sum(case when level = above then 0 else 1 end) over (partition by id order by k) as p
  from (select *, lag(level) over (partition by id order by k) as above from marked)),
quoted as (
  select id, conv, t, level, true as whole, string_agg(body, chr(10) order by k) as q from islands where level > 0 group by id, conv, t, level, p
  union all select id, conv, t, level, false, body from islands where level > 0),
hashed as (
  select * exclude q, md5(n) as d from (select *, trim(regexp_replace(lower(q), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as n from quoted) where n <> ''),
parts as (
  select r.conv, r.t, unnest(list_concat([own], list_concat(regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10))))) as u from own join rows r using (id)),
said as (
  select conv, md5(n) as d, min(t) as said from (select *, trim(regexp_replace(lower(u), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as n from parts) where n <> '' group by all),
hits as (
  select h.*, s.said from hashed h left join said s on s.conv = h.conv and s.d = h.d and s.said < h.t),
per as (
  select id, conv, t, arg_max(said, (-level, whole, said)) filter (said is not null) as reply,
         count(*) filter (whole) as n_quotes, count(said) filter (whole) as n_linked
  from hits group by id, conv, t),
up as (select conv, t, max(reply) as reply from per where reply is not null group by all),
chain(conv, t, thread) as (
  select conv, t, reply from up union all select c.conv, c.t, u.reply from chain c join up u on u.conv = c.conv and u.t = c.thread),
tops as (select conv, t, min(thread) as thread from chain group by all)
select r.conv_id, r.turn, r.role,
       row_number() over (partition by r.conv order by coalesce(tops.thread, r.t), r.t, r.role, md5(raw)) - 1 as position,
       nullif(coalesce(tops.thread, r.t), -1073741824) as thread, nullif(per.reply, -1073741824) as reply_to,
       coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, own as text
from rows r join own using (id) left join per using (id) left join tops on tops.conv = r.conv and tops.t = r.t"""
