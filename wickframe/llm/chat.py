"""Chat formatting with prefix-target expansion.

A turn is written as  <|im_start|>role<|im_sep|>text<|im_end|>\\n .  Inside roles and texts a backslash is doubled, and
one is put after the first character of every control string (of this template or of other common ones), so that no
control string is left there; taking a backslash away from whatever follows it gives the text back.

Every assistant turn is an example of its own: all turns before it are its context and only its own text is
trainable.  Examples of a conversation share prefixes, so an example is stored as a reference: its text is the first
`end` characters of the conversation's formatted text, and its loss mask is [loss_start, loss_end) in it.  Output
stays linear in the input where written-out prefixes would grow with the square of a conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm.common import let, only

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: First character, and the rest, of the control strings that are escaped inside texts.
CONTROL = r"(<|\[)(\||/?s>|/?INST\]|<?/?SYS>>|unk>|pad>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 1), assistant, segment, begin (characters of the segments before), head (characters of
    its own before the text), text_chars.  Turns are taken in order of turn (null first; equal turns by role and
    text); null roles and texts are empty; rows without conv_id form one conversation."""
    rows = only(conversations, "conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "turn", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    segment = F.concat(F.lit(START), "role", F.lit(SEP), "text", F.lit(END))
    return (
        rows.withColumn("segment", segment)
        .select("conv_id", F.row_number().over(order).alias("turn_no"), (F.col("role") == "assistant").alias("assistant"), "segment", F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), (F.length("role") + len(START) + len(SEP)).alias("head"), F.length("text").alias("text_chars"))
    )


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: all turns of each conversation.  A conversation is one value, so it must fit in a task."""
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "segment"))), lambda t: t["segment"]), "").alias("formatted"))


def examples(turns: DataFrame) -> DataFrame:
    """An example for each assistant turn: conv_id, target_turn, context_turns, loss_start, loss_end, end, by
    reference into the conversation's transcript.  A conversation that doesn't end with the assistant also gets one
    without a trainable part (target_turn null) that holds all its turns, so that nothing of it is lost."""
    last = Window.partitionBy("conv_id").orderBy("turn_no")
    text_at = F.col("begin") + F.col("head")
    whole = F.col("begin") + F.length("segment")
    one = F.struct(F.col("turn_no").alias("target_turn"), (F.col("turn_no") - 1).alias("context_turns"), text_at.alias("loss_start"), (text_at + F.col("text_chars")).alias("loss_end"), whole.alias("end"))
    none = F.struct(F.lit(None).cast("int").alias("target_turn"), F.col("turn_no").alias("context_turns"), whole.alias("loss_start"), whole.alias("loss_end"), whole.alias("end"))
    tail = F.lead("turn_no").over(last).isNull()
    return turns.withColumn("tail", tail).select("conv_id", F.explode(F.when(F.col("assistant"), F.array(one)).when(F.col("tail"), F.array(none)).otherwise(F.array().cast("array<struct<target_turn:int,context_turns:int,loss_start:bigint,loss_end:bigint,end:bigint>>"))).alias("e")).select("conv_id", "e.*")


def written_out(turns: DataFrame) -> DataFrame:
    """The examples with their literal text and the trainable part of it: conv_id, target_turn, text, loss_start,
    loss_end.  As large as all prefixes together; for writers that can't follow references."""
    joined = examples(turns).withColumn("key", F.struct("conv_id")).join(transcripts(turns).select(F.struct("conv_id").alias("key"), "formatted"), "key")
    return joined.select("conv_id", "target_turn", F.expr("substring(formatted, 1, int(end))").alias("text"), "loss_start", "loss_end")


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars (of all examples' texts), n_examples."""
    return read_output(transcripts(turns), examples(turns))


def read_output(formatted: DataFrame, spans: DataFrame) -> DataFrame:
    """read_back() of transcripts and examples.  Segments are found by their marks, and their places by the lengths of
    those before; what is trainable is what lies between an example's loss_start and loss_end, wherever these point in
    the segment of its turn.  An example's text ends where the transcript does, if not before."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.lit(0), F.size(pieces) - 1))
    rows = formatted.select(F.struct("conv_id").alias("key"), F.posexplode(pieces).alias("pos", "piece"))
    size = F.length("piece") + len(END)
    ahead = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(size).over(ahead), F.lit(0)))
    rows = rows.withColumn("whole", F.sum(size).over(Window.partitionBy("key")))
    masks = spans.select(
        F.struct("conv_id").alias("key"), (F.coalesce("target_turn", "context_turns") - 1).alias("pos"), "target_turn", "loss_start", "loss_end", "end")
    rows = rows.join(masks, ["key", "pos"], "left")
    said = let(F.split("piece", r"<\|im_sep\|>", 2), lambda s: F.concat(unescaped(F.substring(s[0], len(START) + 1, 1 << 30)), F.lit("\n"), unescaped(s[1]), F.lit("\n")))
    loss = F.when(F.col("target_turn").isNotNull(), F.expr("substring(piece, int(loss_start - begin) + 1, int(loss_end - loss_start))"))
    rows = rows.select("key", "pos", said.alias("said"), unescaped(loss).alias("loss"), "target_turn", F.when(F.col("end").isNotNull(), F.least("end", "whole")).alias("chars"))
    every = F.array_sort(F.collect_list(F.struct("pos", "said", "loss"))).alias("turns")
    both = rows.groupBy("key").agg(every, F.sum("chars").alias("formatted_chars"), F.count("target_turn").alias("n_examples"))
    text = lambda c: F.array_join(F.transform("turns", lambda t: t[c]), "").alias(c)
    both = both.select("key.conv_id", F.size("turns").cast("long").alias("n_turns"), text("said"), text("loss"), "formatted_chars", "n_examples")
    return both.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_examples")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: formats all conversations and conversation -1, and reads them back."""
    extra = spark.sql("select -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    rows = only(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return read_back(formatted_turns(rows.unionByName(extra)))


OP3_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(replace(role, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|<?/?SYS>>|unk>|pad>)', '\1\\\2', 'g') as er,
    regexp_replace(replace(text, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|<?/?SYS>>|unk>|pad>)', '\1\\\2', 'g') as et from c),
s as (
  select *, sum(length(er) + length(et) + 33) over w as ends, lead(turn) over w is null as tail
  from e window w as (partition by conv_id order by turn, er, et rows between unbounded preceding and current row))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, er, et)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, er, et) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(ends) filter (role = 'assistant' or tail) as bigint) as formatted_chars,
  count(*) filter (role = 'assistant') as n_examples
from s group by conv_id
"""
