"""Operator 9: conversations rebuilt from event logs and rendered in a chat template.

Events (conv_id, seq, message, turn, role, kind, text) of kind ``message`` (a whole
text), ``delta`` (more text at the end), ``edit`` (a new whole text) and ``regenerate``
(start the message anew; messages of later turns begun before it are dropped).

Events are folded per message first (a message's own stream is one group), then the
messages of a conversation are put in turn order. The template is

    <s>[ROLE]user[/ROLE]escaped text</s>

per turn. Inside roles and texts a backslash is put before every backslash and after
the first character of every control string, which one pattern takes away again.

Nulls: a null text or role is empty, null ids and turns are ordinary values (nulls
first), an unknown or null kind counts as ``message``. Ties go by sequence, then
role, text and message. Repeated rows are repeated events; whole messages with equal
places stay apart when their ``message`` ids differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings that must not occur inside roles and texts.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
OPEN, NAMED, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """A row per message with its final text: conv_id, message, turn, role, text, begun, regenerated.

    What counts of a message are its events from the last one that sets the whole text.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    kind = F.when(kind.isin("delta", "edit", "regenerate"), kind).otherwise(F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", "message", event.alias("event"))
    grouped = rows.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("event")).alias("events"))
    sets = F.transform("events", lambda e, k: F.when(e["kind"] != "delta", k + 1).otherwise(F.lit(0)))
    since = F.greatest(F.array_max(sets), F.lit(1))
    live = F.slice("events", since, F.size("events") - since + 1)
    again = F.filter("events", lambda e: e["kind"] == "regenerate")
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    return grouped.select("conv_id", "message", F.col("events")[0]["turn"].alias("turn"), F.col("events")[0]["role"].alias("role"),
                          text.alias("text"), F.col("events")[0]["seq"].alias("begun"),
                          F.transform(again, lambda e: e["seq"]).alias("regenerated"))


def drop_superseded(messages: DataFrame) -> DataFrame:
    """Drop messages of later turns than a regenerated one that were begun before it."""
    redone = (messages.where(F.size("regenerated") > 0)
              .select("conv_id", F.col("turn").alias("_turn"), F.explode("regenerated").alias("_seq")))
    # per conversation and turn the last regeneration decides
    redone = redone.groupBy("conv_id", "_turn").agg(F.max("_seq").alias("_seq"))
    m, r = messages.alias("m"), redone.alias("r")
    return m.join(r, F.col("m.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("r._turn") < F.col("m.turn"))
                  & (F.col("m.begun") < F.col("r._seq")), "left_anti")


def format_conversations(events: DataFrame, may_regenerate: bool = True) -> DataFrame:
    """A row per conversation: conv_id, formatted, segments.

    ``segments`` is an array of (text, loss) that joins to ``formatted``; loss marks the
    texts of assistant turns. ``may_regenerate=False`` leaves out the look for superseded
    messages where the log has no regenerations.
    """
    messages = fold_messages(events)
    if may_regenerate:
        messages = drop_superseded(messages)
    shown = messages.select("conv_id", F.struct("turn", "begun", "role", "text", "message").alias("m"))
    convs = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    segments = F.flatten(F.transform("ms", lambda m: F.array(
        F.struct(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(NAMED)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    convs = convs.select("conv_id", segments.alias("segments"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"</s>"), lambda t: t != "")

    def turn(t: Column) -> Column:
        # cut at the first mark of either kind: a role or text holds none
        halves = F.split(F.substr(t, F.lit(len(OPEN) + 1)), r"\[/ROLE\]")
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
