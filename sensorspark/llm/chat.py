"""Chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue from its own point of view: its turns are the
assistant's, all others are users with their names, and the mask covers what the assistant says.
Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import before, ranked, via_table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a rendered piece; a longer dialogue is several pieces.
CHUNK_TURNS = 64
UNNAMED = "unknown"


def _plain(text: Column) -> Column:
    """Text that cannot be taken for markup."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
    chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """``conv_id, perspective, chunk, n_turns, dialogue, spans``: one row for each participant of a
    conversation and each ``chunk_turns`` turns of it.

    - A participant is a speaker other than ``system``; a null or blank speaker is ``unknown``.
      System turns stay as they are for everyone. A conversation of system turns only gives no row.
    - Turns go by ``order`` (null last), then speaker, then text; ties are equal rows, each a turn of
      its own. A null text is empty; ``<|`` in texts and names becomes ``< |``.
    - ``spans`` are the trained parts of ``dialogue``: begin and end in code points, from each
      assistant text's first character to past its end mark.
    - A null conversation id is a conversation. Other columns are not read. An empty table gives an
      empty result.

    A piece holds ``chunk_turns`` turns at most, whatever the conversation's length: turns are ranked
    over range partitions, so no conversation is gathered.
    """
    name = F.coalesce(F.nullif(F.trim(F.col(speaker).cast("string")), F.lit("")), F.lit(UNNAMED))
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(order).alias("turn"), name.alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    placed = ranked(rows, [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")], "chat")
    # What a part holds of a conversation, and what earlier parts hold: as many rows as parts and conversations.
    held = placed.groupBy("conv_id", "__part").agg(F.min("__pos").alias("__first"))
    earlier = before(placed, ["conv_id"], {"__before": F.lit(1)})
    people = placed.where(F.col("speaker") != system).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    keys = held.join(earlier, same(held, earlier) & (held["__part"] == earlier["__part"])).select(
        held["conv_id"], held["__part"].alias("__p"), (F.col("__before") - F.col("__first")).alias("__shift")
    )
    keys = keys.join(people, same(keys, people)).select(keys["conv_id"].alias("__conv"), "__p", "__shift", "people")
    keys = via_table(keys, "chat-keys")
    rows = placed.join(keys, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__part") == F.col("__p")))
    rows = rows.withColumn("place", F.col("__pos") + F.col("__shift")).withColumn("chunk", F.floor(F.col("place") / chunk_turns))
    rows = rows.withColumn("perspective", F.explode("people"))

    own, other = F.col("speaker") == F.col("perspective"), F.col("speaker") != system
    role = F.when(own, "assistant").when(other, F.concat(F.lit("user name="), _plain(F.col("speaker")))).otherwise(system)
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = F.concat(_plain(F.col("text")), F.lit(END))
    turn = F.struct("place", own.alias("own"), head.alias("head"), body.alias("body"))
    pieces = rows.groupBy("conv_id", "perspective", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    lengths = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + 1)
    pieces = pieces.withColumn("lengths", lengths)

    def span(t: Column, i: Column) -> Column:
        begin = _sum(F.slice("lengths", F.lit(1), i)) + F.length(t["head"])
        return F.struct(t["own"].alias("own"), begin.alias("begin"), (begin + F.length(t["body"])).alias("end"))

    spans = F.transform(F.filter(F.transform("turns", span), lambda s: s["own"]), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    dialogue = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    return pieces.select("conv_id", "perspective", "chunk", F.size("turns").alias("n_turns"), dialogue.alias("dialogue"), spans.alias("spans"))
