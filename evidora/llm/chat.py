"""Conversations as training text, rebuilt from their event logs.

A log has a row for each event: conv_id, seq (its place in the conversation's log),
message (its place among the messages), role, kind and text.  A ``delta`` adds its
text to the message, an ``edit`` replaces the message's text by its own, and a
``regenerate`` drops what the message holds and withdraws all that later messages
hold so far, as they answered it.  The log is partitioned by conversation and
message, sorted by seq and folded into the final messages; a message of which no
event is left is gone.  An event delivered twice counts once.

The rendered text marks every turn, and a control string inside a text gets a
backslash after its first character (one more if it has some already), which is
undone in reading, so no text can end its turn.  The loss mask is a list of ranges:
the turn, the first character inside it and the number of characters.

Everything is DataFrame functions.  A conversation of any number of events is folded
message by message; the rendered text of one conversation is one value and has to
fit in a row.

Cases: a null text is empty; a null role is the empty role; roles may hold line
breaks and control strings; a null kind is a delta; a null seq comes before all
others; of events of the same seq those with the smaller kind (by name) come first;
rows without a conv_id are one conversation; in a table of turns, rows of the same
turn are ordered by role and text, and rows that repeat are turns each; texts of
any length are taken whole; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, STOP, END = "<s>[INST] ", " [/INST]", "</s>"  # a turn is START role \n text STOP END
CONTROL = r"/?s>|/?INST\]"                            # what follows the first character of a control string
TRAINED = ("assistant",)
PIECE = 512                                           # characters of a streamed piece
FIRST = -(1 << 63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\({CONTROL})", "$1$2")


def _role(role: Column) -> Column:
    """A role in one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _read_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def streamed(turns: DataFrame) -> DataFrame:
    """The log that leaves the turns of a table (conv_id, turn, role, text) behind.

    Turns arrive one after another, in pieces.  A trained role's message is begun, regenerated and streamed; any other
    is begun and its first piece edited before the rest follows, so that all kinds of events are folded.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select("conv_id", place.alias("message"), "role", "text")
    rows = rows.select("conv_id", "message", "role", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    pieces = F.when(F.size("pieces") > 0, F.col("pieces")).otherwise(F.array(F.lit("")))
    draft = F.struct(F.lit("delta").alias("kind"), pieces[0].alias("text"))
    again = F.struct(F.lit("regenerate").alias("kind"), F.lit(None).cast("string").alias("text"))
    events = F.when(F.col("role").isin(*TRAINED), F.concat(F.array(draft, again), F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("text"))))).otherwise(
        F.concat(F.array(draft), F.transform(pieces, lambda p, i: F.struct(F.when(i == 0, "edit").otherwise("delta").alias("kind"), p.alias("text")))))
    return rows.select("conv_id", "message", "role", F.posexplode(events).alias("i", "e")).select("conv_id", (F.shiftleft("message", 32) + F.col("i")).alias("seq"), "message", "role", "e.kind", "e.text")


def folded(log: DataFrame) -> DataFrame:
    """conv_id, message, role and text: the final messages."""
    event = F.struct(F.coalesce("seq", F.lit(FIRST)).alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    again = F.max(F.when(F.col("kind") == "regenerate", F.coalesce("seq", F.lit(FIRST)))).alias("again")
    messages = log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_set(event)).alias("events"), again)
    since = F.max("again").over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))  # the last time that an earlier message was regenerated
    live = messages.select("conv_id", "message", "events", since.alias("since")).select("conv_id", "message", F.filter("events", lambda e: F.col("since").isNull() | (e.seq > F.col("since"))).alias("live")).where(F.size("live") > 0)
    role = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform("live", lambda e: e.role), lambda r: r.isNotNull())), -1)
    # What counts begins with the last event that sets or drops the text; without one all of it does.
    set_at = F.array_position(F.reverse(F.transform("live", lambda e: e.kind != "delta")), True).cast("int")
    live = live.select("conv_id", "message", role.alias("role"), F.slice("live", F.when(set_at > 0, F.size("live") - set_at + 1).otherwise(1), F.size("live")).alias("live"))
    text = F.array_join(F.transform("live", lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text)), "")
    return live.select("conv_id", "message", "role", text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (turn from 0, start inside the turn, length) of each conversation."""
    turn = F.struct("message", _role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*TRAINED).alias("trained"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t.body, F.lit(STOP + END))), "")
    ranges = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), (F.length(t["head"]) + len(START) + 1).alias("start"), F.length(t.body).alias("length"), t.trained.alias("trained")))
    mask = F.transform(F.filter(ranges, lambda r: r.trained), lambda r: F.struct(r.turn.alias("turn"), r.start.alias("start"), r["length"].alias("length")))
    return turns.select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text, all from the rendered text and its mask."""
    cut = F.split("formatted", END)
    chats = chats.select("conv_id", "formatted", "loss_mask", F.slice(cut, 1, F.size(cut) - 1).alias("marked"))  # nothing follows the last END

    def parsed(t):
        inner = t.substr(F.lit(len(START) + 1), F.length(t) - len(START + STOP))
        head = F.substring_index(inner, "\n", 1)
        return F.struct(_read_role(head).alias("role"), unescape(inner.substr(F.length(head) + 2, F.length(inner))).alias("text"))

    under = F.transform("loss_mask", lambda m: unescape(F.get("marked", m.turn).substr(m.start + 1, m["length"])))
    return chats.select("conv_id", "formatted", F.transform("marked", parsed).alias("turns"), F.array_join(under, "").alias("loss_text"))


def formatted(turns: DataFrame) -> DataFrame:
    """The rendered conversations of a table of turns, through their logs."""
    return rendered(folded(streamed(turns)))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are made of control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def digests(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back(chats).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                                   F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
