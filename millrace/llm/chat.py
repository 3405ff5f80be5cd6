r"""Chat formatting from event logs, with DataFrame functions only.

A log is a table of events: conv_id, seq (the order of a conversation's events), message (the place of a message in it,
any orderable type whose first field or value is a number), kind, role, text. Kinds:

message     begins the message anew with this role and text;
delta       adds text to the message;
edit        puts another text in place of what the message says so far, and leaves later messages;
regenerate  takes back what the message says so far and every later message that was begun before; deltas follow.

``fold`` gives the final messages. ``render`` writes them with the template below and marks the text of the assistant for
the loss; ``read_back`` takes roles, texts and the text under the mask from what was written.

user        ``[INST] text [/INST]``
assistant   ``<s>text</s>``
any other   ``<|role|>text<|end|>``

Inside roles and texts a backslash is doubled, and one is set behind the first character of ``<s>``, ``</s>``, ``<|``, ``|>``,
``[INST]`` and ``[/INST]``: no control string is left there, and dropping the backslashes gives the text again.

A conversation travels in parts of TURNS places. Only its parts meet in one task, each as one row, so a conversation with
very many messages is folded and rendered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Places of a conversation in one part.
TURNS = 32
#: The code points of one delta where a finished text is replayed as a stream.
DELTA = 512

USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER = ("<|", "|>", "<|end|>")
_CONTROL = r"(<(?=s>|/s>|\|)|\[(?=INST\]|/INST\])|\|(?=>))"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<\|.*?\|>.*?<\|end\|>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def as_log(rows: DataFrame) -> DataFrame:
    """The log that leads to finished ``rows`` (conv_id, turn, role, text): each row is a message of its own, begun without
    text and streamed in deltas. Rows come by turn; rows of one turn by role, then by a hash of the text, repeated rows each
    for itself; nulls first. A null role or text counts as empty."""
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("message", F.struct("turn", F.col("role").alias("by"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")))
    pieces = F.ceil(F.length("text") / DELTA).cast("int")
    begun = F.array(F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit("").alias("text")))
    deltas = F.transform(
        F.when(pieces > 0, F.sequence(F.lit(1), pieces)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(k.alias("step"), F.lit("delta").alias("kind"), F.substring(F.col("text"), (k - 1) * DELTA + 1, F.lit(DELTA)).alias("text")),
    )
    events = rows.select("conv_id", "message", "role", F.explode(F.concat(begun, deltas)).alias("e"))
    role = F.when(F.col("e.kind") == "message", F.col("role"))
    return events.select("conv_id", F.col("e.step").cast("long").alias("seq"), "message", F.col("e.kind").alias("kind"), role.alias("role"), F.col("e.text").alias("text"))


def _place(events: DataFrame) -> Column:
    kind = events.schema["message"].dataType
    first = F.col("message")[kind.names[0]] if kind.typeName() == "struct" else F.col("message")
    return F.floor(first / TURNS).cast("long")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, part, message, role, text: the messages that stand at the end of the log.

    A message is gone if a ``regenerate`` of an earlier message of its conversation came after all its events; else events
    before that one do not count, and its text begins at its own last ``message``, ``edit`` or ``regenerate``. Its role is the
    last that its events named, empty if none did. Events of one seq come by text. Null roles leave the role, null
    texts are empty, an unknown kind is a delta, a null message or seq comes first, events without conversation are
    one conversation; an empty log has no messages. Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), _place(events).alias("part"), "message", F.col("seq").cast("long").alias("seq"), "kind", F.col("role").cast("string").alias("role"), text.alias("text"))
    again = F.when(F.col("kind") == "regenerate", F.col("seq"))
    # the latest regeneration in the parts before: numbers only, a row for each part
    latest = e.groupBy("conv_id", "part").agg(F.max(again).alias("latest"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = latest.withColumn("before", F.max("latest").over(earlier)).where("before is not null")
    before = before.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), "before")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("part").eqNullSafe(F.col("__part"))
    e = e.join(before, same, "left").drop("__conv", "__part")
    rows_before = Window.partitionBy("conv_id", "part").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "part", "message")
    never = F.lit(-(2**63))
    # what the first row of a message has before it is of earlier messages only
    e = e.withColumn("above", F.coalesce(F.max(again).over(rows_before), never))
    e = e.withColumn("above", F.greatest(F.coalesce("before", never), F.min("above").over(own)))
    e = e.where(F.coalesce("seq", never) >= F.col("above"))
    e = e.withColumn("from", F.coalesce(F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))).over(own), never))
    e = e.withColumn("stays", F.coalesce("seq", never) >= F.col("from"))
    said = F.struct("seq", F.when(F.col("kind").isin("message", "edit"), 0).otherwise(1).alias("later"), "text")
    out = e.groupBy("conv_id", "part", "message").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
        F.sort_array(F.collect_list(F.when(F.col("stays") & (F.coalesce("kind", F.lit("")) != "regenerate"), said))).alias("said"),
    )
    return out.select("conv_id", "part", "message", F.coalesce("named.role", F.lit("")).alias("role"), F.array_join(F.col("said.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss: the formatted messages of a part, and where the assistant's texts stand in it, as an
    array of start (from 0) and end in code points. The parts of a conversation, one after the other, are the
    formatted conversation; ``whole`` joins them."""
    role = F.col("role")
    opens = F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).otherwise(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])))
    closes = F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(OTHER[2])
    turns = messages.select("conv_id", "part", "message", "role", opens.alias("opens"), escaped(F.col("text")).alias("inner"), closes.alias("closes"))
    turns = turns.select("conv_id", "part", "message", "role", F.length("opens").alias("head"), F.length("inner").alias("chars"), F.concat("opens", "inner", "closes").alias("turn"))
    before = Window.partitionBy("conv_id", "part").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head")
    turns = turns.withColumn("start", at)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.col("chars")).alias("end")))
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("message", "turn"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss"))
    return parts.select("conv_id", "part", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def _gathered(parts: DataFrame) -> DataFrame:
    return parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "formatted", "loss"))).alias("parts"))


def whole(parts: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row for each conversation, the loss by places in the whole of it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.withColumn("__at", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)))
    moved = moved.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + F.col("__at")).alias("start"), (s["end"] + F.col("__at")).alias("end"))))
    gathered = _gathered(moved)
    return gathered.select("conv_id", F.array_join(F.col("parts.formatted"), "").alias("formatted"), F.flatten(F.col("parts.loss")).alias("loss"))


def _role(turn: Column) -> Column:
    other = unescaped(F.regexp_extract(turn, r"(?s)^<\|(.*?)\|>", 1))
    return F.when(turn.startswith(USER[0]), F.lit("user")).when(turn.startswith(ASSISTANT[0]), F.lit("assistant")).otherwise(other)


def _text(turn: Column) -> Column:
    return unescaped(F.regexp_extract(turn, r"(?s)^(?:\[INST\] |<s>|<\|.*?\|>)(.*?)(?: \[/INST\]|</s>|<\|end\|>)$", 1))


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text, formatted_chars, from rendered ``parts`` alone: the turns by the
    template's marks, the text under the mask by its places, both unescaped."""
    turns = lambda p: F.transform(F.regexp_extract_all(p["formatted"], F.lit(_TURN), F.lit(0)), lambda t: F.struct(_role(t).alias("role"), _text(t).alias("text")))
    under = lambda p: F.array_join(F.transform(p["loss"], lambda s: unescaped(F.substring(p["formatted"], s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    gathered = _gathered(parts)
    return gathered.select(
        "conv_id",
        F.flatten(F.transform("parts", turns)).alias("turns"),
        F.array_join(F.transform("parts", under), "").alias("loss_text"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["formatted"])).alias("formatted_chars"),
    )


#: A conversation whose texts hold control strings; drafts of both are replaced, which leaves other messages alone.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"
_PROBE = [
    event
    for turn, role in ((0, "user"), (1, "assistant"))
    for event in ((1, turn, "message", role, "a draft"), (2, turn, "delta", None, " of it"), (3, turn, "edit", None, PROBE_TEXT[:7]), (4, turn, "delta", None, PROBE_TEXT[7:]))
]


def _probe(like: DataFrame) -> DataFrame:
    rows = [f"({PROBE_ID}L, {seq}L, named_struct('turn', {turn}L, 'by', '', 'hash', 0L, 'row', 0L), '{kind}', {_sql(role)}, {_sql(text)})" for seq, turn, kind, role, text in _PROBE]
    return like.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(conv_id, seq, message, kind, role, text)")


def _sql(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else f"'{text}'"


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table and for the probe, read back from its formatted text: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Rows without conv_id are one conversation; an
    empty table leaves the probe."""
    log = as_log(conversations)
    log = materialize(log.unionByName(_probe(log)), "log")
    back = read_back(render(fold(log)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
