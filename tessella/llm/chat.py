"""Chat formatting from event logs.

A log holds what happened in conversations: messages that start, streamed deltas, edits and
regenerations. Events are grouped by conversation and message, sorted by sequence number and
folded into final messages, which are then rendered with a template whose control strings
are escaped inside texts, reversibly. All of it is DataFrame functions.

Events: conv_id, seq, kind, message, role, text. ``start`` opens a message with a role and no
text, ``delta`` appends its text, ``edit`` replaces what the message has so far, ``regenerate``
empties the message and drops all later messages that are open by then. What comes for a dropped
message changes nothing, its regenerations included, until it is started again. Events of one
sequence number are taken in the order start, regenerate, edit, delta, then by message and text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.line_rules import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text must not contain as they are: the template's own and those of common tokenizers.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]")
KINDS = ("start", "regenerate", "edit", "delta")


def _pattern(controls: tuple[str, ...]) -> tuple[str, str]:
    heads, rests = sorted({c[0] for c in controls}), sorted({c[1:] for c in controls})
    if any(h in r for h in heads for r in rests) or any("\\" in c for c in controls):
        raise ValueError("control strings must not overlap or hold a backslash")
    java = lambda x: re.sub(r"([^\w])", r"\\\1", x)
    return "[" + "".join(java(h) for h in heads) + "]", "|".join(java(r) for r in rests)


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Put one more backslash behind the first character of each control string, however many are there."""
    head, rest = _pattern(controls)
    return F.regexp_replace(text, F.lit(rf"({head})(\\*)({rest})"), F.lit(r"$1\\$2$3"))


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    head, rest = _pattern(controls)
    return F.regexp_replace(text, F.lit(rf"({head})\\(\\*)({rest})"), F.lit(r"$1$2$3"))


def _whole_events(events: DataFrame) -> DataFrame:
    """Events with a place (sequence number, rank of the kind) and no null role or text; unknown kinds raise."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    kind = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    place = F.struct(F.col("seq").cast("long").alias("seq"), kind.cast("int").alias("kind"))
    return events.select(F.struct("conv_id", "message").alias("id"), place.alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def dropped(events: DataFrame) -> DataFrame:
    """The ids (conv_id, message) of messages that a regeneration of a lower one has dropped for good; of ``_whole_events``.

    A conversation's openings and regenerations, texts aside, are folded in their order over a
    list of what is open, a byte for each message by rank: an opening sets one, a regeneration whose own
    message is open cuts off what comes behind it. Bytes are all that a step copies (Spark copies
    a fold's arrays, rows and strings at each step, but not its binary values).
    """
    kind, one = F.col("place.kind"), F.lit(bytearray(b"1"))
    firsts = events.groupBy("id").agg(F.min("place").alias("place")).where(kind != 1)
    step = lambda rows, again: rows.select(F.struct("id.conv_id").alias("conv"), "id.message", "place", F.lit(again).alias("again"))
    steps = step(events.where(kind == 1), 0).unionByName(step(firsts, 0)).unionByName(step(events.where(kind == 2), 1))
    steps = steps.withColumn("rank", F.dense_rank().over(Window.partitionBy("conv").orderBy("message")))
    convs = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "again", "message"))).alias("e"), F.max("again").alias("again")).where("again = 1")
    is_open = lambda some, e: F.substring(some, e["rank"], F.lit(1)) == one

    def taken(some: Column, e: Column) -> Column:
        rank, n = e["rank"], F.octet_length(some)
        behind = F.concat(F.when(n < rank - 1, F.rpad(some, rank - 1, F.lit(bytearray(b"0")))).otherwise(some), one)
        opening = F.when(n < rank, behind).when(is_open(some, e), some).otherwise(F.overlay(some, one, rank, F.lit(1)))
        return F.when(e["again"] == 0, opening).when((n > rank) & is_open(some, e), F.substring(some, F.lit(1), rank)).otherwise(some)

    lost = F.aggregate("e", F.lit(bytearray()), taken, lambda some: F.filter("e", lambda e: ~is_open(some, e)))
    convs = convs.select("conv", F.explode(F.transform(lost, lambda e: e["message"])).alias("message"))
    return convs.select(F.struct(F.col("conv.conv_id").alias("conv_id"), "message").alias("id")).distinct()


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text.

    The role is that of the last start event (null: empty). A message whose first event isn't a
    start is opened by that event, with an empty role. Null texts count as empty, null sequence
    numbers as before all others; a null conversation or message number is a value like others,
    below all. Unknown kinds raise. An empty log gives no rows; other columns aren't read. Events
    are gathered for one message at a time, and of regenerated messages the places alone for
    one conversation.
    """
    events = _whole_events(events)
    # a field order that sorts as said: sequence, kind, text; then the role goes along
    event = F.struct(F.col("place.seq").alias("seq"), F.col("place.kind").alias("kind"), "text", "role")
    each = events.groupBy("id").agg(F.sort_array(F.collect_list(event)).alias("e"))
    # index of the last event that isn't a delta
    reset = F.aggregate(F.transform("e", lambda x, i: F.when(x["kind"] < 4, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    each = each.withColumn("reset", reset)
    starts = F.filter("e", lambda x: x["kind"] == 1)
    base = F.when(F.get("e", F.col("reset") - 1)["kind"] == 3, F.get("e", F.col("reset") - 1)["text"]).otherwise("")
    tail = F.array_join(F.transform(F.slice("e", F.col("reset") + 1, F.size("e")), lambda x: x["text"]), "")
    text = F.concat(F.when(F.col("reset") > 0, base).otherwise(""), tail)
    each = each.select("id", F.coalesce(F.get(starts, F.size(starts) - 1)["role"], F.lit("")).alias("role"), text.alias("text"))
    return each.join(dropped(events), "id", "left_anti").select("id.conv_id", "id.message", "role", "text")


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` has (start, length) in bytes of UTF-8 of the texts of roles in ``learn``: the
    loss mask. Messages come by their number, ties by role and text. A conversation's string is
    one value of one row, so its messages meet in one task; no other group does.
    """
    head = F.concat(F.lit(START), escape(F.col("role"), controls), F.lit(SEP))
    rows = messages.withColumns({"head": head, "body": escape(F.col("text"), controls)})
    over = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("head") + F.octet_length("body") + F.lit(len(END))
    rows = rows.withColumns({"at": F.coalesce(F.sum(length.cast("long")).over(over), F.lit(0).cast("long"))})
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("at") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length")))
    rows = rows.select("conv_id", F.struct("at", F.concat("head", "body", F.lit(END)).alias("string"), span.alias("span")).alias("m"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    spans = F.transform(F.filter("m", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return rows.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.array_join(F.transform("m", lambda x: x["string"]), "").alias("formatted"), spans.alias("loss_spans"))


def turns(formatted: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Read a formatted string back: array of (role, text)."""
    ends = re.sub(r"([^\w])", r"\\\1", END)
    parts = F.filter(F.split(formatted, ends), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substring(p, F.lit(len(START) + 1), F.length(p))
        sep = re.sub(r"([^\w])", r"\\\1", SEP)
        return let(F.split(inner, sep), lambda x: F.struct(unescape(F.get(x, F.lit(0)), controls).alias("role"), unescape(F.get(x, F.lit(1)), controls).alias("text")))

    return F.transform(parts, turn)


def masked(formatted: Column, spans: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The texts under the loss mask, unescaped, one after the other; cut by bytes, so in linear time."""
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"), controls))
    return let(F.encode(formatted, "UTF-8"), lambda raw: F.array_join(cut(raw), ""))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that streaming these turns could leave, one whose folding needs every kind of event.

    Each row is a message that starts, gets a draft and is mended: what the user says by an edit,
    all else by a regeneration that also drops a message begun after it. Then the text comes in
    two parts. Rows are numbered by turn (nulls first), role and text; repeated rows are turns of
    their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    none = F.lit(None).cast("string")
    event = lambda k, kind, text, later=0, role=None: F.struct((F.col("message") + later).alias("message"), F.lit(role).cast("string").alias("role") if role else F.when(F.lit(kind == "start"), F.col("role")).alias("role"), (F.col("message") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    said = F.array(event(0, "start", none), event(1, "delta", second), event(2, "edit", first), event(3, "delta", second))
    made = F.array(event(0, "start", none), event(1, "delta", second), event(2, "start", none, 1, "user"), event(3, "delta", first, 1), event(4, "regenerate", none), event(5, "delta", first), event(6, "delta", second))
    return rows.select("conv_id", F.explode(F.when(F.col("role") == "user", said).otherwise(made)).alias("e")).select("conv_id", "e.message", "e.role", "e.seq", "e.kind", "e.text")
