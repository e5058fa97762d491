"""Chat formatting: events of conversations are folded into final messages, which a template renders.

An event is a row conv_id, turn, seq, kind, role, text. Kinds:
  message     opens a message; several of one turn are several messages, in order
  delta       its text goes on the end of the turn's latest message
  edit        its text replaces that message's text; a role, if given, its role
  regenerate  the message is written anew, from its text, if any; what had come after it before this event is dropped
  delete      takes the turn's latest message away
An event for a turn without a message opens one (delete: does nothing); an unknown kind is an error.

Events are partitioned by conversation and sorted by sequence within each turn, then folded as they stream by: one
message is in memory at a time, however long the conversation. What an event does to other turns, regenerate alone, it
does to later ones, so that this order gives what the order by sequence alone would. Rendering and digests stream on in
the order of the fold: there is one exchange in all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
MESSAGES = "conv_id long, n long, turn long, role string, text string"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
RENDERED = "conv_id long, n long, segment string, loss_start int, loss_end int"


def escape(text: str) -> str:
    """No control string is left: each < that backslashes, if any, and | follow gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as events: every row, repeated ones too, is a message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log that led to them, in the order of fold(): an assistant's text comes as a message and deltas, a user's as a draft that is edited, others' written anew once.

    Repeated rows are turns of their own, in the order of role and text. Nulls are as in fold().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0

        def events(rows):
            nonlocal seq
            for conv, turn, role, text in rows:
                text = text or ""
                third = len(text) // 3
                if role == "assistant":
                    made = [("message", role, text[:third]), ("delta", None, text[third : 2 * third]), ("delta", None, text[2 * third :])]
                elif role == "user":
                    made = [("message", "draft", text[:third]), ("edit", role, text)]
                else:
                    made = [("message", role, text[:third]), ("regenerate", role, text)]
                for kind, who, what in made:
                    yield conv, turn, seq, kind, who, what
                    seq += 1

        yield from _batches(events(_rows(batches)), _EVENT_SCHEMA)

    rows = by_conversation(conversations.select("conv_id", "turn", "role", "text"), "turn", "role", "text")
    return rows.mapInArrow(run, EVENTS)


def by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, size).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


_EVENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("role", pa.string()), ("text", pa.string())])
_MESSAGE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def fold(events: DataFrame, ordered: bool = False) -> DataFrame:
    """Final messages: conv_id, n (0, 1, ... by turn), turn, role, text; each conversation in one partition, in that order. ordered: so are the events.

    Null texts and roles are empty; null turns and sequences come first; rows that are equal in order are taken by kind
    (messages first), role and text. Events of a null conv_id are one conversation.
    """

    def final(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, turn, message, n, dropped_before, opened = object(), None, None, 0, None, False

        def closed():
            return [(conv, n, turn, message[0], "".join(message[1]))] if message else []

        for c, t, seq, kind, role, text in rows:
            if c != conv or t != turn or not opened:
                if out := closed():
                    yield out[0]
                    n += 1
                message, opened, turn = None, True, t
                if c != conv:
                    conv, n, dropped_before = c, 0, None
                cut = dropped_before
            at = -1 if seq is None else seq
            if cut is not None and at < cut:
                continue  # it came after a message that was written anew later
            if kind == "message" or kind != "delete" and message is None:
                if out := closed():
                    yield out[0]
                    n += 1
                message = [role or "", [text or ""]]
            elif kind == "delta":
                message[1].append(text or "")
            elif kind == "edit":
                message = [role or message[0], [text or ""]]
            elif kind == "delete":
                message = None
            elif kind != "regenerate":
                raise ValueError(f"unknown kind of event: {kind}")
            if kind == "regenerate":
                message = [role or message[0], [text or ""]]
                dropped_before = max(at, dropped_before if dropped_before is not None else at)
        if out := closed():
            yield out[0]

    def run(batches):
        return _batches(final(_rows(batches)), _MESSAGE_SCHEMA)

    if ordered:
        return events.select("conv_id", "turn", "seq", "kind", "role", "text").mapInArrow(run, MESSAGES)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ordered = by_conversation(events.select("conv_id", "turn", "seq", "kind", "role", "text").withColumn("rank", rank), "turn", "seq", "rank", "role", "text")
    return ordered.drop("rank").mapInArrow(run, MESSAGES)


def render(messages: DataFrame) -> DataFrame:
    """A segment for each message, and where in it lies what the loss is taken on: an assistant's text, escaped.

    The formatted conversation is its segments, by n, one after the other.
    """
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|", r"<\\$1|")
    role = F.coalesce("role", F.lit(""))
    escaped_role = F.regexp_replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), r"<(\\*)\|", r"<\\$1|")
    head = F.concat(F.lit(START), escaped_role, F.lit("\n"))
    start = F.when(role == "assistant", F.length(head))
    return (
        messages.withColumn("escaped", escaped)
        .select("conv_id", "n", F.concat(head, "escaped", F.lit(f"{END}\n")).alias("segment"), start.alias("loss_start"), (start + F.length("escaped")).alias("loss_end"))
    )


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered segment."""
    role, text = segment[len(START) :].split("\n", 1)
    return unescape_role(role), unescape(text[: -len(END) - 1])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Segments of a table of turns, whose log is folded: each conversation in one partition, in order."""
    return render(fold(log_of(conversations), ordered=True))


def digests(rendered: DataFrame, ordered: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from rendered segments as they stream by. ordered: each conversation's are in one partition, in order, as fold() leaves them."""

    def per_conversation(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv = state = None
        for c, _, segment, start, end in rows:
            if state is None or c != conv:
                if state:
                    yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                loss = unescape(segment[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(segment)
        if state:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        return _batches(per_conversation(_rows(batches)), schema)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = rendered.select("conv_id", "n", "segment", "loss_start", "loss_end")
    return (rows if ordered else by_conversation(rows, "n")).mapInArrow(run, out)
