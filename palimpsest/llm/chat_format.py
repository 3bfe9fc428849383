"""Conversations from event logs: fold events into messages, render them, and read the rendering back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. A turn is (mark of its role)text(end of turn).
USER, SYSTEM, ASSISTANT, OTHER, END_OTHER, END = "[INST]", "<<SYS>>", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"
#: Strings that a text may not hold unescaped; a backslash is put before each, and before each backslash.
CONTROL = (USER, SYSTEM, ASSISTANT, OTHER, END_OTHER, END, "<s>", "<</SYS>>")
_MARKS = {"user": USER, "system": SYSTEM, "assistant": ASSISTANT}
_CONTROL = "|".join(re.escape(x) for x in CONTROL)
_TOKEN = re.compile(rf"\\(?s:.)|{_CONTROL}")
_ESCAPED = re.compile(r"\\(.)", re.S)
EVENT_TYPES = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """A backslash before each backslash and each control string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(\\|{_CONTROL})", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of logs (conv_id, seq, message_id, type, role, text): (conv_id, position, message_id, role, text).

    Events of a conversation apply by seq (ties: by type, role and text, nulls first). message and delta: the text is
    appended to the message, created by its first event, whose role it takes; edit: the text replaces what the message
    has; regenerate: the message starts anew (later deltas fill it) and takes the event's role if it has one. A null
    type is a message, a null text is empty, other types raise. Null conversation or message ids form keys of their own.
    A message stands where its first event stood (ties: by message id). The fold is an aggregation for each message with no task holding a
    conversation: the texts after the last reset, joined in order.
    """
    kind = F.coalesce(F.col("type"), F.lit("message"))
    known = F.when(kind.isin(*EVENT_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), kind)))
    e = events.select("conv_id", "seq", "message_id", known.alias("type"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct("seq", "type", "role", "text")
    reset = F.col("type").isin("edit", "regenerate")
    folded = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"),
        F.max(F.when(reset, order)).alias("last_reset"),
        F.min_by("role", order).alias("first_role"),
        F.max_by("role", F.when((F.col("type") == "regenerate") & F.col("role").isNotNull(), order)).alias("new_role"),
        F.array_sort(F.collect_list(order)).alias("parts"),
    )
    kept = F.filter("parts", lambda x: F.col("last_reset").isNull() | (x >= F.col("last_reset")))
    texts = F.transform(kept, lambda x: F.when(x["type"] == "regenerate", F.lit("")).otherwise(x["text"]))
    return folded.select(
        "conv_id",
        F.struct(F.col("first_seq").alias("seq"), "message_id").alias("position"),
        "message_id",
        F.coalesce("new_role", "first_role").alias("role"),
        F.concat_ws("", texts).alias("text"),
    )


def render_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, position, segment) for messages (conv_id, position, role, text).

    The formatted conversation is its segments in order of position. A segment is a mark, the escaped text and the
    end mark: [INST] for user, <<SYS>> for system, [/INST] for assistant, [ROLE]name[/ROLE] for any other role (null:
    the empty name). Text under the loss mask is what stands between [/INST] and </s>.
    """
    role = F.coalesce("role", F.lit(""))
    mark = F.concat(F.lit(OTHER), escape(role), F.lit(END_OTHER))
    for name, own in _MARKS.items():
        mark = F.when(role == name, F.lit(own)).otherwise(mark)
    return messages.select("conv_id", "position", F.concat(mark, escape(F.col("text")), F.lit(END)).alias("segment"))


def parse_turns(text: str) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn of a formatted text; raises ValueError where it isn't one."""
    turns, role, at = [], None, 0
    roles = {mark: name for name, mark in _MARKS.items()}
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token[0] == "\\":
            continue
        if role is None and token in (USER, SYSTEM, ASSISTANT, OTHER) and m.start() == at:
            role = roles.get(token, OTHER)
        elif role == OTHER and token == END_OTHER:
            role = (unescape(text[at : m.start()]),)
        elif role not in (None, OTHER) and token == END:
            name = role[0] if isinstance(role, tuple) else role
            turns.append((name, unescape(text[at : m.start()]), role == "assistant"))
            role = None
        else:
            raise ValueError(f"unexpected {token!r} at {m.start()}")
        at = m.end()
    if role is not None or at != len(text):
        raise ValueError("the formatted text ends inside a turn")
    return turns


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_formatted(segments: DataFrame, order: str = "position") -> DataFrame:
    """DIGEST_SCHEMA for each conversation, parsed back from its segments.

    Segments go to a task by conversation and are read there in order, one after the other: a task keeps two running
    hashes and never a conversation, so a very long one costs time but no memory.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, out = object(), None, []

        def close():
            out.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, segment in zip(b["conv_id"].astype("Int64").astype(object), b["segment"], strict=True):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != at:
                    if state is not None:
                        close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(segment)
                for role, text, loss in parse_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if loss:
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield _digests(out)
            out.clear()
        if state is not None:
            close()
            yield _digests(out)

    return segments.select("conv_id", order, "segment").repartition("conv_id").sortWithinPartitions("conv_id", order).mapInPandas(read, DIGEST_SCHEMA)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The rows of a table (conv_id, turn, role, text) as an event log whose fold gives the rows back.

    By a hash of the row's place a message is logged as a whole, streamed as deltas, drafted and edited, or drafted and
    regenerated: an edited one gets its second half as a delta after the edit, a regenerated one comes anew in deltas.
    Only the first event of a message names its role. seq is (turn, step); rows of one turn stay messages of their own
    (a repeated row too), in the order of role and text. A null text is empty. The log is in no order.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("nth", nth).withColumn("way", F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(4)))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text") - half)
    draft = F.concat(F.lit("draft "), left)
    ways = [
        [("message", F.col("text"))],
        [("delta", left), ("delta", right)],
        [("message", draft), ("edit", left), ("delta", right)],
        [("message", draft), ("delta", left), ("regenerate", F.lit(None).cast("string")), ("delta", left), ("delta", right)],
    ]
    logs = [F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("type"), text.alias("text")) for i, (kind, text) in enumerate(way)]) for way in ways]
    log = F.when(F.col("way") == 0, logs[0])
    for i, x in enumerate(logs[1:], 1):
        log = log.when(F.col("way") == i, x)
    events = rows.select("conv_id", "turn", "nth", "role", F.explode(log).alias("event"))
    return events.select(
        "conv_id",
        F.struct("turn", F.col("event.step").alias("step")).alias("seq"),
        F.struct("turn", "nth").alias("message_id"),
        F.col("event.type").alias("type"),
        F.when(F.col("event.step") == 0, F.col("role")).alias("role"),
        F.col("event.text").alias("text"),
    )
