"""Chat rendering as column expressions over ``array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role markers of the training text.
SYSTEM = "<|system|>"
USER = "<|user|>"
ASSISTANT = "<|assistant|>"
ROLE_MARKERS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}

_MESSAGES_PER_SLICE = 256
_SPANS = "array<struct<start:int,end:int>>"


def invalid_messages(messages: Column) -> Column:
    """True where a message that prints its content has none.

    Such a conversation cannot be rendered: dropping the piece would silently
    change the text. Roles that print nothing never read their content.
    """
    return F.coalesce(
        F.exists(
            messages,
            lambda m: m["content"].isNull()
            & F.coalesce(m["role"], F.lit("")).isin(*ROLE_MARKERS),
        ),
        F.lit(False),
    )


def render_piece(role: Column, content: Column, is_last: Column, eos: str) -> Column:
    """What one message adds to the training text.

    It ends in a newline, except that an assistant message which is the last
    one ends at its end-of-sequence token. Other roles print nothing.
    """
    newline = F.lit("\n")
    return (
        F.when(role == "system", F.concat(F.lit(f"{SYSTEM}\n"), content, newline))
        .when(role == "user", F.concat(F.lit(f"{USER}\n"), content, newline))
        .when(
            role == "assistant",
            F.concat(
                F.lit(f"{ASSISTANT}\n"),
                content,
                F.when(is_last, F.lit(eos)).otherwise(F.lit(f"{eos}\n")),
            ),
        )
        .otherwise(F.lit(""))
    )


def render_chat(messages: Column, eos: str, add_generation_prompt: bool = False) -> Column:
    """Training text of a conversation; NULL if it is NULL or invalid.

    Messages of other roles print nothing but do count as last.
    """
    pieces = F.transform(
        messages,
        lambda m, i: render_piece(m["role"], m["content"], i == F.size(messages) - 1, eos),
    )
    text = F.array_join(pieces, "")
    if add_generation_prompt:
        prompt = F.when(F.size(messages) > 0, F.lit(f"{ASSISTANT}\n")).otherwise(F.lit(""))
        text = F.concat(text, prompt)
    return F.when(~invalid_messages(messages), text)


def piece_length(role: Column, content: Column, eos: str) -> Column:
    """Code points a message adds to the text when another one follows it."""
    size = F.length(content)
    return (
        F.when(role == "system", size + len(SYSTEM) + 2)
        .when(role == "user", size + len(USER) + 2)
        .when(role == "assistant", size + len(ASSISTANT) + len(eos) + 2)
        .otherwise(F.lit(0))
    )


def answer_bounds(start: Column, content: Column, eos: str) -> tuple[Column, Column]:
    """Trainable stretch of an assistant message whose piece begins at ``start``:
    content and end-of-sequence token, without marker line and closing newline."""
    first = start + len(ASSISTANT) + 1
    return first, first + F.length(content) + len(eos)


def answer_pieces(messages: Column, eos: str) -> Column:
    """Per message the code points it adds to the text, and the trainable stretch inside them.

    ``array<struct<length,start,end>>``; start and end are null where an assistant does not speak. The last
    answer may lack its closing newline, which is not trainable.
    """

    def piece(m: Column) -> Column:
        start, end = answer_bounds(F.lit(0), m["content"], eos)
        speaks = m["role"] == "assistant"
        return F.struct(
            piece_length(m["role"], m["content"], eos).cast("int").alias("length"),
            F.when(speaks, start).cast("int").alias("start"),
            F.when(speaks, end).cast("int").alias("end"),
        )

    return F.transform(messages, piece)


def assistant_spans(messages: Column, eos: str) -> Column:
    """Loss spans in the rendered text, 0-based code points, end-exclusive.

    Row-local, so it costs no shuffle. Messages are folded in slices: appending
    to one growing array would be quadratic in very long conversations.
    """
    no_spans = F.array().cast(_SPANS)

    def step(state: Column, message: Column) -> Column:
        role, content = message["role"], message["content"]
        start, end = answer_bounds(state["at"], content, eos)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(
            (state["at"] + piece_length(role, content, eos)).cast("int").alias("at"),
            F.when(role == "assistant", F.array_append(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    def fold_slice(state: Column, first: Column) -> Column:
        part = F.aggregate(
            F.slice(messages, first, F.lit(_MESSAGES_PER_SLICE)),
            F.struct(state["at"].alias("at"), no_spans.alias("spans")),
            step,
        )
        return _let(
            part,
            lambda p: F.struct(
                p["at"].alias("at"), F.array_append(state["parts"], p["spans"]).alias("parts")
            ),
        )

    spans = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(messages), F.lit(1)), F.lit(_MESSAGES_PER_SLICE)),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("parts")),
        fold_slice,
        lambda state: F.flatten(state["parts"]),
    )
    return F.when(messages.isNotNull() & ~invalid_messages(messages), spans)


def _let(value: Column, body) -> Column:
    """Bind an expression, so that using it twice computes it once."""
    return F.transform(F.array(value), body)[0]
