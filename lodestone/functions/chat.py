"""Chat rendering as expressions over one message or an array of messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import wording
from .binding import let
from .text import strip, tokenize

MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ChatStyle:
    """Text before and after the content of each role, and whether to strip it."""

    before: dict[str, str]
    after: dict[str, str]
    stripped: bool = True


INSTRUCT = ChatStyle(
    before={"user": "[INST] ", "assistant": ""},
    after={"user": " [/INST]", "assistant": wording.EOS},
)
INSTRUCT_VERBATIM = ChatStyle(INSTRUCT.before, INSTRUCT.after, stripped=False)
TAGGED = ChatStyle(
    before={"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    after={"system": "\n", "user": "\n", "assistant": wording.EOS + "\n"},
)


def _by_role(role: Column, options: dict[str, Column], unknown: Column) -> Column:
    case = None
    for name, value in options.items():
        case = F.when(role == name, value) if case is None else case.when(role == name, value)
    return case.otherwise(unknown)


def render_message(role: Column, content: Column, style: ChatStyle, strict: bool = True) -> Column:
    """One message as it appears in the chat. An unknown role is an error, or
    null when ``strict`` is off so that the caller can reject the row."""
    body = strip(content) if style.stripped else content
    unknown = (
        F.raise_error(F.concat(F.lit("Invalid role: "), role)).cast("string")
        if strict
        else F.lit(None).cast("string")
    )
    return _by_role(
        role,
        {
            name: F.concat(F.lit(style.before[name]), body, F.lit(style.after[name]))
            for name in style.before
        },
        unknown,
    )


def render(messages: Column, style: ChatStyle = INSTRUCT, strict: bool = True) -> Column:
    """The whole chat as one string."""
    parts = F.transform(messages, lambda m: render_message(m["role"], m["content"], style, strict))
    whole = F.array_join(parts, "")
    return whole if strict else F.when(~F.exists(parts, lambda p: p.isNull()), whole)


def message_tokens(rendered: Column) -> Column:
    """Tokens of rendered chat text; end-of-text and placeholder are one each."""
    return tokenize(rendered, specials=wording.PROMPT_SPECIALS)


def quiet_tokens(role: Column, previous: Column, size: Column, style: ChatStyle) -> Column:
    """Number of leading tokens of a rendered message that carry no label.

    That is all of them unless an assistant speaks. The tagged style also masks
    the assistant's tag when another role spoke just before.
    """
    tag = style.before.get("assistant")
    head = F.when(previous != "assistant", F.size(message_tokens(F.lit(tag)))).otherwise(0) if tag else F.lit(0)
    return F.when(role == "assistant", head).otherwise(size)


def first_user_content(messages: Column) -> Column:
    """Content of the first user message, null when there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]


def prefix_first_user(messages: Column, prefix: Column) -> Column:
    """The same messages with ``prefix`` put before the first user content."""

    def prefixed(v):
        return F.transform(
            v["messages"],
            lambda m, i: F.struct(
                m["role"].alias("role"),
                F.when(i + 1 == v["place"], F.concat(prefix, m["content"]))
                .otherwise(m["content"])
                .alias("content"),
            ),
        )

    place = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("user"))
    return let(prefixed, messages=messages, place=place)


def conversation(user: Column, assistant: Column) -> Column:
    """A two-message chat."""
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), assistant.alias("content")),
    )


def placeholder_run(count: Column | int) -> Column:
    """``count`` placeholders separated by single spaces."""
    count = count if isinstance(count, Column) else F.lit(count)
    return F.array_join(F.array_repeat(F.lit(wording.PLACEHOLDER), count), " ")
