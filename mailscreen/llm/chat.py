"""Chat formatting, checked by reading the rendered text back with a deterministic parser.

Grammar of the rendered text:

    conversation = { turn }
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A turn is rendered as it is, parsed, and compared with its source.  Only where the two
differ is its content escaped, first the text, then the role as well, until they agree:

* text: "<", k backslashes, "|" gets one backslash more (the parser takes one away), so
  no control string is left inside;
* role: the same, then backslash and line break are written as `\\\\` and `\\n`.

Edge cases: a null role or text counts as empty; rows of one turn number are ordered by
role, then text; repeated rows are turns of their own; a null conversation id is a
conversation like any other; rows without a turn number come first; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_SHUT = re.compile(r"<(\\*)\|")
_OPEN = re.compile(r"<\\(\\*)\|")
_ROLE_OPEN = re.compile(r"\\(.)", re.S)


def escape_text(text: str) -> str:
    return _SHUT.sub(r"<\1\\|", text)


def unescape_text(text: str) -> str:
    return _OPEN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape_text(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape_text(_ROLE_OPEN.sub(lambda m: "\n" if m[1] == "n" else m[1], role))


def frame(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


class TurnParser:
    """Reads rendered text piece by piece and gives the turns that are complete.

    It keeps no more than the turn it is in, so a conversation of any length can be read.
    Text outside the grammar raises ValueError.
    """

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while True:
            end = self.rest.find(END + "\n")
            if end < 0:
                return
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            role, found, text = turn[len(START) :].partition("\n")
            if not turn.startswith(START) or not found or START in role + text or END in role + text:
                raise ValueError("not a turn")
            yield unescape_role(role), unescape_text(text)

    def close(self) -> None:
        if self.rest:
            raise ValueError("text after the last turn")


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text; None if it does not follow the grammar."""
    parser = TurnParser()
    try:
        turns = list(parser.feed(rendered))
        parser.close()
    except ValueError:
        return None
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendered text, where its text starts in it, and where that ends."""
    for shown_role, shown_text in ((role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))):
        rendered = frame(shown_role, shown_text)
        if parse(rendered) == [(role, text)]:
            start = len(START) + len(shown_role) + 1
            return rendered, start, start + len(shown_text)
    raise ValueError(f"no rendering of a turn with role {role!r} reads back")


def render_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same rows plus `rendered`, `text_start`, `text_end`.

    Joined in the order of turns, `rendered` is the training text of the conversation;
    the span is the place of the turn's text in it (code points), which a loss mask takes
    for the roles to be learnt.  Turns are independent, so nothing is shuffled.
    """

    @F.pandas_udf("rendered string, text_start long, text_end long")
    def render(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render_turn(r, t) for r, t in zip(role, text)], columns=["rendered", "text_start", "text_end"])

    known = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    return known.withColumn("_r", render("role", "text")).select("conv_id", "turn", "role", "text", "_r.*")


class _Reader:
    """Digests of one conversation, from its rendered text alone."""

    def __init__(self, learnt: str) -> None:
        self.learnt, self.parser = learnt, TurnParser()
        self.turns, self.chars, self.learnt_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text in self.parser.feed(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == self.learnt:
                self.learnt_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id: int | None) -> tuple:
        self.parser.close()
        return conv_id, self.turns, self.all.hexdigest(), self.learnt_chars, self.loss.hexdigest(), self.chars


def read_back(rendered: DataFrame, learnt: str = "assistant") -> DataFrame:
    """One row per conversation: what a parser recovers from its rendered turns.

    A conversation is read in order by one task, since a digest over it is sequential,
    but as a stream: the task holds one turn at a time, however long the conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader = None, None
        for pdf in frames:
            done = []
            for conv_id, is_null, piece in zip(pdf["conv_id"], pdf["_null"], pdf["rendered"]):
                key = None if is_null else int(conv_id)
                if reader is None or key != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = key, _Reader(learnt)
                reader.feed(piece)
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if reader is not None:
            yield pd.DataFrame([reader.row(current)], columns=names).astype({"conv_id": "Int64"})

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = ordered.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("_null"), "rendered")
    return pieces.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
