"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn, text, images, audio and documents, into one string with numbered
placeholders, records what each placeholder refers to and how many tokens it expands to, and marks which characters a
loss is taken over. A conversation is a sequence of pieces, one row per turn, in order inside one partition; nothing
holds a whole conversation, so that one may be as long as it likes. The pieces of a conversation, joined, are its text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,number:int,ref:string,tokens:long>"
PIECE = (f"conv_key string, seq long, role string, formatted string, mask array<struct<first:int,last:int>>, "
         f"attachments array<{ATTACHMENT}>, text_tokens long, expanded_tokens long")
LEARNED = "assistant"

# Control strings that a text may not show as they are: their first character and what follows it.
_AFTER_ANGLE, _AFTER_BRACKET = r"\||/?s>|</?SYS>>", r"/?INST\]"
_ESCAPE = re.compile(rf"(<\\*)(?={_AFTER_ANGLE})|(\[\\*)(?={_AFTER_BRACKET})")
_UNESCAPE = re.compile(rf"(<\\*)\\(?={_AFTER_ANGLE})|(\[\\*)\\(?={_AFTER_BRACKET})")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")


def escape(text: str) -> str:
    """Put one more backslash behind the first character of every control string, plain or escaped."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1) or m.group(2), text)


@dataclass
class Expansion:
    """How many tokens an attachment takes."""

    patch: int = 28  # pixels of an image patch's side
    audio_rate: float = 12.5  # tokens of a second
    page: int = 256  # tokens of a document page

    def image(self, width: int | None, height: int | None) -> int:
        return math.ceil((width or 0) / self.patch) * math.ceil((height or 0) / self.patch)

    def audio(self, seconds: float | None) -> int:
        return math.ceil((seconds or 0.0) * self.audio_rate)

    def document(self, pages: int | None) -> int:
        return (pages or 0) * self.page


def count_words(text: str) -> int:
    return len(text.split())


@dataclass
class Flattener:
    """Visits the parts of one conversation, turn by turn."""

    expansion: Expansion = field(default_factory=Expansion)
    count_tokens: Callable[[str], int] = count_words
    numbers: dict[str, int] = field(default_factory=dict)

    def turn(self, role: str, parts: list[dict]) -> tuple:
        """(formatted, mask, attachments, text tokens, expanded tokens)"""
        self.out, self.size, self.mask, self.attachments, self.tokens = [], 0, [], [], 0
        self.learn = role == LEARNED
        self.emit(f"<|{quote(role, safe='')}|>\n")
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)
        self.emit("<|end|>\n")
        return "".join(self.out), self.mask, self.attachments, self.tokens, self.tokens + sum(a["tokens"] for a in self.attachments)

    def emit(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        first = self.size
        self.emit(escape(text))
        self.tokens += self.count_tokens(text)
        if self.learn and text:
            self.mask.append({"first": first, "last": self.size})

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.numbers[kind] = self.numbers.get(kind, 0) + 1
        self.emit(f"<|{kind}:{number}|>")
        self.attachments.append({"kind": kind, "number": number, "ref": part.get("ref"), "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.expansion.document(part.get("pages")))

    def visit_other(self, part: dict) -> None:
        """A part of an unknown type counts by its text."""
        self.visit_text(part)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text; placeholders are left out."""
    return [(unquote(role), unescape(_PLACEHOLDER.sub("", body))) for role, body in _TURN.findall(formatted)]


def text_parts(text) -> Column:
    """A content of one text part."""
    fields = [F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
              F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def _plain(part) -> dict:
    part = part.asDict() if hasattr(part, "asDict") else dict(part)
    return {k: None if v is None or v != v else v for k, v in part.items()}


def format_turns(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 expansion: Expansion = Expansion(), count_tokens: Callable[[str], int] = count_words) -> DataFrame:
    """A piece for each turn, the pieces of a conversation next to each other and in order.

    parts: array of PART. Turns go by number, null first, then role and content; repeated rows are turns of their own.
    Null roles, parts and texts are empty; conversations with a null id are one. mask has the character ranges of
    formatted that hold an assistant's text. conv_key is the id as text. Other columns are not read. No rows give no
    rows.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("string").alias("conv_key"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(parts, F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"))
    rows = rows.repartition("conv_key").sortWithinPartitions("conv_key", "_turn", "role", "parts").drop("_turn")

    def run(batches):
        key, flat, seq, started = None, None, 0, False
        for pdf in batches:
            out = []
            for conv, role, content in zip(pdf["conv_key"], pdf["role"], pdf["parts"]):
                if not started or conv != key:
                    key, flat, seq, started = conv, Flattener(expansion, count_tokens), 0, True
                out.append((conv, seq, role, *flat.turn(role, [_plain(p) for p in content if p is not None])))
                seq += 1
            yield pd.DataFrame(out, columns=["conv_key", "seq", "role", "formatted", "mask", "attachments", "text_tokens", "expanded_tokens"])

    return rows.mapInPandas(run, PIECE)


def read_back(pieces: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, expanded_tokens) of each conversation.

    Everything is parsed from the formatted pieces and their masks, piece after piece. Pieces may come in any order and
    partition, from a stored table too; they are brought together by conversation and number. in_order spares that for pieces that
    come straight from format_turns. No pieces give no rows.
    """
    if not in_order:
        pieces = pieces.repartition("conv_key").sortWithinPartitions("conv_key", "seq")

    def run(batches):
        key, state = None, None
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                if state is None or row.conv_key != key:
                    if state is not None:
                        done.append((key, *close(state)))
                    key = row.conv_key
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "attached": 0, "tokens": 0}
                for role, text in parse_turns(row.formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row.mask:
                    text = unescape(row.formatted[span["first"]:span["last"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode("utf-8", "surrogatepass"))
                state["size"] += len(row.formatted)
                state["attached"] += len(row.attachments)
                state["tokens"] += row.expanded_tokens
            yield frame(done)
        if state is not None:
            yield frame([(key, *close(state))])

    def close(s):
        return s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["attached"], s["tokens"]

    columns = ["conv_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def frame(rows):
        return pd.DataFrame(rows, columns=columns)

    return pieces.mapInPandas(run, "conv_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
