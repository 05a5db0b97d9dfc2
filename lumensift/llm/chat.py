"""Chat formatting: typed content parts flattened by a visitor, turns marked by control strings, loss spans for the assistant.

A conversation becomes  <|turn|>ROLE<|text|>CONTENT<|end|>  for each turn. Control strings inside roles and texts (this
template's and those of other common ones) get a backslash after their first character, and one more where such backslashes
stand already; unescape() takes exactly one away, so parse() gives every role and text back as it was. Text parts that meet
are escaped as one text, so no control string comes together from several; placeholders are the only <| in a content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.token_counts import _arrow

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First character and rest of the strings that no text may hold as such.
CONTROL = r"([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
_PLACEHOLDER = re.compile(r"<\|([a-z0-9_]*):([0-9]+)\|>")
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass
class Costs:
    """Tokens that an attachment stands for: by tiles of an image, by milliseconds of sound, by pages of a document."""

    tile: int = 28
    audio_ms: int = 40
    page: int = 512


@dataclass
class Flattened:
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    open: list[str] = field(default_factory=list, repr=False)  # texts since the last placeholder, not yet escaped

    @property
    def text(self) -> str:
        return "".join(self.pieces)


class PartVisitor:
    """Flattens the typed parts of one turn, in order: escaped text, and a numbered placeholder for each attachment.

    A part is a mapping with type and, as its type asks, text, ref, width and height (image), duration_ms (audio) or
    pages (document). A part of an unknown type is kept as an attachment of that type that costs one token.
    """

    def __init__(self, costs: Costs | None = None):
        self.costs = costs or Costs()

    def flatten(self, parts: list[dict], first: int = 0) -> Flattened:
        out = Flattened()
        for part in parts or []:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part, out, first)
        self._close(out)
        return out

    def visit_text(self, part: dict, out: Flattened, first: int) -> None:
        out.open.append(part.get("text") or "")

    def visit_image(self, part: dict, out: Flattened, first: int) -> None:
        tiles = math.ceil((part.get("width") or 1) / self.costs.tile) * math.ceil((part.get("height") or 1) / self.costs.tile)
        self._attach("image", tiles, part, out, first)

    def visit_audio(self, part: dict, out: Flattened, first: int) -> None:
        self._attach("audio", max(1, math.ceil((part.get("duration_ms") or 0) / self.costs.audio_ms)), part, out, first)

    def visit_document(self, part: dict, out: Flattened, first: int) -> None:
        self._attach("document", self.costs.page * (part.get("pages") or 1), part, out, first)

    def visit_other(self, part: dict, out: Flattened, first: int) -> None:
        self._attach(part["type"], 1, part, out, first)

    @staticmethod
    def _close(out: Flattened) -> None:
        out.pieces.append(escape("".join(out.open)))
        out.open.clear()

    def _attach(self, kind: str, tokens: int, part: dict, out: Flattened, first: int) -> None:
        self._close(out)
        number = first + len(out.attachments)
        out.pieces.append(f"<|{re.sub(r'[^a-z0-9_]', '_', kind)}:{number}|>")
        out.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": tokens})


@dataclass
class Conversation:
    """Collects turns; loss holds the code-point spans [start, end) of the assistant's contents in the formatted text."""

    visitor: PartVisitor
    pieces: list[str] = field(default_factory=list)
    chars: int = 0
    turns: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, role: str | None, parts: list[dict]) -> None:
        flat = self.visitor.flatten(parts, len(self.attachments))
        head, text = f"{TURN}{escape(role or '')}{TEXT}", flat.text
        if role == "assistant":
            self.loss.append({"start": self.chars + len(head), "end": self.chars + len(head) + len(text)})
        self.pieces += [head, text, END]
        self.chars += len(head) + len(text) + len(END)
        self.attachments += flat.attachments
        self.turns += 1

    def formatted(self) -> str:
        return "".join(self.pieces)


def parts_of(content: str) -> list[tuple[str, str | int]]:
    """The parts of an escaped content, in order: ("text", unescaped text), or an attachment's type and number."""
    out, at = [], 0
    for m in _PLACEHOLDER.finditer(content):
        if m.start() > at:
            out.append(("text", unescape(content[at : m.start()])))
        out.append((m[1], int(m[2])))
        at = m.end()
    return out + ([("text", unescape(content[at:]))] if at < len(content) else [])


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted conversation, contents still escaped, placeholders in them."""
    out, at = [], 0
    while at < len(formatted):
        a, b = formatted.index(TEXT, at), formatted.index(END, at)
        if not formatted.startswith(TURN, at) or a > b:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(formatted[at + len(TURN) : a]), formatted[a + len(TEXT) : b]))
        at = b + len(END)
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted conversation, unescaped; placeholders stay as they are."""
    return [(role, unescape(content)) for role, content in turns_of(formatted)]


def loss_text(formatted: str, loss: list[dict]) -> str:
    """All text under the loss mask, unescaped, nothing between."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHED = pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", costs: Costs | None = None
) -> DataFrame:
    """One row per conversation: conv, formatted, n_turns, loss (spans), attachments (number, type, ref, tokens), attachment_tokens.

    content_col holds a string or an array of structs, the typed parts of PartVisitor. Turns go by turn_col, nulls first;
    equal ones by role and content, so that repeated rows all stay and the result is the same each time. A null role or
    text counts as empty; rows with a null conv_col form one conversation. Conversations are dealt by id and sorted, and a
    task holds one conversation (one row of the result) at a time. Other columns play no part.
    """
    typed = df.schema[content_col].dataType.typeName() == "array"
    conv_type = df.schema[conv_col].dataType
    content = F.to_json(F.col(f"`{content_col}`")) if typed else F.col(f"`{content_col}`")
    rows = df.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("t"), F.col(f"`{role_col}`").alias("r"), content.alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    schema = pa.schema([("c", _arrow(conv_type)), ("f", pa.string()), ("n", pa.int64()), ("l", pa.list_(_SPAN)), ("a", pa.list_(_ATTACHED)), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        visitor, now, key, out = PartVisitor(costs), None, None, []

        def close() -> tuple:
            return key, now.formatted(), now.turns, now.loss, now.attachments, sum(a["tokens"] for a in now.attachments)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for c, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or c != key:
                    if now is not None:
                        out.append(close())
                    if len(out) >= 500:
                        yield batch()
                        out = []
                    now, key = Conversation(visitor), c
                now.add(r, (json.loads(x) if x else []) if typed else [{"type": "text", "text": x}])
        if now is not None:
            out.append(close())
        if out:
            yield batch()

    ddl = (
        f"__c {conv_type.simpleString()}, formatted string, n_turns bigint, loss array<struct<start:bigint,end:bigint>>, "
        "attachments array<struct<number:bigint,type:string,ref:string,tokens:bigint>>, attachment_tokens bigint"
    )
    return rows.mapInArrow(run, ddl).withColumnRenamed("__c", conv_col)


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted text holds, by parsing it: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    import hashlib

    from lumensift.llm.common import per_row

    conv_type = chats.schema[conv_col].dataType

    def make() -> Callable:
        def row(conv, formatted, loss):
            turns, learnt = parse(formatted), loss_text(formatted, loss)
            sha = hashlib.sha256()
            for role, text in turns:
                sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return conv, len(turns), sha.hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)

        return row

    schema = pa.schema([("c", _arrow(conv_type)), ("n", pa.int64()), ("t", pa.string()), ("m", pa.int64()), ("l", pa.string()), ("f", pa.int64())])
    ddl = f"__c {conv_type.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return per_row(chats, [conv_col, "formatted", "loss"], schema, ddl, make).withColumnRenamed("__c", conv_col)
