"""Wiki markup to plain text: a pure function and its Arrow column form."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII_WS = r"[ \t\n\x0b\f\r]"
_STEPS: tuple[tuple[re.Pattern, str], ...] = (
    (re.compile(r"\r\n?"), "\n"),
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(rf"<(ref|math)\b[^>]*>.*?</\1{_ASCII_WS}*>", re.S | re.I | re.A), " "),
    (re.compile(rf"<(references|gallery|source|syntaxhighlight|timeline)\b[^>]*>.*?</\1{_ASCII_WS}*>", re.S | re.I | re.A), "\n"),
)
_AFTER_LINKS = (re.compile(r"<[^>]+>"), re.compile(r"__[A-ZА-Я0-9_]+__"), re.compile("'''?"))
_MEDIA = ("file:", "image:", "category:", "файл:", "изображение:", "категория:")
_EXTERNAL = ("http://", "https://", "ftp://", "//")
# In this order: an escaped ampersand may complete the reference after it.
_NAMED = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "-", "mdash": "-", "hellip": "...", "laquo": "«", "raquo": "»",
}
_CONTROL_AND_SPACE = "".join(map(chr, range(33)))
_NUMERIC = re.compile(r"&#(x[0-9a-fA-F]+|[0-9]+);")
_HEADING = re.compile(rf"{_ASCII_WS}*=+{_ASCII_WS}*(.*?){_ASCII_WS}*=+{_ASCII_WS}*")
_LIST, _DEFINITION = re.compile(rf"{_ASCII_WS}*[*#]+{_ASCII_WS}*"), re.compile(rf"{_ASCII_WS}*[;:]{_ASCII_WS}*")


def _spans(text: str, opening: str, closing: str) -> Iterable[tuple[int, int]]:
    """The outermost balanced spans, left to right; the first one that never closes ends the search."""
    marks = re.compile(f"{re.escape(opening)}|{re.escape(closing)}")
    depth = start = at = 0
    while m := marks.search(text, at):
        at = m.end()
        if m[0] == opening:
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield start, at


def _rewrite(text: str, spans: Iterable[tuple[int, int]], to) -> str:
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], to(text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def _link_label(link: str) -> str:
    target, *parts = link[2:-2].split("|")
    if target.strip(_CONTROL_AND_SPACE).lower().startswith(_MEDIA):
        return ""
    label = (parts[-1] if parts else target.strip(_CONTROL_AND_SPACE)).partition("#")[0]
    return _internal_links(label).replace("_", " ").strip(_CONTROL_AND_SPACE)


def _internal_links(text: str) -> str:
    return _rewrite(text, _spans(text, "[[", "]]"), _link_label)


def _external_links(text: str) -> str:
    out, at = [], 0
    while (a := text.find("[", at)) >= 0 and (b := text.find("]", a + 1)) >= 0:
        inside = text[a + 1 : b].strip(_CONTROL_AND_SPACE)
        if inside.lower().startswith(_EXTERNAL):
            out += [text[at:a], inside.partition(" ")[2].strip(_CONTROL_AND_SPACE)]
            at = b + 1
        else:
            out.append(text[at : a + 1])
            at = a + 1
    return "".join([*out, text[at:]])


def _code_point(m: re.Match) -> str:
    value = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
    return chr(value) if value <= 0x10FFFF and not 0xD800 <= value < 0xE000 else ""


def _line(line: str) -> str:
    if m := _HEADING.fullmatch(line):
        line = m[1]
    elif m := _LIST.match(line):
        line = f"- {line[m.end() :]}"
    else:
        line = _DEFINITION.sub("", line, count=1) if _DEFINITION.match(line) else line
    line = re.sub(r"[\t\x0b\f ]+", " ", line).strip(_CONTROL_AND_SPACE)
    return re.sub(rf"{_ASCII_WS}+([,.;:!?])", r"\1", line)


def clean_wikitext(source: str | None) -> str:
    """Readable text of wiki markup. Markup that never closes is kept as it stands; a null source gives an empty text."""
    text = source or ""
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    for opening, closing in (("{{", "}}"), ("{|", "|}")):
        text = _rewrite(text, _spans(text, opening, closing), lambda _: "\n")
    text = _external_links(_internal_links(text))
    for pattern in _AFTER_LINKS:
        text = pattern.sub("", text)
    text = _NUMERIC.sub(_code_point, text)
    for name, to in _NAMED.items():
        text = text.replace(f"&{name};", to)
    lines = "\n".join(map(_line, text.split("\n")))
    return re.sub(r"\n{3,}", "\n\n", lines).strip(_CONTROL_AND_SPACE)


def clean_wikitext_column(text: Column) -> Column:
    """clean_wikitext as an Arrow-batched scalar UDF: nested markup is no regular language, so no built-in expression does it."""
    return F.udf(clean_wikitext, T.StringType(), useArrow=True)(text)
