"""Tokens, snippets and the snippet's white space, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An analyzer makes an array of terms of a text column; token positions are the array's indexes.
Analyzer = Callable[[Column], Column]
SNIPPET_CHARS = 500


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text, in order. A null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{javaLetterOrDigit}+)"), F.lit(1))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """White space collapsed and trimmed; cut at `chars` code points, with ... if more follows.

    The first few times as many code points are tried first: if they are enough, the rest of a long text is left alone.
    """
    flat = lambda t: F.trim(F.regexp_replace(t, r"\p{javaWhitespace}+", " "))
    cut = lambda t: F.concat(F.substring(t, 1, chars), F.lit("..."))
    whole = F.coalesce(text, F.lit(""))
    start = F.substring(whole, 1, 4 * chars)
    return F.when(F.length(flat(start)) > chars, cut(flat(start))).when(F.length(flat(whole)) > chars, cut(flat(whole))).otherwise(flat(whole))
