"""Token counts without tokens: Viterbi over unigram vocabulary matches, carrying only the best score and the piece count.

The vocabulary and its scores are read from a SentencePiece model file. The scores of a BPE model are no log probabilities
but ranks, from 0 down: by Zipf's law a piece of rank r gets -log(r + ZIPF), so the best segmentation is close to the merges'
(README has figures). Each U+0020 is a word mark, and a text starts with
one. A text is cut into words where a mark follows another character, so a run of marks stays with the word after it; if
the vocabulary has no piece with a mark after another character, no piece crosses a cut and the best segmentation of a text
is that of its words; with another vocabulary texts are not cut. In a word an Aho-Corasick automaton lists the pieces that end at each place, longest first; a candidate replaces the best one only
if its score is higher, so among equal scores the longest last piece wins, as in the public unigram tokenizers. Where no
piece of one character matches, that character is unknown at the lowest score less 10, and counts as one piece for each of
its UTF-8 bytes if the vocabulary has byte pieces, else one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lumensift.llm.common import only, per_row

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The shift in Zipf's law (as Mandelbrot gave it) for the pieces of a vocabulary that has ranks only.
ZIPF = 100.0
#: Words whose counts a task remembers, and the longest that it does.
CACHE_WORDS, CACHE_CHARS = 400_000, 48


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float] = field(repr=False)
    lowest: float
    bytes_for_unknown: bool


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def load_vocabulary(model_file: str, zipf: float | None = ZIPF) -> Vocabulary:
    """The pieces that can match text (not control, unknown, unused or byte pieces) with their scores; ranks, which are whole, become scores unless zipf is None."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(m.get_piece_size())
    pieces = {m.id_to_piece(i): float(m.get_score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))}
    if zipf is not None and all(x <= 0 and x.is_integer() for x in pieces.values()):
        pieces = {p: -math.log(zipf - rank) for p, rank in pieces.items()}
    return Vocabulary(pieces, min(pieces.values()), any(m.is_byte(i) for i in ids))


def word_counter(v: Vocabulary) -> Callable[[str], tuple[int, int]]:
    """word (with its mark) -> (pieces, unknown characters)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for piece, score in v.pieces.items():
        a.add_word(piece, (len(piece), score))
    a.make_automaton()
    matches, unknown, per_byte = a.iter, v.lowest - UNKNOWN_PENALTY, v.bytes_for_unknown

    def count(word: str) -> tuple[int, int]:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, strange = [0] * (n + 1), [0] * (n + 1)

        def close(j: int) -> None:
            """No piece of one character ends at j: the character there may stand as unknown."""
            s = best[j - 1] + unknown
            if best[j] is None or s > best[j]:
                best[j], strange[j] = s, strange[j - 1] + 1
                pieces[j] = pieces[j - 1] + (len(word[j - 1].encode("utf-8", "surrogatepass")) if per_byte else 1)

        at, single = 1, False
        for end, (length, score) in matches(word):
            j = end + 1
            while at < j:
                if not single:
                    close(at)
                at, single = at + 1, False
            s = best[j - length] + score
            if best[j] is None or s > best[j]:
                best[j], pieces[j], strange[j] = s, pieces[j - length] + 1, strange[j - length]
            single = single or length == 1
        while at <= n:
            if not single:
                close(at)
            at, single = at + 1, False
        return pieces[n], strange[n]

    return count


def text_counter(v: Vocabulary) -> Callable[[str | None], tuple[int, int, int]]:
    """text -> (words, tokens, unknown characters). The counts of short words are remembered; the memory is emptied when full."""
    of_word, known = word_counter(v), {}
    crossed = any(re.search(f"[^{MARK}]{MARK}", p) for p in v.pieces)
    cut = re.compile(f"{MARK}+[^{MARK}]*").findall

    def count(text: str | None) -> tuple[int, int, int]:
        if not text:
            return 0, 0, 0
        tokens = strange = 0
        words = text.split(" ")
        parts = words
        if crossed:
            parts = [text.replace(" ", MARK)]
        elif text[0] == " " or "  " in text or MARK in text:  # marks that meet
            parts = [p[1:] for p in cut(MARK + text.replace(" ", MARK))]
        for w in parts:
            got = known.get(w)
            if got is None:
                got = of_word(MARK + w)
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = got
            tokens += got[0]
            strange += got[1]
        return len(words), tokens, strange

    return count


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """One row per input row: id, n_chars, n_words (pieces of the text between single spaces), n_tokens, n_unknown.

    A null or empty text has no tokens. Texts of any length are counted whole, in linear time. The id may be null or
    repeated; other columns play no part; an empty table gives an empty result. model_file is read on the driver; the
    vocabulary (bounded by the file, not by the data) is broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_file or default_model()))

    def make() -> Callable:
        count = text_counter(shared.value)
        return lambda i, t: (i, len(t or ""), *count(t))

    id_type = df.schema[id_col].dataType
    schema = pa.schema([("i", _arrow(id_type)), ("c", pa.int64()), ("w", pa.int64()), ("t", pa.int64()), ("u", pa.int64())])
    ddl = f"__id {id_type.simpleString()}, n_chars bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
    return per_row(only(df, __id=id_col, __text=text_col), ["__id", "__text"], schema, ddl, make).withColumnRenamed("__id", id_col)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
