"""Language identification by Bayesian fusion of the text with what is declared, the address and the host.

The text's evidence is a naive Bayes likelihood of hashed byte trigrams. To it are added the log odds of the declared
language (a column, or the lang attribute of the document's own markup), of the address suffix (a country's domain or a
/xx/ path) and the prior of the host, whose counts are smoothed towards those of its parent (the registered domain, or
the name without its number), and these towards those of the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import discard, lookup, only, pieces, staged
from lumensift.llm.token_counts import _arrow
from lumensift.workspace import once

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Bytes of text scored at a time, unless one text has more: trigrams take some 40 bytes a byte.
PIECE = 500_000
#: A-Z become a-z and all other ASCII but letters a space: digits, addresses and marks speak for no language.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in bytes(range(256)).lower())
#: Country domains that speak for a language.
COUNTRIES = {
    "de": "de at li", "fr": "fr mc", "es": "es mx ar cl co pe ve uy py bo ec cr gt hn ni pa sv cu do", "en": "uk us au ie nz ca", "it": "it sm va", "pt": "pt br ao mz", "nl": "nl sr", "pl": "pl", "cs": "cz",
    "sk": "sk", "sl": "si", "hr": "hr", "hu": "hu", "ro": "ro md", "bg": "bg", "el": "gr cy", "tr": "tr", "ru": "ru su by kz", "uk": "ua", "sv": "se", "no": "no", "da": "dk", "fi": "fi", "is": "is", "et": "ee",
    "lv": "lv", "lt": "lt", "ja": "jp", "ko": "kr", "zh": "cn tw hk mo", "vi": "vn", "th": "th", "id": "id", "fa": "ir", "he": "il", "ar": "sa eg ae jo iq kw qa", "sq": "al", "sr": "rs", "mk": "mk", "ka": "ge", "hy": "am",
}
SUFFIXES = {country: language for language, countries in COUNTRIES.items() for country in countries.split()}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray = field(repr=False)  # languages x BUCKETS, float32


@dataclass(frozen=True)
class Settings:
    """text_weight tempers the trigrams, which overlap; declared_error and suffix_error are the chances that either misleads;
    smoothing is the number of pseudo-documents of the next level up. A document is rejected below min_prob, and if its
    trigrams are on average more than strange + strange_short / sqrt(their number) nats less likely than the language's own."""

    text_weight: float = 1 / 3
    declared_error: float = 0.05
    suffix_error: float = 0.2
    smoothing: float = 20.0
    min_prob: float = 0.5
    strange: float = 4.0
    strange_short: float = 6.0


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all byte trigrams of the texts, and where each text's begin. Only letters count, and a text is padded by a space."""
    data = [b" " + (t or "").encode("utf-8", "replace").translate(_LETTERS) + b" " for t in texts]
    lengths = np.fromiter((len(d) for d in data), dtype=np.int64, count=len(data))
    raw = np.frombuffer(b"".join(data) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    code = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    ends = np.cumsum(lengths)
    inside = np.ones(len(code), dtype=bool)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    counts = np.maximum(lengths - 2, 0)
    return code[inside].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def train(df: DataFrame, text_col: str, label_col: str, id_col: str, languages: Sequence[str] | None = None, rows: int = 20_000, alpha: float = 0.05, least_grams: int = 1000) -> Model:
    """Fits the trigram model on about `rows` labelled rows, drawn label by label by a hash of id and text; trigrams are counted on the executors.

    No label gives more rows than it takes for all to give `rows`, so a rare one gives all it has. Labels whose sample has
    fewer than least_grams trigrams are left out, if any has more. Each language is smoothed, by alpha x BUCKETS trigrams,
    towards all of them together, so what no language has seen is as unlikely under a rare label as under a common one.
    Without a list all labels are learnt; the sample bounds their number, and the driver receives at most labels x BUCKETS
    sums. Where no labelled row has a trigram, the model has one language, UNKNOWN, under which all trigrams
    are alike.
    """
    labelled = only(df, __id=id_col, __text=text_col, label=label_col).filter("label is not null and __text is not null")
    if languages is not None:
        labelled = labelled.filter(F.col("label").isin(list(languages)))
    drawn = labelled.withColumn("h", F.xxhash64("__id", "__text", F.lit(5)))
    counts = staged(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    most = F.lit(_level(counts, rows))
    # Only hashes are dealt by label; the texts of the rows that are drawn, a bounded number, are then picked out where they lie.
    share = lookup(drawn.select("label", "h"), counts.withColumn("share", most / F.col("n")), "label", "n", salt="h")
    kept = (F.col("share") >= 1) | (F.shiftrightunsigned("h", 1).cast("double") < F.col("share") * float(1 << 63))
    keys = staged(share.filter(kept).select("label", "h").distinct(), "sample-keys")
    sample = drawn.join(F.broadcast(keys), ["label", "h"], "left_semi").groupBy("label", "h").agg(F.first("__text").alias("__text"))
    schema = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                found, _ = trigrams([text.as_py()])
                sums.setdefault(label.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                sums[label.as_py()] += np.bincount(found, minlength=BUCKETS)
                if len(sums) > 256:
                    yield from flush(sums)
        yield from flush(sums)

    def flush(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some)), pa.array(some, pa.int32()), pa.array(n[some])], schema=schema)
        sums.clear()

    counted = staged(sample.select("__text", "label").mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    enough = totals.filter(F.col("total") >= least_grams)
    seen = sorted(r.label for r in (enough if enough.limit(1).count() else totals).select("label").collect())
    found = counted.filter(F.col("label").isin(seen)).toArrow() if seen else None
    names = tuple(seen) or (UNKNOWN,)
    n = np.zeros((len(names), BUCKETS))
    if found is not None:
        index = {language: k for k, language in enumerate(names)}
        n[np.array([index[x] for x in found.column(0).to_pylist()], dtype=np.int64), found.column(1).to_numpy()] = found.column(2).to_numpy()
    discard(counts, keys, counted)
    common = (n.sum(axis=0) + alpha) / (n.sum() + alpha * BUCKETS)
    return Model(names, np.log((n + alpha * BUCKETS * common) / (n.sum(axis=1, keepdims=True) + alpha * BUCKETS)).astype(np.float32))


def _level(counts: DataFrame, rows: int) -> float:
    """The most that each label of counts(label, n) may give so that together they give no more than `rows`, to a fifth below; no fewer than one."""
    levels = [max(1.0, rows * 2 ** (-k / 4)) for k in range(4 * max(1, rows).bit_length() + 1)]
    sums = counts.agg(*(F.sum(F.least(F.col("n").cast("double"), F.lit(x))).alias(f"s{k}") for k, x in enumerate(levels))).first()
    return next((x for x, s in zip(levels, sums, strict=True) if s is None or s <= rows), 1.0)


def text_evidence(df: DataFrame, model: Model, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """__id, ll (log likelihood of each language, in the model's order), n_grams, letters, and the columns of keep."""
    shared = df.sparkSession.sparkContext.broadcast(model.log_p)
    source = df.select(id_col, text_col, *keep)
    ids = [(f.name, f.dataType) for f in source.schema.fields if f.name != text_col]
    schema = pa.schema([*((n, _arrow(t)) for n, t in ids), ("ll", pa.list_(pa.float64())), ("n_grams", pa.int64()), ("letters", pa.bool_())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in batches:
            for at, end in pieces(batch.column(1), PIECE):
                texts = batch.column(1).slice(at, end - at).to_pylist()
                found, starts = trigrams(texts)
                sums = np.zeros((len(log_p), end - at))
                some = np.flatnonzero(starts[1:] > starts[:-1])
                if len(some):
                    for k, row in enumerate(log_p):
                        sums[k, some] = np.add.reduceat(row[found], starts[:-1][some], dtype=np.float64)
                rest = [batch.column(k).slice(at, end - at) for k in range(batch.num_columns) if k != 1]
                letters = [any(map(str.isalpha, t or "")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(sums.T.tolist(), pa.list_(pa.float64())), pa.array(np.diff(starts)), pa.array(letters)], schema=schema
                )
            del batch  # before the next one is read

    ddl = ", ".join([*(f"`{n}` {t.simpleString()}" for n, t in ids), "ll array<double>, n_grams bigint, letters boolean"])
    return source.mapInArrow(score, ddl)


def parent_of(host: Column) -> Column:
    """The registered domain of a dotted host (its last two labels), else the name without its digits."""
    return F.when(F.instr(host, ".") > 0, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_replace(host, r"\d+", ""))


def host_priors(scored: DataFrame, languages: Sequence[str], smoothing: float) -> DataFrame:
    """host, n (rows), prior (an array over the languages): counts of the texts' likeliest languages by host, parent and corpus.

    Counts travel as (name, language, count) rows and become a map by name, so the plan does not grow with the languages.
    """
    each = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    entries = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("best", c)), lambda x: x["best"].isNotNull()))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("best").isNotNull(), F.col(c))), F.lit(0.0))
    of = lambda counts, k: F.coalesce(F.element_at(counts, k), F.lit(0.0))
    counts = staged(scored.groupBy("host", "best").agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("parent", parent_of(F.col("host"))), "hosts")
    hosts = counts.groupBy("host", "parent").agg(F.sum("c").cast("bigint").alias("n"), entries("c").alias("own"), total("c").alias("own_total"))
    above = counts.groupBy("parent", "best").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("hosts"))
    parents = above.groupBy("parent").agg(F.sum("hosts").alias("hosts"), entries("c").alias("upper"), total("c").alias("upper_total"))
    corpus = counts.groupBy("best").agg(F.sum("c").alias("c")).agg(entries("c").alias("all"), total("c").alias("all_total"))  # one row
    upper = lambda k: (of("upper", k) + smoothing * (of("all", k) + 1) / (F.col("all_total") + len(languages))) / (F.col("upper_total") + smoothing)
    priors = parents.crossJoin(F.broadcast(corpus)).select("parent", "hosts", F.transform(each, upper).alias("above"))
    both = lookup(hosts, priors, "parent", "hosts", salt="host")
    own = F.transform("above", lambda u, k: (of("own", k) + smoothing * u) / (F.col("own_total") + smoothing))
    return both.select("host", "n", own.alias("prior"))


def _says(named: Column, languages: Sequence[str], error: float) -> Callable[[Column], Column]:
    """k -> the log likelihood of what is named under language k; 0 if it names none of them."""
    place = F.array_position(F.array(*map(F.lit, languages)), named)
    other = math.log(error / max(1, len(languages) - 1))
    return lambda k: F.when(F.coalesce(place, F.lit(0)) == 0, F.lit(0.0)).when(place == k + 1, F.lit(math.log(1 - error))).otherwise(F.lit(other))


def _likeliest(scores: Column) -> Column:
    """(x, k): the largest score and its place; the first of equal ones."""
    best = F.array_max(F.transform(scores, lambda x, k: F.struct(x.alias("x"), (-k).alias("k"))))
    return F.struct(best["x"].alias("x"), (-best["k"]).alias("k"))


def declared_in_markup(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def suffix_language(url: Column) -> Column:
    """By a /xx/ path (or its end), else by the country domain; null if neither says anything."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1))
    country = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*\.([a-zA-Z]{2})(?:[:/?#]|$)", 1))
    table = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    own = F.when(path.isin(sorted(COUNTRIES)), path)
    return F.coalesce(own, F.element_at(table, country))


def identify(
    df: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    url: Column | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per input row: id, lang (the likeliest), prob, text_lang (by the text alone), declared_lang, suffix_lang, n_grams, kept.

    host, declared and url are expressions over df, each optional; a null one says nothing. kept is false for a text
    without any letter, for one that no language explains (see Settings) and where the
    likeliest language has less than min_prob. A null text counts as empty and is rejected; lang then comes from the other
    evidence. Ids may be null or repeat; other columns play no part; an empty table gives an empty result.
    """
    names, s = model.languages, settings
    null = F.lit(None).cast("string")
    source = df.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.coalesce(host if host is not None else null, F.lit("")).alias("host"),
        F.lower(declared if declared is not None else null).alias("declared_lang"), (suffix_language(url) if url is not None else null).alias("suffix_lang"),
    )
    scored = text_evidence(source, model, "__id", "__text", ["host", "declared_lang", "suffix_lang"])
    scored = staged(scored.withColumn("best", F.when(F.col("n_grams") > 0, _likeliest(F.col("ll"))["k"])), "evidence")
    both = lookup(scored, host_priors(scored, names, s.smoothing), "host", "n", salt="__id")
    declares, suffixed = _says(F.col("declared_lang"), names, s.declared_error), _says(F.col("suffix_lang"), names, s.suffix_error)
    log_post = F.transform("ll", lambda x, k: x * s.text_weight + F.log(F.get("prior", k)) + declares(k) + suffixed(k))
    fused = once(both, "lp", log_post).withColumn("win", _likeliest(F.col("lp"))).withColumns({"top": F.col("win.x"), "k": F.col("win.k")})
    prob = 1 / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.array(*map(F.lit, names))
    own = F.array(*map(F.lit, (float(x) for x in (np.exp(model.log_p) * model.log_p).sum(axis=1))))
    grams = F.greatest(F.col("n_grams"), F.lit(1))
    usual = F.get("ll", F.col("k")) / grams >= F.get(own, F.col("k")) - s.strange - s.strange_short / F.sqrt(grams)
    return fused.withColumn("prob", prob).select(
        F.col("__id").alias(id_col), F.get(language, F.col("k")).alias("lang"), F.round("prob", 6).alias("prob"), F.get(language, F.col("best")).alias("text_lang"),
        "declared_lang", "suffix_lang", "n_grams", (F.col("letters") & usual & (F.col("prob") >= s.min_prob)).alias("kept"),
    )
