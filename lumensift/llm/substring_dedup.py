"""Substring deduplication: windows of words that start in a document with a smaller id are found with FM-indexes per shard.

1. Each window has a minimizer. A run of neighbouring windows with one minimizer is a segment of words. Grouped by
   minimizer, those that only one document has fall away, and with them most of the text: they can't belong to a repeated
   window, as equal windows have equal minimizers.
2. Where all segments under a minimizer are alike (by a 128-bit BLAKE2b digest of their words), all their windows first
   stand in the smallest document, and there is nothing to search. The hashes of words and minimizers only bring texts
   together; what is equal is told by such digests or by the words themselves.
3. The other segments go to the shard of their minimizer, which so sees all places of its windows; equal segments are one
   by then. A shard is an FM-index of its segments. They are streamed against it by backward search: where a segment's
   matching statistics reach the window's length, the interval's smallest document id is that of the window's first document.
4. Each document drops the words that its repeated windows cover.

The segments of a minimizer with very many different ones are grouped by whole windows instead, so no shard is larger than
a task can hold. Nothing is dropped by that. Texts are never staged: they are shuffled twice, once to meet their shared
minimizers and once to meet what they drop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import discard, lookup, only, staged
from lumensift.llm.fm_index import matching_first
from lumensift.llm.token_counts import _arrow
from lumensift.llm.windows import digest, minimizers, run_digests, runs, split, words_of

GRAM = 5
#: Characters taken at a time; segments in one index, at least; different segments above which a minimizer goes by whole windows.
PIECE, SHARD, HOT = 2_000_000, 6_000, 5_000


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list]]:
    """[a, b) of rows with about PIECE characters together (one row at least), and their texts."""
    texts = batch.column(column).to_pylist()
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < PIECE):
            size += len(texts[b] or "")
            b += 1
        yield a, b, texts[a:b]
        a = b


def _document_minimizers(docs: DataFrame, window: int, keys: bool) -> DataFrame:
    """v, __id: a row for each minimizer of each document; with keys a row for each different segment, with its digest (d0, d1)."""
    kind = docs.schema["__id"].dataType
    schema = pa.schema([("v", pa.int64()), ("__id", _arrow(kind)), *([("d0", pa.int64()), ("d1", pa.int64())] if keys else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in _pieces(batch, 1):
                w = words_of(texts)
                first, place, value = minimizers(w, window, min(GRAM, window))
                start, end = runs(first, place)
                if not len(start):
                    continue
                text, v = np.searchsorted(w.first, first[start], side="right") - 1, value[start]
                by = [v, text]
                if keys:
                    d = run_digests(w, first[start], first[end - 1] + window)
                    by = [d[:, 1], d[:, 0], *by]
                order = np.lexsort(by)
                new = order[np.flatnonzero(np.any([np.diff(x[order], prepend=x[order[0]] ^ 1) != 0 for x in by], axis=0))]
                columns = [pa.array(v[new]), batch.column(0).take(pa.array(text[new] + a)), *([pa.array(d[new, 0]), pa.array(d[new, 1])] if keys else [])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("__id", "__text").mapInArrow(run, f"v bigint, __id {kind.simpleString()}" + ", d0 bigint, d1 bigint" * keys)


def _segments(flagged: DataFrame, window: int) -> DataFrame:
    """For rows (__id, __th, __text, flags), flags being (v, first, alone) of the document's shared minimizers:

    __id, __th, late: the windows of segments that are alone under their minimizer and whose first document is an earlier one;
    __id, __th, v, start (word), key (a digest of the words), words: each segment of the other minimizers.
    """
    kind = flagged.schema["__id"].dataType
    schema = pa.schema([
        ("__id", _arrow(kind)), ("__th", pa.int64()), ("late", pa.list_(pa.int64())), ("v", pa.int64()), ("start", pa.int64()), ("key", pa.binary()), ("words", pa.string()),
    ])

    def out(batch: pa.RecordBatch, row: int, n: int, late: list, v: list, start: list, data: list) -> pa.RecordBatch:
        same = pa.array([row] * n)
        digests = [d if d is None else digest(d) for d in data]
        columns = [late, v, start, digests, [d if d is None else d.decode("utf-8", "surrogatepass") for d in data]]
        return pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[pa.RecordBatch] = []
            for a, b, texts in _pieces(batch, 2):
                w = words_of(texts)
                first, place, value = minimizers(w, window, min(GRAM, window))
                start, end = runs(first, place)
                bounds = np.searchsorted(first[start], w.first)
                for k in range(b - a):
                    flags, i = batch.column(3)[a + k].values, batch.column(0)[a + k]
                    vs = flags.field("v").to_numpy()
                    order = np.argsort(vs)
                    own = np.arange(bounds[k], bounds[k + 1])
                    at = order[np.minimum(np.searchsorted(vs, value[start[own]], sorter=order), len(vs) - 1)]
                    own, at = (x[vs[at] == value[start[own]]] for x in (own, at))
                    alone = flags.field("alone").to_numpy(zero_copy_only=False)[at]
                    late = own[alone & pc.less(flags.field("first"), i).to_numpy(zero_copy_only=False)[at]]
                    if len(late):
                        windows = np.concatenate([first[start[j] : end[j]] for j in late]) - w.first[k]
                        found.append(out(batch, a + k, 1, [windows], [None], [None], [None]))
                    rest = own[~alone]
                    for j in range(0, len(rest), 5000):
                        part = rest[j : j + 5000]
                        data = [w.text(first[start[x]], first[end[x] - 1] + window) for x in part]
                        found.append(out(batch, a + k, len(part), [None] * len(part), value[start[part]], first[start[part]] - w.first[k], data))
                    if len(found) >= 200:
                        yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                        found = []
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    ddl = f"__id {kind.simpleString()}, __th bigint, late array<bigint>, v bigint, start bigint, key binary, words string"
    return flagged.select("__id", "__th", "__text", "flags").mapInArrow(run, ddl)


def _indexed(shards: DataFrame, window: int) -> DataFrame:
    """key, firsts: for rows (v, key, words, first) dealt and sorted by v, an FM-index for each lot of whole minimizers."""
    kind = shards.schema["first"].dataType
    schema = pa.schema([("v", pa.int64()), ("key", pa.binary()), ("firsts", pa.list_(_arrow(kind)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[tuple] = []

        def out() -> pa.RecordBatch:
            found = matching_first([split(r[2]) for r in lot], np.array([r[3] for r in lot]), window)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in lot]), pa.array([r[1] for r in lot], pa.binary()), pa.array([f.tolist() for f in found], schema.field(2).type)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(lot) >= SHARD and row[0] != lot[-1][0]:
                    yield out()
                    lot = []
                lot.append(row)
        if lot:
            yield out()

    return shards.select("v", "key", "words", "first").mapInArrow(run, f"v bigint, key binary, firsts array<{kind.simpleString()}>")


def first_documents(segments: DataFrame, window: int) -> DataFrame:
    """segment (its v and key), n (rows of segments with it), firsts (the first document of each of its windows), where a later document has a window of it."""
    distinct = staged(
        segments.groupBy("v", "key").agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    sizes = distinct.groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("rows", F.col("k"))
    sized = staged(lookup(distinct, sizes, "v", "rows", salt="key"), "sized")
    discard(distinct, shuffles=True)
    keys = ["v", "key"]
    firsts = _indexed(sized.filter(f"k <= {HOT}").select(*keys, "words", "first").repartition("v").sortWithinPartitions("v"), window)
    parts = F.split("words", " ")
    places = F.sequence(F.lit(1), F.size(parts) - (window - 1))
    whole = sized.filter(f"k > {HOT}").select(*keys, "first", F.posexplode(F.transform(places, lambda i: F.array_join(F.slice(parts, i, window), " "))).alias("i", "text"))
    least = whole.groupBy("text").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    by_window = lookup(whole, least, "text", "n", salt="key").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "least"))), lambda x: x["least"]).alias("firsts"))
    joined = firsts.union(by_window).join(sized.select(*keys, "last", "n"), keys)
    out = staged(joined.filter(F.array_min("firsts") < F.col("last")).select(_segment(), "n", "firsts"), "firsts")
    discard(sized, shuffles=True)
    return out


def _segment() -> Column:
    return F.concat(F.hex("v"), F.lit(":"), F.hex("key")).alias("segment")


def removals(docs: DataFrame, window: int) -> DataFrame:
    """__id, __th, windows: the first words of each document's repeated windows. docs has __id, __th (a hash of the text) and __text."""
    named = docs.filter("__id is not null")
    both = _document_minimizers(named, window, keys=True).groupBy("v").agg(
        F.min("__id").alias("first"), F.max("__id").alias("last"), F.count(F.lit(1)).alias("n"),
        *(f(d).alias(f"{f.__name__}_{d}") for d in ("d0", "d1") for f in (F.min, F.max)),
    )
    # Two documents or more: the least and the greatest id differ.
    shared = staged(both.filter("first < last").select("v", "n", "first", F.expr("min_d0 = max_d0 AND min_d1 = max_d1").alias("alone")), "shared")
    pairs = lookup(_document_minimizers(named, window, keys=False), shared, "v", "n", salt="__id").filter("alone is not null")
    flags = staged(pairs.groupBy("__id").agg(F.collect_list(F.struct("v", "first", "alone")).alias("flags")), "flags")
    discard(shared, shuffles=True)
    found = staged(_segments(named.join(flags, "__id").select("__id", "__th", "__text", "flags"), window), "segments")
    discard(flags, shuffles=True)
    segments = found.filter("v is not null")
    firsts = first_documents(segments, window)
    placed = segments.select("__id", "__th", "start", _segment())
    known = lookup(placed, firsts, "segment", "n").filter("firsts is not null")
    late = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("__id"), F.col("start") + i)), lambda x: x.isNotNull())
    every = known.select("__id", "__th", late.alias("late")).filter(F.size("late") > 0).union(found.filter("v is null").select("__id", "__th", "late"))
    out = staged(every.groupBy("__id", "__th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("late")))).alias("windows")), "removals")
    discard(found, firsts, shuffles=True)
    return out


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, with_text, kept_text (the kept words joined by one space).

    A word goes if a window of `window` words covers it whose words also start in a document with a smaller id; windows are
    judged on the input. Null and empty texts have no words. A row with a null id is compared with none and kept whole;
    rows that repeat an id count as one document. Other columns play no part; an empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be a word at least")
    docs = only(df, __id=id_col, __text=text_col).withColumn("__th", F.xxhash64("__text"))
    kind = df.schema[id_col].dataType
    # What a document drops is small beside its text: it is joined by id, the text's hash tells rows with one id apart.
    drop = removals(docs, window).select(F.col("__id").alias("__of"), F.col("__th").alias("__oh"), "windows")
    joined = docs.join(drop, (F.col("__id") == F.col("__of")) & (F.col("__th") == F.col("__oh")), "left").select("__id", "__text", "windows")
    schema = pa.schema([("i", _arrow(kind)), ("n", pa.int64()), ("r", pa.int64()), ("s", pa.string()), *([("t", pa.string())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _pieces(batch, 1):
                rows = []
                for k, text in enumerate(texts):
                    words, gone = split(text), batch.column(2)[a + k]
                    kept = words
                    if gone.is_valid:
                        cover = np.zeros(len(words) + 1, dtype=np.int32)
                        at = gone.values.to_numpy()
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        kept = [words[j] for j in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                    whole = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), *([whole.decode("utf-8", "surrogatepass")] if with_text else [])))
                columns = [pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], schema=schema)

    ddl = f"__id {kind.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(run, ddl).withColumnRenamed("__id", id_col)
