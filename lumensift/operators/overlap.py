"""How documents overlap with many queries at once: counts by query, without a row for each pair of a document and a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.operators.index import Index

#: Up to so many (query, term) rows are sent to every task; more are joined.
MOST_SENT = 500_000
#: Pairs of a document's term and a query, and cells of documents by queries, that are counted at a time.
_PAIRS = _CELLS = 1_000_000


def overlaps(queries: DataFrame, index: Index, most_sent: int = MOST_SENT) -> DataFrame:
    """item_id, docs, most_terms, postings for queries(item_id, term): how many documents hold a term of the query, how many
    of its rows the fullest document holds, and how often its terms stand in the collection. Queries without a hit are left out.

    The last number is a sum over the dictionary. The others need a document's terms in one place: only (document, number
    of the term) is shuffled, for terms that queries have, and each task counts document by query in arrays and gives a row for each query.
    """
    postings = queries.join(index.dictionary, "term").groupBy("item_id").agg(F.sum("cf").alias("postings"))
    postings = postings.select("item_id", F.lit(0).cast("bigint").alias("docs"), F.lit(0).cast("bigint").alias("most_terms"), "postings")
    counts = _counted(queries, index.postings) if queries.count() <= most_sent else _joined(queries, index.postings)
    both = counts.select("item_id", "docs", "most_terms", F.lit(0).cast("bigint").alias("postings")).union(postings)
    return both.groupBy("item_id").agg(F.sum("docs").alias("docs"), F.max("most_terms").alias("most_terms"), F.sum("postings").alias("postings"))


def _joined(queries: DataFrame, postings: DataFrame) -> DataFrame:
    by_doc = queries.join(postings.select("term", "doc_id").distinct(), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("terms"))
    return by_doc.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max("terms").alias("most_terms"))


def _counted(queries: DataFrame, postings: DataFrame) -> DataFrame:
    spark, found = queries.sparkSession, queries.select("item_id", "term").toArrow().combine_chunks()
    item, term = (found.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("item_id", "term"))
    of, code = item.indices.to_numpy(), term.indices.to_numpy()
    ids, n_items = item.dictionary, len(item.dictionary)
    # The queries of term c are items[starts[c]:starts[c + 1]]; one that has the term in several rows is there as often.
    items = of[np.argsort(code, kind="stable")].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(term.dictionary)))])
    shared = spark.sparkContext.broadcast((starts, items))
    schema = pa.schema([("item_id", ids.type), ("docs", pa.int64()), ("most_terms", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items = shared.value
        docs, most = np.zeros(n_items, dtype=np.int64), np.zeros(n_items, dtype=np.int64)
        for row, code in _whole_documents(batches):
            ends = np.flatnonzero(np.diff(row, append=-1)) + 1  # of each document's terms
            pairs = np.cumsum(starts[code + 1] - starts[code])[ends - 1]
            at = 0
            while at < len(ends):
                done = pairs[at - 1] if at else 0
                to = min(max(at + 1, int(np.searchsorted(pairs, done + _PAIRS, "right"))), at + max(1, _CELLS // n_items))
                some = slice(ends[at - 1] if at else 0, ends[to - 1])
                c = code[some]
                n = starts[c + 1] - starts[c]
                each = np.repeat(starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cells = np.bincount(np.repeat((row[some] - row[some.start]) * n_items, n) + items[each], minlength=(to - at) * n_items).reshape(to - at, n_items)
                docs += np.count_nonzero(cells, axis=0)
                np.maximum(most, cells.max(axis=0), out=most)
                at = to
        hit = np.flatnonzero(docs)
        if len(hit):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.array(docs[hit]), pa.array(most[hit])], schema=schema)

    codes = F.broadcast(spark.createDataFrame(pa.table({"term": term.dictionary, "code": pa.array(range(len(term.dictionary)), pa.int32())})))
    rows = postings.select("term", "doc_id").join(codes, "term").select("doc_id", "code").repartition("doc_id").sortWithinPartitions("doc_id", "code")
    kind = queries.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"item_id {kind}, docs bigint, most_terms bigint").groupBy("item_id").agg(F.sum("docs").alias("docs"), F.max("most_terms").alias("most_terms"))


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of sorted rows (doc_id, code), each document in one piece, numbered from 0, its codes once each. Null is a document as well."""
    rest = None
    for batch in batches:
        rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        row, code = _numbered(rest)
        last = int(np.searchsorted(row, row[-1])) if len(row) else 0
        if last:
            yield _distinct(row[:last], code[:last])
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield _distinct(*_numbered(rest))


def _numbered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(0).combine_chunks()
    value, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    new = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.concatenate([np.zeros(min(1, len(value)), dtype=np.int64), np.cumsum(new)]), rows.column(1).combine_chunks().to_numpy()


def _distinct(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    return row[new], code[new]
