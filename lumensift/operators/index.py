"""The positional index: documents, postings, dictionary and stats, as four DataFrames or Parquet tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.functions.text import Analyzer, snippet, tokens

FORMAT_VERSION = 1
#: Tokens whose postings are grouped at a time, unless one document has more: what a Python worker needs besides its batch.
PIECE = 250_000
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("external_id", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("snippet", T.StringType())])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])


class DuplicateDocumentError(ValueError):
    pass


@dataclass(frozen=True)
class Index:
    """documents(doc_id, external_id, length, snippet), postings(term, doc_id, tf, positions), dictionary(term, df, cf), stats(n, total_len, avgdl).

    documents holds the empty ones too: they count in n and avgdl and match a negation.
    """

    documents: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    _totals: list = field(default_factory=list, repr=False, compare=False)

    def totals(self) -> Row:
        """The row of stats, read once."""
        if not self._totals:
            self._totals.append(self.stats.first())
        return self._totals[0]

    def posting_list(self, term: str | None) -> DataFrame:
        """doc_id, tf, positions of a term, by doc_id; empty for an unknown or null one."""
        return self.postings.filter(F.col("term") == F.lit(term)).select("doc_id", "tf", "positions").orderBy("doc_id")

    def posting_docs(self, term: str | None) -> DataFrame:
        """doc_id and tf only: positions are not read."""
        return self.postings.filter(F.col("term") == F.lit(term)).select("doc_id", "tf").orderBy("doc_id")

    def term_positions(self, term: str, doc_id: int) -> list[int]:
        row = self.postings.filter((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("positions").first()
        return list(row.positions) if row else []

    def document(self, doc_id: int):
        """The document's row, or None."""
        return self.documents.filter(F.col("doc_id") == doc_id).first()

    def document_count(self) -> int:
        return self.totals().n

    def document_frequency(self, term: str) -> int:
        row = self.dictionary.filter(F.col("term") == term).select("df").first()
        return row.df if row else 0

    def save(self, path: str, compression: str = "zstd") -> None:
        """Overwrites path. Postings are dealt by term, a very frequent one over several files, and sorted by term and document,
        with small row groups and a Bloom filter: a term's rows are found by statistics. A range partitioning would compute
        all postings twice, the first time for its sample.
        """
        self.documents.write.mode("overwrite").option("compression", compression).parquet(f"{path}/documents")
        sorted_postings = self.postings.hint("rebalance", "term").sortWithinPartitions("term", "doc_id")
        (
            sorted_postings.write.mode("overwrite").option("compression", compression).option("parquet.block.size", 16 << 20)
            .option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", 200_000).parquet(f"{path}/postings")
        )
        saved = load_index(self.documents.sparkSession, path, dictionary=False)
        dictionary_of(saved.postings).sort("term").write.mode("overwrite").option("compression", compression).parquet(f"{path}/dictionary")
        meta = stats_of(saved.documents).withColumns({"format_version": F.lit(FORMAT_VERSION), "codec": F.lit(compression)})
        meta.write.mode("overwrite").parquet(f"{path}/stats")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def stats_of(documents: DataFrame) -> DataFrame:
    """n, total_len and avgdl (0 without documents)."""
    sums = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_len"))
    return sums.withColumn("avgdl", F.coalesce(F.try_divide("total_len", "n"), F.lit(0.0)).cast("double"))


def build_index(docs: DataFrame, analyzer: Analyzer = tokens, check_ids: bool = False) -> Index:
    """An index of docs(doc_id, external_id, text). With check_ids, a null, repeated or non-positive doc_id is an error.

    All of it is narrow: a document is one row, so its postings are grouped where it is read. save() has the one shuffle.
    """
    if check_ids:
        bad = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL OR doc_id <= 0").first()
        if bad:
            raise DuplicateDocumentError(f"Duplicate or invalid docId: {bad.doc_id}")
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("external_id").cast("string").alias("external_id"), "text", analyzer(F.col("text")).alias("toks"))
    documents = split.select("doc_id", "external_id", F.size("toks").alias("length"), snippet(F.col("text")).alias("snippet"))
    postings = split.select("doc_id", "toks").mapInArrow(_grouped, "term string, doc_id bigint, tf int, positions array<int>")
    return Index(documents, postings, dictionary_of(postings), stats_of(documents))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, doc_id, tf, positions of rows (doc_id, toks), by array operations over the rows of at most PIECE tokens at a time, or one row.

    Spark's own grouping would shuffle every (term, doc_id), though all of a document lies in one row, and its higher-order
    functions take ten times as long for the same.
    """
    for batch in batches:
        at, offsets = 0, batch.column(1).offsets.to_numpy()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            yield from _postings(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at))
            at = end
        del batch  # before the next one is read


def _postings(ids: pa.Array, toks: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """term, doc_id, tf, positions of some documents. This takes some 80 bytes a token besides the tokens."""
    lengths = np.diff(toks.offsets.to_numpy())
    words = toks.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    code = words.indices.to_numpy().astype(np.int64)
    order = np.argsort(row * (len(words.dictionary) + 1) + code, kind="stable")
    row, code = row[order], code[order]
    first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
    bounds = np.append(first, len(order)).astype(np.int32)
    for a in range(0, len(first), 50_000):
        b = min(len(first), a + 50_000)
        lists = pa.ListArray.from_arrays(pa.array(bounds[a : b + 1] - bounds[a]), pa.array(at[order[bounds[a] : bounds[b]]]))
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[first[a:b]])), ids.take(pa.array(row[first[a:b]])), pa.array(np.diff(bounds[a : b + 1])), lists], names=["term", "doc_id", "tf", "positions"]
        )


def load_index(spark: SparkSession, path: str, reader: str = "disk", dictionary: bool = True) -> Index:
    """Opens a saved index, lazily. reader is accepted for compatibility: both kinds read Parquet through the page cache."""
    if reader not in ("disk", "mmap"):
        raise ValueError(f"unknown reader {reader}")
    documents, postings = (spark.read.schema(s).parquet(f"{path}/{n}").select(*s.names) for n, s in (("documents", DOCUMENTS), ("postings", POSTINGS)))
    if not dictionary or not _exists(spark, f"{path}/dictionary"):  # an index of streamed segments has none of its own
        return Index(documents, postings, dictionary_of(postings), stats_of(documents))
    stats = spark.read.parquet(f"{path}/stats")
    version = stats.first().format_version
    if version > FORMAT_VERSION:
        raise ValueError(f"format version {version} is newer than {FORMAT_VERSION}")
    return Index(documents, postings, spark.read.parquet(f"{path}/dictionary"), stats.select("n", "total_len", "avgdl"))


def index_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row on a saved index: format_version, codec, n, total_len, avgdl, terms, postings, and the bytes of its tables (map)."""
    index, stats = load_index(spark, path), spark.read.parquet(f"{path}/stats")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sizes = {n: fs.getContentSummary(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")).getLength() for n in ("documents", "postings", "dictionary", "stats")}
    counts = index.dictionary.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))  # one row
    codec = F.col("codec") if "codec" in stats.columns else F.lit("zstd")
    return stats.crossJoin(counts).select(
        "format_version", codec.alias("codec"), "n", "total_len", "avgdl", "terms", "postings", F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)).alias("bytes")
    )
