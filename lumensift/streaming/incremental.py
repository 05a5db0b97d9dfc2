"""Adding documents to a saved index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumensift.functions.text import Analyzer, tokens
from lumensift.operators.index import build_index


def append_batch(docs: DataFrame, path: str, analyzer: Analyzer = tokens, batch: int = 0) -> None:
    """Writes one batch of documents as a segment of the index folder: path/documents and path/postings under segment=batch.

    A batch that is run again overwrites its own segment, so each document counts once. Ids must be new.
    """
    index = build_index(docs, analyzer)
    index.documents.write.mode("overwrite").parquet(f"{path}/documents/segment={batch}")
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/segment={batch}")


def index_stream(docs: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = tokens) -> StreamingQuery:
    """Indexes a streaming DataFrame of doc_id, external_id, text until all that is there is done."""
    writer = docs.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, path, analyzer, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
