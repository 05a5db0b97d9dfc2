"""What each table codec costs: how long an index takes to write, how large it is, and how fast a first and a second query are."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from lumensift.engine import SearchEngine
from lumensift.operators.index import build_index, index_meta

CODECS = ("none", "snappy", "gzip", "zstd")


def _seconds(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def index_report(docs: DataFrame, path: str, query: str, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """codec, write_seconds, bytes, postings_bytes, cold_seconds, warm_seconds: an index of docs is written below path with each codec and queried twice."""
    spark, rows = docs.sparkSession, []
    for codec in codecs:
        at = f"{path}/{codec}"
        write = _seconds(lambda: build_index(docs).save(at, codec))  # noqa: B023
        size = index_meta(spark, at).first().bytes
        search = lambda: SearchEngine.open(spark, at).search(query).collect()  # noqa: E731, B023
        rows.append((codec, write, sum(size.values()), size["postings"], _seconds(search), _seconds(search)))
    return spark.createDataFrame(rows, "codec string, write_seconds double, bytes bigint, postings_bytes bigint, cold_seconds double, warm_seconds double")
