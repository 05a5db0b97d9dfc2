"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages treat rows alike: a row is told apart by doc_id and text (language ID: by doc_id and declared language), so null
and repeated ids are rows like any other; a null text counts as empty; texts are read whole, however long; an empty table
passes as an empty one; columns beyond those used are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm import decontaminate, exact_dedup, langid, mixing, simhash
from lumensift.llm.common import only_staged, table
from lumensift.llm.queries import TARGETS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier rejects go; lang becomes what it found. Rows are told apart by doc_id and declared language."""
    model = langid.train(docs, "text", "lang", "doc_id")
    found = langid.identify(docs, model, host=F.col("source"), declared=F.col("lang"))
    verdict = found.filter("kept").groupBy(F.col("doc_id").alias("__id"), F.col("declared_lang").alias("__declared")).agg(F.min("lang").alias("__lang"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & F.lower(docs["lang"]).eqNullSafe(F.col("__declared"))
    return docs.join(verdict, same).withColumn("lang", F.col("__lang")).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z's case, the row with the largest doc_id stays, null ids coming last; of rows alike in both, one."""
    return exact_dedup.keep_one_row(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are similar (0.8 or more, estimated by SimHash), directly or through others, the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window that is similar to an item of benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a row for each chosen document and epoch; rows with one id stand and fall together."""
    return mixing.mix(docs, TARGETS)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_stage),
]

#: SimHash groups have no SQL; tests/llm/test_pipeline.py holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's tables lie in the shared folder until its result is written, which the next one reads."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = only_staged(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"), spark, *before)  # noqa: B023
        before = [docs]
    return docs
