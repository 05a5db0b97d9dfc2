"""Boolean and positional operators on posting tables (doc_id, tf, positions), as joins.

tf is a row's frequency: the number of its positions, or, where an operand carries none, the larger frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions import positions as P


def _sides(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    r = right.select(F.col("doc_id").alias("rd"), F.col("tf").alias("rf"), F.col("positions").alias("rp"))
    l = left.select(F.col("doc_id").alias("ld"), F.col("tf").alias("lf"), F.col("positions").alias("lp"))  # noqa: E741
    return l.join(r, F.col("ld") == F.col("rd"), how)


def _row(doc_id: Column, places: Column, otherwise: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), F.when(F.size(places) > 0, F.size(places)).otherwise(otherwise).cast("int").alias("tf"), places.alias("positions")]


def and_(left: DataFrame, right: DataFrame) -> DataFrame:
    return _sides(left, right, "inner").select(*_row(F.col("ld"), P.merged(F.col("lp"), F.col("rp")), F.greatest("lf", "rf")))


def and_docs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left whose document is in right: no positions move."""
    return left.join(right.select("doc_id"), "doc_id", "left_semi")


def or_(left: DataFrame, right: DataFrame) -> DataFrame:
    both = _sides(left, right, "full")
    places = P.merged(F.coalesce("lp", P.none()), F.coalesce("rp", P.none()))
    return both.select(*_row(F.coalesce("ld", "rd"), places, F.greatest("lf", "rf")))


def and_not(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id"), "doc_id", "left_anti")


def not_(child: DataFrame, documents: DataFrame) -> DataFrame:
    """All documents but child's, without positions."""
    rest = documents.select("doc_id").join(child.select("doc_id"), "doc_id", "left_anti")
    return rest.select("doc_id", F.lit(0).alias("tf"), P.none().alias("positions"))


def _positional(left: DataFrame, right: DataFrame, anchors: Column) -> DataFrame:
    found = _sides(left, right, "inner").select(F.col("ld").alias("doc_id"), F.explode(F.array(anchors)).alias("positions")).filter(F.size("positions") > 0)
    return found.select("doc_id", F.size("positions").alias("tf"), "positions")


def adjacent(left: DataFrame, right: DataFrame) -> DataFrame:
    return _positional(left, right, P.adjacent(F.col("lp"), F.col("rp")))


def near(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    return _positional(left, right, P.near(F.col("lp"), F.col("rp"), k))
