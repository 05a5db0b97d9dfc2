"""BM25 over candidate rows, top-k and exact pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.operators.index import Index

K1, B = 1.2, 0.75


def idf(df: int, n: int) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); 0 for an unknown term or an empty collection."""
    return F.lit(0.0) if df <= 0 or n <= 0 else F.log(1 + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))


def term_score(tf: Column, weight: Column, length: Column, avgdl: float, k1: float = K1, b: float = B) -> Column:
    if avgdl == 0:
        return F.lit(0.0)
    return F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(float(avgdl))))).otherwise(F.lit(0.0))


def scored(index: Index, found: DataFrame, terms: list[str], positive: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """found with external_id, snippet, length and score: the sum over the positive terms, in the query's order.

    The df of the query's terms and the collection's totals, a row each, are fetched; the rest is one join by doc_id.
    """
    stats = index.totals()
    df = {r.term: r.df for r in index.dictionary.filter(F.col("term").isin(positive)).select("term", "df").collect()} if positive else {}
    rows = found.join(index.documents, "doc_id")
    total: Column = F.lit(0.0)
    for t in positive:
        total = total + term_score(F.coalesce(F.col(f"tf_{terms.index(t)}"), F.lit(0)), idf(df.get(t, 0), stats.n), F.col("length"), stats.avgdl, k1, b)
    return rows.withColumn("score", total)


def top(rows: DataFrame, limit: int, offset: int = 0, digits: int | None = None) -> DataFrame:
    """The page by score, then doc_id. With digits, scores are rounded before they are compared."""
    if digits is not None:
        rows = rows.withColumn("score", F.round("score", digits))
    return page(rows, [F.desc("score"), F.asc("doc_id")], limit, offset)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if offset < 0 or limit <= 0:
        raise ValueError("offset must not be negative and limit must be positive")
    if offset + limit > 2**31 - 1:
        raise OverflowError("offset + limit is out of range")
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)
