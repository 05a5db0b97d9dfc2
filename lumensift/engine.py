"""The search facade over an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.operators import ranking
from lumensift.operators.index import Index, load_index
from lumensift.plans.language import parse
from lumensift.plans.planner import candidates


@dataclass(frozen=True)
class SearchPage:
    """total counts all matches exactly; results holds the page's rows."""

    total: int
    offset: int
    limit: int
    results: list

    def __post_init__(self):
        if self.total < 0 or self.offset < 0 or self.limit <= 0:
            raise ValueError("total and offset must not be negative and limit must be positive")

    @property
    def has_more(self) -> bool:
        return self.offset + len(self.results) < self.total


class SearchEngine:
    def __init__(self, index: Index, k1: float = ranking.K1, b: float = ranking.B):
        self.index, self.k1, self.b = index, k1, b

    @classmethod
    def open(cls, spark: SparkSession, path: str, reader: str = "disk") -> SearchEngine:
        return cls(load_index(spark, path, reader))

    def execute(self, query: str) -> DataFrame:
        """doc_id, frequency, positions (the anchors) of all matches."""
        return candidates(self.index, query, anchors=True).select("doc_id", "frequency", "positions")

    def scores(self, query: str) -> DataFrame:
        """doc_id, external_id, score, snippet of all matches, in no order."""
        node = parse(query)
        rows = ranking.scored(self.index, candidates(self.index, node), node.terms(), node.positive_terms(), self.k1, self.b)
        return rows.select("doc_id", "external_id", "score", "snippet")

    def score_document(self, query: str, doc_id: int) -> float:
        """The BM25 of one document for the query's positive terms, whether or not it matches; 0 if it is unknown."""
        node = parse(query)
        terms = node.positive_terms()
        if not terms:
            return 0.0
        rows = self.index.postings.filter(F.col("term").isin(terms) & (F.col("doc_id") == doc_id))
        pivot = rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{k}") for k, t in enumerate(terms)))
        row = ranking.scored(self.index, pivot, terms, terms, self.k1, self.b).select("score").first()
        return row.score if row else 0.0

    def _rows(self, query: str, ranked: bool) -> DataFrame:
        if ranked:
            return self.scores(query)
        found = candidates(self.index, query).select("doc_id").join(self.index.documents, "doc_id")
        return found.select("doc_id", "external_id", F.lit(0.0).alias("score"), "snippet")

    def search(self, query: str, k: int = 10, rank: bool = True, offset: int = 0) -> DataFrame:
        """The top k by score (else by doc_id): doc_id, external_id, score, snippet. None for k of 0 or less."""
        rows = self._rows(query, rank)
        if k <= 0:
            return rows.limit(0)
        return ranking.top(rows, k, offset) if rank else ranking.page(rows, [F.asc("doc_id")], k, offset)

    def total(self, query: str) -> int:
        """The number of matches; the join keeps only documents with metadata."""
        return candidates(self.index, query).select("doc_id").join(self.index.documents.select("doc_id"), "doc_id", "left_semi").count()

    def diagnostics(self, query: str, rows: DataFrame) -> DataFrame:
        """rows with term_positions: for the terms of the query, negated ones too, that a document holds, in the query's order."""
        terms = parse(query).terms()
        order = F.create_map(*(x for k, t in enumerate(terms) for x in (F.lit(t), F.lit(k))))
        of = self.index.postings.filter(F.col("term").isin(terms)).join(rows.select("doc_id"), "doc_id", "left_semi")
        entries = F.array_sort(F.collect_list(F.struct(F.element_at(order, F.col("term")).alias("k"), "term", "positions")))
        found = of.groupBy("doc_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["term"], e["positions"]))).alias("term_positions"))
        empty = F.create_map().cast("map<string,array<int>>")
        return rows.join(found, "doc_id", "left").withColumn("term_positions", F.coalesce("term_positions", empty))

    def search_detailed(self, query: str, k: int = 10, rank: bool = True, offset: int = 0) -> DataFrame:
        """search() with term_positions."""
        out = self.diagnostics(query, self.search(query, k, rank, offset))
        return out.orderBy(F.desc("score"), "doc_id") if rank else out.orderBy("doc_id")

    def search_page(self, query: str, offset: int = 0, limit: int = 10, rank: bool = True) -> SearchPage:
        """One page with the exact total. The matches are cached while both are taken."""
        rows = self._rows(query, rank).persist()
        try:
            page = ranking.top(rows, limit, offset) if rank else ranking.page(rows, [F.asc("doc_id")], limit, offset)
            detailed = self.diagnostics(query, page)
            return SearchPage(rows.count(), offset, limit, (detailed.orderBy(F.desc("score"), "doc_id") if rank else detailed.orderBy("doc_id")).collect())
        finally:
            rows.unpersist()
