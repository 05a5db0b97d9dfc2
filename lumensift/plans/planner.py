"""A query becomes one per-document plan: a scan of the postings of its terms, one grouping by document, one predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.functions import positions as P
from lumensift.operators.index import Index
from lumensift.plans.language import Adj, And, Near, Node, Not, Or, Term, parse
from lumensift.workspace import once


def matches_without_terms(node: Node) -> bool:
    """Whether a document that holds none of the query's terms can match."""
    if isinstance(node, Not):
        return not matches_without_terms(node.child)
    if isinstance(node, And):
        return matches_without_terms(node.left) and matches_without_terms(node.right)
    if isinstance(node, Or):
        return matches_without_terms(node.left) or matches_without_terms(node.right)
    return False


def _positional_terms(node: Node, below: bool = False) -> set[str]:
    below = below or isinstance(node, (Adj, Near))
    return ({node.text} if below else set()) if isinstance(node, Term) else set().union(*(_positional_terms(c, below) for c in node.children()))


def _carries_places(node: Node, below: bool) -> bool:
    if isinstance(node, (And, Or)):
        return _carries_places(node.left, below) or _carries_places(node.right, below)
    return below if isinstance(node, Term) else isinstance(node, (Adj, Near))


@dataclass
class _Value:
    """What a node gives for one document: does it match, where (only below a positional node), how often."""

    match: Column
    places: Column
    frequency: Column


class _Compiler:
    """Compiles bottom up; the anchors of each positional node become a column of their own."""

    def __init__(self, frame: DataFrame, terms: list[str]):
        self.frame, self.of, self.n = frame, {t: k for k, t in enumerate(terms)}, 0

    def compile(self, node: Node, places: bool) -> _Value:
        if isinstance(node, Term):
            k = self.of[node.text]
            tf = F.coalesce(F.col(f"tf_{k}"), F.lit(0))
            return _Value(tf > 0, F.coalesce(F.col(f"pos_{k}"), P.none()) if places else P.none(), tf)
        if isinstance(node, Not):
            return _Value(~self.compile(node.child, False).match, P.none(), F.lit(0))
        positional = isinstance(node, (Adj, Near))
        a, b = (self.compile(c, places or positional) for c in (node.left, node.right))
        if positional:
            # The places of a union are needed several times: they become a column as well.
            a, b = (self._settled(c, v) for c, v in ((node.left, a), (node.right, b)))
            self.n += 1
            name = f"anchors_{self.n}"
            # Places are [] where a side does not match, so no further test of the sides is needed.
            found = P.adjacent(a.places, b.places) if isinstance(node, Adj) else P.near(a.places, b.places, node.k)
            self.frame = once(self.frame, name, found)
            return _Value(F.size(name) > 0, F.col(name), F.size(name))
        # Terms carry places only below a positional node, but the anchors of such a node are carried up through AND and OR.
        carried = _carries_places(node, places)
        if isinstance(node, And):
            match = a.match & b.match
            union = F.when(match, P.merged(a.places, b.places)).otherwise(P.none()) if carried else P.none()
            return _Value(match, union, F.when(match, self._merged_frequency(a, b, union, carried)).otherwise(F.lit(0)))
        union = P.merged(F.when(a.match, a.places).otherwise(P.none()), F.when(b.match, b.places).otherwise(P.none())) if carried else P.none()
        both = self._merged_frequency(a, b, union, carried)
        return _Value(a.match | b.match, union, F.when(a.match & b.match, both).when(a.match, a.frequency).when(b.match, b.frequency).otherwise(F.lit(0)))

    def _settled(self, node: Node, value: _Value) -> _Value:
        if not isinstance(node, (And, Or)):
            return value
        self.n += 1
        self.frame = once(self.frame, f"places_{self.n}", value.places)
        return _Value(value.match, F.col(f"places_{self.n}"), value.frequency)

    @staticmethod
    def _merged_frequency(a: _Value, b: _Value, union: Column, carried: bool) -> Column:
        most = F.greatest(a.frequency, b.frequency)
        return F.when(F.size(union) > 0, F.size(union)).otherwise(most) if carried else most


def per_document(index: Index, terms: list[str], with_positions: set[str], universe: bool) -> DataFrame:
    """doc_id and, for each term k, tf_k (and pos_k): one scan of the terms' postings and one shuffle.

    With universe, documents without any of the terms are there too.
    """
    columns = ["term", "doc_id", "tf", *(["positions"] if with_positions else [])]
    some = index.postings.filter(F.col("term").isin(terms)).select(*columns)
    sums = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{k}") for k, t in enumerate(terms)]
    # A group has one row for each term: first() picks the only non-null array.
    sums += [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"pos_{k}") for k, t in enumerate(terms) if t in with_positions]
    pivot = some.groupBy("doc_id").agg(*sums)
    return index.documents.select("doc_id").join(pivot, "doc_id", "left") if universe else pivot


def candidates(index: Index, query: str | Node, anchors: bool = False) -> DataFrame:
    """The matching documents: doc_id, frequency and tf_k of the k-th term; with anchors also `positions`, the root's places."""
    node = parse(query) if isinstance(query, str) else query
    terms = node.terms()
    positional = _positional_terms(node)
    frame = per_document(index, terms, positional, matches_without_terms(node))
    compiler = _Compiler(frame, terms)
    value = compiler.compile(node, False)
    found = compiler.frame.filter(value.match)
    columns = ["doc_id", *(f"tf_{k}" for k in range(len(terms))), value.frequency.cast("bigint").alias("frequency")]
    return found.select(*columns, *([value.places.alias("positions")] if anchors else []))
