import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumensift.operators import overlap
from lumensift.operators.index import Index, dictionary_of


def plain(queries, postings):
    """item_id -> (docs, most_terms, postings), by loops."""
    terms = defaultdict(set)
    for t, d, _ in postings:
        terms[d].add(t)
    out = {}
    for i in {i for i, _ in queries}:
        own = Counter(t for x, t in queries if x == i)
        held = [n for d in terms if (n := sum(own[t] for t in terms[d]))]
        if held:
            out[i] = (len(held), max(held), sum(tf * own[t] for t, _, tf in postings))
    return out


@pytest.mark.parametrize("most_sent", [overlap.MOST_SENT, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, monkeypatch, seed, most_sent):
    """Null ids, ids that repeat, unknown terms, a query that has a term in two rows; pieces of a few pairs, documents over many batches."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    postings = [(t, d, rng.randint(1, 5)) for d in [None, *range(200), 7, 7] for t in rng.sample(words, rng.randint(0, 30))]
    queries = [(i, t) for i in [None, *range(30)] for t in rng.sample([*words, "unknown"], rng.randint(1, 6))] + [(3, "w1"), (3, "w1"), (99, "unknown")]
    monkeypatch.setattr(overlap, "_PAIRS", 50)
    monkeypatch.setattr(overlap, "_CELLS", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table = spark.createDataFrame(postings, "term string, doc_id bigint, tf int")
        index = Index(None, table, dictionary_of(table), None)
        got = overlap.overlaps(spark.createDataFrame(queries, "item_id bigint, term string"), index, most_sent).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.item_id: (r.docs, r.most_terms, r.postings) for r in got} == plain(queries, postings) and len(got) == len({r.item_id for r in got})


def test_empty(spark):
    table = spark.createDataFrame([("a", 1, 1)], "term string, doc_id bigint, tf int")
    index = Index(None, table, dictionary_of(table), None)
    for rows in ([], [(1, "b")]):
        assert overlap.overlaps(spark.createDataFrame(rows, "item_id bigint, term string"), index).collect() == []
    nothing = Index(None, table.filter("false"), dictionary_of(table.filter("false")), None)
    assert overlap.overlaps(spark.createDataFrame([(1, "a")], "item_id bigint, term string"), nothing).collect() == []


def test_no_row_for_each_document_and_query(spark, capsys):
    table = spark.range(50).selectExpr("'a' term", "id doc_id", "1 tf")
    queries = spark.range(20).select(F.col("id").alias("item_id"), F.lit("a").alias("term"))
    out = overlap.overlaps(queries, Index(None, table, dictionary_of(table), None))
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "item_id, doc_id" not in plan and out.agg(F.sum("docs"), F.min("docs")).first()[:] == (1000, 50)
