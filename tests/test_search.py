import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from reference_model import near_walk, value

from lumensift.engine import SearchEngine, SearchPage
from lumensift.functions import positions as P
from lumensift.functions.text import snippet, tokens
from lumensift.operators import algebra, ranking
from lumensift.operators.index import PIECE, DuplicateDocumentError, _grouped, build_index, load_index
from lumensift.plans.language import MAX_DISTANCE, Adj, And, Near, Not, Or, QuerySyntaxError, Term, parse

HISTORY = ["history russia blue mountain", "history of russia blue high mountain", "history europe blue mountain", "russia history mountain blue", "other document"]
CITY = ["new york city apple juice", "new big york banana", "apple banana juice"]


def index_of(spark, texts, start=1):
    return build_index(spark.createDataFrame([(i, f"doc{i}", t) for i, t in enumerate(texts, start)], "doc_id bigint, external_id string, text string"))


@pytest.fixture(scope="module")
def history(spark):
    return index_of(spark, HISTORY)


def found(engine, query):
    return sorted(r.doc_id for r in engine.execute(query).collect())


# Tokens and snippets.


def test_tokens(spark):
    rows = spark.createDataFrame([("New York is big!",), ("  ПрИвЕт—МИР 42... ",), ("",), (None,), ("!!",)], "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [["new", "york", "is", "big"], ["привет", "мир", "42"], [], [], []]


def test_snippets(spark):
    texts = ["a" * 499, "a" * 500, "a" * 501, " \t a \n\n b ", "", None, "x" * 500 + "   ", "a b c"]
    rows = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(snippet(F.col("t")).alias("s")).collect()]
    assert rows == ["a" * 499, "a" * 500, "a" * 500 + "...", "a b", "", "", "x" * 500, "a b c"]


# The language.


def test_parser():
    assert parse("a OR b AND NOT c ADJ d") == Or(Term("a"), And(Term("b"), Not(Adj(Term("c"), Term("d")))))
    assert parse("a and B") == And(Term("a"), Term("b"))
    assert parse("a NEAR/3 b near/0 c") == Near(Near(Term("a"), Term("b"), 3), Term("c"), 0)
    assert parse("a ADJ (b ADJ (c EDGE d))") == parse("a ADJ b ADJ c ADJ d")
    assert parse("android NEAR/x".replace(" ", " OR ")) == Or(Term("android"), Term("near/x"))
    assert parse("NOT NOT a") == Not(Not(Term("a"))) and parse("((a))") == Term("a")
    node = parse("history AND NOT (blue ADJ mountain)")
    assert node.terms() == ["history", "blue", "mountain"] and node.positive_terms() == ["history"]
    assert parse("NOT NOT a").positive_terms() == []


@pytest.mark.parametrize("bad", ["", "  ", "history AND (russia OR)", "history NEAR/x russia", "a b", "AND a", "a ADJ NOT b", "(a", "a)", f"a NEAR/{MAX_DISTANCE + 1} b", "a NEAR/3"])
def test_syntax_errors(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_error_names_the_place():
    with pytest.raises(QuerySyntaxError, match="Invalid query at 2:3"):
        parse("a AND\n ( )")


# Matching.


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("history AND russia", [1, 2, 4]), ("history OR russia", [1, 2, 3, 4]), ("history EDGE russia", [1]), ("history AND NOT russia", [3]), ("NOT (history ADJ russia)", [2, 3, 4, 5]),
        ("history AND NOT (history ADJ russia)", [2, 3, 4]), ("history AND NOT (russia NEAR/1 history)", [2, 3]), ("blue AND mountain", [1, 2, 3, 4]), ("blue AND NOT (blue ADJ mountain)", [2, 4]),
        ("(history OR blue) ADJ mountain", [1, 3, 4]), ("(history AND blue) ADJ mountain", [1, 3, 4]), ("history ADJ (russia ADJ blue)", [1]), ("nothing", []), ("hist-ory", []),
    ],
)
def test_history(history, query, ids):
    assert found(SearchEngine(history), query) == ids


def test_city_and_empty_documents(spark):
    e = SearchEngine(index_of(spark, [*CITY, "...", ""]))
    assert found(e, "new ADJ york") == [1] and found(e, "new NEAR/2 york") == [1, 2] and found(e, "(apple OR banana) AND NOT juice") == [2]
    assert found(e, "NOT new") == [3, 4, 5] and found(e, "(NOT new) ADJ york") == []
    assert e.index.document_count() == 5 and e.index.document(4).length == 0


def test_anchors(history):
    at = lambda q: {r.doc_id: r.positions for r in SearchEngine(history).execute(q).collect()}
    assert at("history ADJ russia") == {1: [1]} and at("history NEAR/1 russia") == {1: [0], 4: [1]}


def test_near_closed_form_equals_the_walk(spark):
    rng = random.Random(20)
    rows = [(sorted(rng.sample(range(25), rng.randint(0, 7))), sorted(rng.sample(range(25), rng.randint(0, 7)))) for _ in range(400)] + [([5, 6], [4])]
    df = spark.createDataFrame(rows, "l array<int>, r array<int>")
    for k in (0, 1, 2, 5, MAX_DISTANCE):
        for r in df.select("l", "r", P.near(F.col("l"), F.col("r"), k).alias("n"), P.any_near(F.col("l"), F.col("r"), k).alias("any"), P.adjacent(F.col("l"), F.col("r")).alias("a")).collect():
            assert r.n == near_walk(r.l, r.r, k) and r.any == bool(r.n) and r.a == [y for y in r.r if y - 1 in r.l]


def random_node(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return Term(rng.choice("abcz"))
    kind = rng.choice(["and", "or", "not", "adj", "near"])
    left = random_node(rng, depth - 1)
    if kind == "not":
        return Not(left)
    right = random_node(rng, depth - 1)
    return {"and": And, "or": Or, "adj": Adj}[kind](left, right) if kind != "near" else Near(left, right, rng.randint(0, 3))


def test_random_queries_against_the_model(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    ix = index_of(spark, texts)
    ix = type(ix)(ix.documents.cache(), ix.postings.cache(), ix.dictionary, ix.stats)
    from lumensift.plans.planner import candidates

    for _ in range(25):
        node = random_node(rng, 3)
        want = {i: v for i, t in enumerate(texts, 1) if (v := value(node, t.split()))[0]}
        got = {r.doc_id: r for r in candidates(ix, node, anchors=True).collect()}
        assert set(got) == set(want), node
        for i, r in got.items():
            assert r.frequency == want[i][2], (node, texts[i - 1])
            if isinstance(node, (Adj, Near)):
                assert r.positions == want[i][1]


def test_algebra_agrees_with_the_planner(history):
    p = lambda t: history.posting_list(t)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    e = SearchEngine(history)
    assert ids(algebra.and_(p("history"), p("russia"))) == ids(algebra.and_docs(p("history"), p("russia"))) == found(e, "history AND russia")
    assert ids(algebra.or_(p("europe"), p("high"))) == found(e, "europe OR high")
    assert ids(algebra.and_not(p("history"), p("russia"))) == [3]
    assert ids(algebra.not_(p("history"), history.documents)) == [5]
    assert [tuple(r) for r in algebra.adjacent(p("history"), p("russia")).collect()] == [(1, 1, [1])]
    assert sorted(map(tuple, algebra.near(p("history"), p("russia"), 1).collect())) == [(1, 1, [0]), (4, 1, [1])]


def test_algebra_merges_positions(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, tf int, positions array<int>")
    a, b = make([(1, 1, [2]), (2, 3, [])]), make([(1, 2, [1, 3]), (2, 5, []), (3, 1, [0])])
    assert sorted(map(tuple, algebra.or_(a, b).collect())) == [(1, 3, [1, 2, 3]), (2, 5, []), (3, 1, [0])]
    assert sorted(map(tuple, algebra.and_(a, b).collect())) == [(1, 3, [1, 2, 3]), (2, 5, [])]


# Ranking and pages.


def test_bm25_by_hand(spark):
    texts = ["information information information information retrieval", "information neural search graph retrieval"]
    e = SearchEngine(index_of(spark, texts))
    rows = {r.doc_id: r.score for r in e.search("information").collect()}
    weight = math.log(1 + 0.5 / 2.5)
    assert rows[1] > rows[2] and math.isclose(rows[1], weight * 4 * 2.2 / (4 + 1.2)) and math.isclose(rows[2], weight * 2.2 / 2.2)
    assert math.isclose(e.score_document("information", 2), rows[2]) and e.score_document("information", 99) == 0 and e.score_document("zzz", 1) == 0
    assert {r.score for r in e.search("NOT zzz").collect()} == {0.0}
    assert e.search("information", 0).count() == 0


@pytest.fixture(scope="module")
def paged(spark):
    return SearchEngine(index_of(spark, ["common " * (i % 5 + 1) + f"term{i}" for i in range(1, 24)]))


def test_pages(paged):
    pages = [paged.search_page("common", o, 10) for o in (0, 10, 20, 30)]
    assert [len(p.results) for p in pages] == [10, 10, 3, 0] and {p.total for p in pages} == {23} and [p.has_more for p in pages] == [True, True, False, False]
    top = [r.doc_id for r in paged.search("common", 23).collect()]
    assert [r.doc_id for p in pages for r in p.results] == top and all(r.snippet for p in pages for r in p.results)
    flat = paged.search_page("common", 5, 4, rank=False)
    assert [(r.doc_id, r.score) for r in flat.results] == [(k, 0.0) for k in (6, 7, 8, 9)] and paged.total("common") == 23
    for bad in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            paged.search_page("common", *bad)
    with pytest.raises(OverflowError):
        paged.search_page("common", 2**31 - 2, 10)
    with pytest.raises(ValueError):
        SearchPage(-1, 0, 1, [])


def test_diagnostics(history):
    rows = SearchEngine(history).search_detailed("(blue OR russia) AND NOT (history ADJ europe)", 10, rank=False).collect()
    assert {r.doc_id: r.term_positions for r in rows}[1] == {"blue": [2], "russia": [1], "history": [0]}
    assert list({r.doc_id: r.term_positions for r in rows}[1]) == ["blue", "russia", "history"]


def test_scores_equal_those_of_a_loop(history):
    rows = {r.doc_id: r.score for r in SearchEngine(history, k1=2.0, b=0.3).scores("history OR blue").collect()}
    lengths = [len(t.split()) for t in HISTORY]
    avg = sum(lengths) / 5
    for i, t in enumerate(HISTORY, 1):
        want = sum(
            math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 3.0 / (tf + 2.0 * (0.7 + 0.3 * lengths[i - 1] / avg))
            for w, df in (("history", 4), ("blue", 4))
            if (tf := t.split().count(w))
        )
        assert math.isclose(rows.get(i, 0.0), want)


# The index.


def test_index_contents(spark, tmp_path):
    ix = index_of(spark, ["hello world hello", "world hello"])
    assert [tuple(r) for r in ix.posting_list("hello").collect()] == [(1, 2, [0, 2]), (2, 1, [1])]
    assert ix.document_frequency("hello") == 2 and ix.document_frequency("nope") == 0 and ix.document(1).snippet == "hello world hello" and ix.document(9) is None
    assert ix.posting_list(None).count() == ix.posting_list("nope").count() == 0 and ix.term_positions("hello", 1) == [0, 2] and ix.term_positions("hello", 9) == []
    path = str(tmp_path / "ix")
    for _ in range(2):  # the second time overwrites
        ix.save(path)
    for reader in ("disk", "mmap"):
        again = load_index(spark, path, reader)
        assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, ix.postings.collect()))
        assert sorted(map(tuple, again.dictionary.collect())) == [("hello", 2, 3), ("world", 2, 2)] and tuple(again.stats.first()) == (2, 5, 2.5)
    with pytest.raises(ValueError):
        load_index(spark, path, "tape")
    plan = again.postings.filter("term = 'hello'").select("doc_id", "tf")._jdf.queryExecution().toString()
    assert "EqualTo(term,hello)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_empty_index_and_bad_ids(spark):
    empty = build_index(spark.createDataFrame([], "doc_id bigint, external_id string, text string"))
    assert tuple(empty.stats.first()) == (0, 0, 0.0) and SearchEngine(empty).search("NOT a").count() == 0
    for ids in ([1, 1], [0], [None]):
        with pytest.raises(DuplicateDocumentError):
            build_index(spark.createDataFrame([(i, "x", "t") for i in ids], "doc_id bigint, external_id string, text string"), check_ids=True)


def test_gap_in_ids_and_long_lists(spark):
    docs = [(1, "a", "hello there you"), (5, "b", "hello")] + [(i, str(i), f"common filler{i} common") for i in range(10, 3010)]
    ix = build_index(spark.createDataFrame(docs, "doc_id bigint, external_id string, text string"), check_ids=True)
    assert ix.document_frequency("hello") == 2 and ix.document(1).length == 3
    rows = ix.posting_list("common").collect()
    assert len(rows) == 3000 and all((r.tf, r.positions) == (2, [0, 2]) for r in rows)


def test_idf_edges(spark):
    assert [spark.range(1).select(ranking.idf(df, n).alias("x")).first().x for df, n in ((0, 5), (5, 0))] == [0.0, 0.0]


def test_invariants_on_driver_documents(spark):
    from lumensift.plans.queries import index_of as of

    e = SearchEngine(of(spark, "/root/testdata/sf0.001"))
    both, adj, near = (set(found(e, q)) for q in ("of AND the", "of ADJ the", "of NEAR/1 the"))
    assert adj and adj <= near <= both and set(found(e, "of AND the AND NOT (of ADJ the)")) == both - adj


def test_a_rewritten_table_gets_a_new_index(spark, tmp_path):
    from lumensift.plans.queries import index_of

    for text, want in (("old words", {"old", "words"}), ("new words here", {"new", "words", "here"})):
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        first, again = (index_of(spark, str(tmp_path)) for _ in range(2))
        assert first is again and {r.term for r in first.dictionary.collect()} == want


def test_postings_are_grouped_in_pieces():
    rng = random.Random(5)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 3, 0, PIECE - 3, 1, 0, PIECE + 7, 2, 50, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 20)), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "toks"])
    got = [r for b in _grouped(iter([batch.slice(1), batch.slice(0, 1)])) for r in b.to_pylist()]
    want = {(t, d): [i for i, x in enumerate(toks) if x == t] for d, toks in zip(range(10, 20), texts, strict=True) for t in set(toks)}
    assert len(got) == len(want) and {(r["term"], r["doc_id"]): r["positions"] for r in got} == want
    assert all(r["tf"] == len(r["positions"]) for r in got)


def test_grouping_does_not_need_memory_for_a_whole_batch():
    docs = 10 * PIECE // 100
    toks = pa.ListArray.from_arrays(pa.array(range(0, 100 * docs + 1, 100), pa.int32()), pa.array([str(k) for k in range(1000)] * (docs // 10)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), toks], names=["doc_id", "toks"])
    tracemalloc.start()
    try:
        for _ in _grouped(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 130 * PIECE  # NumPy's arrays are traced
    finally:
        tracemalloc.stop()
