"""The registered queries of the search engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.engine import SearchEngine
from lumensift.functions.text import snippet, tokens
from lumensift.operators import algebra, codecs, ranking
from lumensift.operators.index import Index, build_index, load_index
from lumensift.operators.overlap import overlaps
from lumensift.plans.language import parse
from lumensift.plans.planner import candidates
from lumensift.sources.loaders import from_table
from lumensift.workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]

#: Saved indexes by session, corpus and the files that it was read from: built at the first query and read by all others.
_SAVED: dict[tuple, str] = {}
_OPEN: dict[str, Index] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what changes when the table is rewritten."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(p, True) if fs.exists(p) else None
    out = []
    while found is not None and found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def saved_at(spark: SparkSession, sf_dir: str, name: str = "documents", docs: Callable[[], DataFrame] | None = None) -> str:
    """Where the index of a corpus is saved; it is built if it is not."""
    key = (spark.sparkContext.applicationId, name, _files(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _SAVED:
        path = scratch(spark, f"index-{name}")
        build_index(docs() if docs else _documents(spark, sf_dir)).save(path)
        _SAVED[key] = path
    return _SAVED[key]


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents", docs: Callable[[], DataFrame] | None = None) -> Index:
    """The opened index: its tables' files are listed, and its totals read, once a session."""
    path = saved_at(spark, sf_dir, name, docs)
    if path not in _OPEN:
        _OPEN[path] = load_index(spark, path)
    return _OPEN[path]


def _joined(positions: Column) -> Column:
    return F.array_join(positions.cast("array<string>"), ",")


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# What a query of the language means for a document, in SQL: sets of (doc_id) or of (doc_id, position).

_TOK = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS toks FROM documents),
tok AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS position FROM t),
meta AS (SELECT doc_id, len(toks) AS length FROM t)"""


def _with(body: str) -> str:
    return f"WITH {_TOK}\n{body}"


def _has(term: str) -> str:
    return f"SELECT DISTINCT doc_id FROM tok WHERE term = '{term}'"


def _at(term: str) -> str:
    return f"SELECT doc_id, position FROM tok WHERE term = '{term}'"


def _adj(a: str, b: str) -> str:
    return f"SELECT DISTINCT r.doc_id, r.position FROM ({a}) l JOIN ({b}) r ON l.doc_id = r.doc_id AND r.position = l.position + 1"


def _near(a: str, b: str, k: int) -> str:
    return f"""SELECT DISTINCT l.doc_id, l.position FROM (SELECT *, lag(position) OVER (PARTITION BY doc_id ORDER BY position) AS px FROM ({a})) l
        JOIN ({b}) r ON l.doc_id = r.doc_id AND (r.position BETWEEN l.position AND l.position + {k}
        OR (r.position BETWEEN l.position - {k} AND l.position - 1 AND (l.px IS NULL OR r.position >= l.px)))"""


def _docs(places: str) -> str:
    return f"SELECT DISTINCT doc_id FROM ({places})"


def _all() -> str:
    return "SELECT doc_id FROM documents"


def _not(docs: str) -> str:
    return f"({_all()} EXCEPT ({docs}))"


#: name -> (query, SQL of the matching doc_id)
MATCHES: dict[str, tuple[str, str]] = {
    "flagship_boolean": ("(the AND of) AND NOT (in ADJ the)", f"({_has('the')} INTERSECT {_has('of')}) EXCEPT ({_docs(_adj(_at('in'), _at('the')))})"),
    "bool_term": ("The", _has("the")),
    "bool_and": ("the AND of", f"{_has('the')} INTERSECT {_has('of')}"),
    "bool_and_skewed": ("the AND license", f"{_has('the')} INTERSECT {_has('license')}"),
    "bool_or": ("license OR von", f"{_has('license')} UNION {_has('von')}"),
    "bool_and_not": ("the AND NOT of", f"{_has('the')} EXCEPT {_has('of')}"),
    "bool_not_and": ("NOT of AND the", f"{_has('the')} EXCEPT {_has('of')}"),
    "bool_not": ("NOT the", _not(_has("the"))),
    "bool_not_and_not": ("NOT the AND NOT de", _not(f"{_has('the')} UNION {_has('de')}")),
    "bool_nested": ("(the OR der) AND NOT (of OR (die AND und))", f"({_has('the')} UNION {_has('der')}) EXCEPT ({_has('of')} UNION ({_has('die')} INTERSECT {_has('und')}))"),
    "bool_double_not": ("NOT NOT the", _has("the")),
    "adj": ("of ADJ the", _docs(_adj(_at("of"), _at("the")))),
    "edge": ("of EDGE the", _docs(_adj(_at("of"), _at("the")))),
    "adj_chain": ("is ADJ of ADJ the", _docs(_adj(_adj(_at("is"), _at("of")), _at("the")))),
    "adj_right_nested": ("is ADJ (of ADJ the)", _docs(_adj(_adj(_at("is"), _at("of")), _at("the")))),
    "near_0": ("the NEAR/0 the", _has("the")),
    "near_docs": ("the NEAR/3 of", _docs(_near(_at("the"), _at("of"), 3))),
    "near_then_adj": ("(of NEAR/3 the) ADJ in", _docs(_adj(_near(_at("of"), _at("the"), 3), _at("in")))),
    "or_adj": ("(the OR a) ADJ of", _docs(_adj(f"{_at('the')} UNION {_at('a')}", _at("of")))),
    "and_adj": (
        "(the AND a) ADJ of",
        _docs(_adj(f"SELECT * FROM ({_at('the')} UNION {_at('a')}) WHERE doc_id IN ({_has('the')} INTERSECT {_has('a')})", _at("of"))),
    ),
    "not_adj": ("NOT (of ADJ the)", _not(_docs(_adj(_at("of"), _at("the"))))),
    "not_under_adj": ("(NOT de) ADJ the", "SELECT doc_id FROM documents WHERE false"),
    "and_not_near": ("the AND NOT (the NEAR/1 of)", f"{_has('the')} EXCEPT ({_docs(_near(_at('the'), _at('of'), 1))})"),
    "unknown_term": ("qqqqzzzz", _has("qqqqzzzz")),
    "punctuated_term": ("c++ OR new-york", f"{_has('c++')} UNION {_has('new-york')}"),
}
#: name -> (query, SQL of (doc_id, position), the anchors)
ANCHORS: dict[str, tuple[str, str]] = {
    "adj_anchors": ("of ADJ the", _adj(_at("of"), _at("the"))),
    "near_anchors": ("the NEAR/3 of", _near(_at("the"), _at("of"), 3)),
    "near_3": ("of NEAR/3 (in ADJ the)", _near(_at("of"), _adj(_at("in"), _at("the")), 3)),
}


def _match(query: str) -> Query:
    return lambda spark, sf: candidates(index_of(spark, sf), query).select("doc_id")


def _anchors(query: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = SearchEngine(index_of(spark, sf)).execute(query)
        return found.select("doc_id", F.col("frequency").cast("bigint").alias("frequency"), _joined(F.col("positions")).alias("positions"))

    return run


def _algebra(spark: SparkSession, sf: str) -> DataFrame:
    """The join form of the operators: ((of ADJ the) OR (the NEAR/3 a)) AND NOT de, with the places of what is left."""
    ix = index_of(spark, sf)
    of, the, a, de = (ix.postings.filter(F.col("term") == t).select("doc_id", "tf", "positions") for t in ("of", "the", "a", "de"))
    out = algebra.and_not(algebra.or_(algebra.adjacent(of, the), algebra.near(the, a, 3)), de)
    return out.select("doc_id", F.col("tf").cast("bigint").alias("frequency"), _joined(F.col("positions")).alias("positions"))


# Ranking.


def _bm25_sql(matching: str, positive: list[str], k1: float = 1.2, b: float = 0.75) -> str:
    """Rounded scores of the matching documents; the sum goes term by term in the query's order."""
    cols = "".join(f", coalesce(max(tf) FILTER (term = '{t}'), 0) AS tf{k}" for k, t in enumerate(positive))
    terms = "', '".join(positive)  # none: a list of one empty term, which no text has
    dfs = "".join(f", (SELECT count(*) FROM p WHERE term = '{t}') AS df{k}" for k, t in enumerate(positive))
    score = "0.0::DOUBLE" + "".join(
        f" + CASE WHEN coalesce(tf{k}, 0) > 0 THEN ln(1 + (n::DOUBLE - df{k} + 0.5) / (df{k}::DOUBLE + 0.5)) * tf{k} * ({k1}::DOUBLE + 1) / (tf{k} + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * length / avgdl)) ELSE 0 END"
        for k in range(len(positive))
    )
    return f"""p AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN ('{terms}') GROUP BY ALL),
        piv AS (SELECT doc_id{cols} FROM p GROUP BY doc_id), s AS (SELECT count(*) AS n, sum(length)::DOUBLE / count(*) AS avgdl FROM meta), d AS (SELECT 1{dfs}),
        hit AS (SELECT * FROM ({matching})),
        scored AS (SELECT doc_id, round({score}, 6) AS score FROM hit JOIN meta USING (doc_id) LEFT JOIN piv USING (doc_id), s, d)"""


def _bm25(query: str, k: int = 20, **parameters: float) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ix, node = index_of(spark, sf), parse(query)
        rows = ranking.scored(ix, candidates(ix, node), node.terms(), node.positive_terms(), **parameters)
        return ranking.top(rows, k, digits=6).select("doc_id", "score")

    return run


#: name -> (query, matching SQL, positive terms, parameters)
RANKED: dict[str, tuple[str, str, list[str], dict]] = {
    "bm25_term": ("the", _has("the"), ["the"], {}),
    "bm25_and": ("the AND of", f"{_has('the')} INTERSECT {_has('of')}", ["the", "of"], {}),
    "bm25_or": ("license OR of OR that", f"{_has('license')} UNION {_has('of')} UNION {_has('that')}", ["license", "of", "that"], {}),
    "bm25_positional": ("of ADJ the", _docs(_adj(_at("of"), _at("the"))), ["of", "the"], {}),
    "bm25_negated": ("the AND NOT of", f"{_has('the')} EXCEPT {_has('of')}", ["the"], {}),
    "bm25_not_only": ("NOT the", _not(_has("the")), [], {}),
    "bm25_params": ("the AND of", f"{_has('the')} INTERSECT {_has('of')}", ["the", "of"], {"k1": 2.0, "b": 0.3}),
}


def _page(ranked: bool, offset: int, limit: int = 10) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ix, node = index_of(spark, sf), parse("the AND of")
        found = candidates(ix, node)
        if ranked:
            rows = ranking.scored(ix, found, node.terms(), node.positive_terms())
            page = ranking.top(rows, limit, offset, digits=6)
            order = [F.desc("score"), F.asc("doc_id")]
        else:
            rows = found.join(ix.documents, "doc_id").withColumn("score", F.lit(0.0))
            order = [F.asc("doc_id")]
            page = ranking.page(rows, order, limit, offset)
        number = F.row_number().over(Window.orderBy(*order)) + offset  # over one page
        return page.select(number.cast("bigint").alias("rank"), "doc_id", "score")

    return run


def _page_sql(ranked: bool, offset: int, limit: int = 10) -> str:
    matching = f"{_has('the')} INTERSECT {_has('of')}"
    if not ranked:
        return _with(f"SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, 0.0::DOUBLE AS score FROM ({matching}) ORDER BY doc_id LIMIT {limit} OFFSET {offset}")
    return f"WITH {_TOK}, {_bm25_sql(matching, ['the', 'of'])}\nSELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT {limit} OFFSET {offset}"


def _total(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(index_of(spark, sf), "the AND of").agg(F.count(F.lit(1)).alias("total"))


def _diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and places of the first ten matches, negated terms too."""
    engine = SearchEngine(index_of(spark, sf))
    rows = engine.search_detailed("(the AND of) AND NOT (license ADJ zzz)", 10, rank=False)
    return rows.select("doc_id", F.explode("term_positions").alias("term", "p")).select("doc_id", "term", _joined(F.col("p")).alias("positions"))


def _diagnostic_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return SearchEngine(index_of(spark, sf)).search("the AND of", 10, rank=False).select("doc_id", "external_id", "snippet")


# Index contents.


def _tokenize(spark: SparkSession, sf: str) -> DataFrame:
    split = _documents(spark, sf).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    return split.select("doc_id", F.col("position").cast("bigint").alias("position"), "term")


def _doc_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", "external_id", F.size(tokens(F.col("text"))).cast("bigint").alias("length"))


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", snippet(F.col("text")).alias("snippet"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).stats.select(*_big("n", "total_len"), F.round("avgdl", 6).alias("avgdl"))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).dictionary.select("term", *_big("df", "cf"))


def _top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _dictionary(spark, sf).orderBy(F.desc("df"), "term").limit(25).select("term", "df")


def _postings_all(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).postings.select("term", "doc_id", *_big("tf"), _joined(F.col("positions")).alias("positions"))


def _posting_docs(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).posting_docs("the").select("doc_id", *_big("tf"))


def _posting_full(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).posting_list("of").select("doc_id", *_big("tf"), _joined(F.col("positions")).alias("positions"))


def _term_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = index_of(spark, sf).postings.filter((F.col("term") == "the") & (F.col("doc_id") == 7))
    return rows.select(F.explode("positions").alias("position")).select(*_big("position"))


def _duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _codec_report(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.size_report(index_of(spark, sf))


def _codec_sample(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.sample(index_of(spark, sf))


def _skip_table(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.skip_table(index_of(spark, sf))


# Other corpora.


def _corpus(table: str, doc_id: str, text: str, query: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = lambda: from_table(spark.read.parquet(f"{sf}/{table}.parquet"), F.expr(doc_id), F.expr(text))
        return _frequency(candidates(index_of(spark, sf, table, docs), query, anchors=True))

    return run


def _frequency(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *_big("frequency"))


def _corpus_sql(table: str, doc_id: str, text: str, body: str) -> str:
    return rf"""WITH t AS (SELECT {doc_id} AS doc_id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}]+') AS toks FROM {table}),
        tok AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS position FROM t) {body}"""


def _count_places(places: str) -> str:
    return f"SELECT doc_id, count(*) AS frequency FROM ({places}) GROUP BY doc_id"


CORPORA: dict[str, tuple[Query, str]] = {
    "corpus_conversations": (
        _corpus("conversations", "conv_id * 1000 + turn", "text", "the NEAR/2 of"),
        _corpus_sql("conversations", "conv_id * 1000 + turn", "text", _count_places(_near(_at("the"), _at("of"), 2))),
    ),
    "corpus_pages_html": (_corpus("pages", "page_id", "html", "of ADJ the"), _corpus_sql("pages", "page_id", "html", _count_places(_adj(_at("of"), _at("the"))))),
    "corpus_parts": (_corpus("part", "p_partkey", "p_name", "blue ADJ bolt OR ring"), _corpus_sql("part", "p_partkey", "p_name", f"SELECT doc_id, 1::BIGINT AS frequency FROM ({_docs(_adj(_at('blue'), _at('bolt')))} UNION {_has('ring')})")),
    "corpus_benchmark": (_corpus("benchmark", "item_id", "text", "the"), _corpus_sql("benchmark", "item_id", "text", _count_places(_at("the")))),
}


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Hits joined with the quality and toxicity labels of their documents."""
    hits = candidates(index_of(spark, sf), "the AND of").select("doc_id")
    return hits.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("hits")).select(*_big("quality", "toxic", "hits"))


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query of its distinct terms, all in one job: how many documents hold a term of it, and how many postings."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return overlaps(items, index_of(spark, sf)).select("item_id", *_big("docs", "most_terms", "postings"))


_JAVA_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"
_SNIPPET_SQL = "CASE WHEN length(f) > 500 THEN substring(f, 1, 500) || '...' ELSE f END"
_FLAT_SQL = f"trim(regexp_replace(text, '{_JAVA_SPACE}', ' ', 'g'))"
_POSTINGS_SQL = "SELECT term, doc_id, count(*) AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM tok GROUP BY term, doc_id"

_CODEC_SQL = _with("""
, p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
s AS (
    SELECT term, 'd' AS stream, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS i, doc_id AS v, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS g FROM p
    UNION ALL SELECT term, 't', row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1, tf, tf FROM p
    UNION ALL SELECT term, 'p', row_number() OVER (PARTITION BY term ORDER BY doc_id, position) - 1, position, position - lag(position, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY position) FROM tok
), b AS (
    SELECT term, stream, i // 128 AS block, v, g, length(bin(v)) AS wv, length(bin(g)) AS wg FROM s
), q AS (
    SELECT *, list_sort(list(wv) OVER w)[ceil(count(*) OVER w * 0.9)::BIGINT] AS qv, list_sort(list(wg) OVER w)[ceil(count(*) OVER w * 0.9)::BIGINT] AS qg FROM b WINDOW w AS (PARTITION BY term, stream, block)
), k AS (
    SELECT term, stream, block, count(*) AS n, sum(greatest(1, ceil(wv / 7)))::BIGINT AS vv, sum(greatest(1, ceil(wg / 7)))::BIGINT AS vg, max(wv) AS mv, max(wg) AS mg,
        9 + ceil(count(*) * max(qv) / 8) + 6 * count(*) FILTER (wv > qv) AS pv, 9 + ceil(count(*) * max(qg) / 8) + 6 * count(*) FILTER (wg > qg) AS pg FROM q GROUP BY ALL
), l AS (SELECT term, stream, sum(n) AS n, sum(vv) AS vv, sum(vg) AS vg, max(mv) AS mv, max(mg) AS mg, sum(pv) AS pv, sum(pg) AS pg FROM k GROUP BY ALL),
z AS (SELECT *, greatest(1, ceil(length(bin(n::BIGINT)) / 7)) AS vn FROM l),
m AS (
    SELECT 'none' AS mode, sum(4 + 4 * n) AS c, sum(4 * n) AS r FROM z UNION ALL SELECT 'delta', sum(4 + 4 * n), sum(4 * n) FROM z
    UNION ALL SELECT 'varbyte', sum(vn + vv), sum(4 * n) FROM z UNION ALL SELECT 'delta-varbyte', sum(vn + vg), sum(4 * n) FROM z
    UNION ALL SELECT 'bitpacking', sum(5 + ceil(n * mv / 8)), sum(4 * n) FROM z UNION ALL SELECT 'delta-bitpacking', sum(5 + ceil(n * mg / 8)), sum(4 * n) FROM z
    UNION ALL SELECT 'pfor', sum(4 + pv), sum(4 * n) FROM z UNION ALL SELECT 'delta-pfor', sum(4 + pg), sum(4 * n) FROM z
) SELECT mode, r::BIGINT AS raw_bytes, c::BIGINT AS compressed_bytes, round(r::DOUBLE / c::DOUBLE, 3) AS ratio FROM m""").replace("\n\n,", ",", 1)

INDEX: dict[str, tuple[Query, str]] = {
    "tokenize_positions": (_tokenize, _with("SELECT doc_id, position, term FROM tok")),
    "doc_meta": (_doc_meta, _with("SELECT doc_id, doc_id::VARCHAR AS external_id, length FROM meta")),
    "snippets": (_snippets, f"SELECT doc_id, {_SNIPPET_SQL} AS snippet FROM (SELECT doc_id, {_FLAT_SQL} AS f FROM documents)"),
    "collection_stats": (_stats, _with("SELECT count(*) AS n, sum(length)::BIGINT AS total_len, round(sum(length)::DOUBLE / count(*), 6) AS avgdl FROM meta")),
    "dictionary_df_cf": (_dictionary, _with("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term")),
    "top_terms_by_df": (_top_terms, _with("SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term ORDER BY df DESC, term LIMIT 25")),
    "index_postings": (_postings_all, _with(_POSTINGS_SQL)),
    "posting_list_doc_only": (_posting_docs, _with("SELECT doc_id, count(*) AS tf FROM tok WHERE term = 'the' GROUP BY doc_id")),
    "posting_list_full": (_posting_full, _with(f"SELECT doc_id, tf, positions FROM ({_POSTINGS_SQL}) WHERE term = 'of'")),
    "term_positions": (_term_positions, _with("SELECT position FROM tok WHERE term = 'the' AND doc_id = 7")),
    "duplicate_ids": (_duplicate_ids, "SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id HAVING count(*) > 1"),
    "codec_size_report": (_codec_report, _CODEC_SQL),
    "codec_sample": (
        _codec_sample,
        _with(f"""
, p AS ({_POSTINGS_SQL}), d AS (SELECT term, count(*) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 1), r AS (SELECT * FROM p JOIN d USING (term) ORDER BY doc_id LIMIT 16)
SELECT term, df, doc_id, doc_id - lag(doc_id, 1, 0) OVER (ORDER BY doc_id) AS gap, tf, array_to_string(list_slice(string_split(positions, ','), 1, 16), ',') AS positions FROM r""").replace("\n\n,", ",", 1),
    ),
    "skip_table_size": (
        _skip_table,
        _with("SELECT term, df, floor(sqrt(df))::BIGINT AS step, ((df - 1) // floor(sqrt(df))::BIGINT)::BIGINT AS skips FROM (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term) WHERE df >= 4"),
    ),
    "total_matches": (_total, _with(f"SELECT count(*) AS total FROM ({_has('the')} INTERSECT {_has('of')})")),
    "diagnostics_positions": (
        _diagnostics,
        _with(f"""SELECT doc_id, term, positions FROM ({_POSTINGS_SQL}) WHERE term IN ('the', 'of', 'license', 'zzz') AND doc_id IN (
            SELECT doc_id FROM (({_has('the')} INTERSECT {_has('of')}) EXCEPT ({_docs(_adj(_at('license'), _at('zzz')))})) ORDER BY doc_id LIMIT 10)"""),
    ),
    "diagnostics_snippet": (
        _diagnostic_snippets,
        _with(f"SELECT doc_id, doc_id::VARCHAR AS external_id, {_SNIPPET_SQL} AS snippet FROM (SELECT doc_id, {_FLAT_SQL} AS f FROM documents) WHERE doc_id IN (SELECT doc_id FROM ({_has('the')} INTERSECT {_has('of')}) ORDER BY doc_id LIMIT 10)"),
    ),
    "posting_algebra": (
        _algebra,
        _with(f"""SELECT doc_id, count(*) AS frequency, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM (
            ({_adj(_at('of'), _at('the'))}) UNION ({_near(_at('the'), _at('a'), 3)})) WHERE doc_id NOT IN ({_has('de')}) GROUP BY doc_id"""),
    ),
    "search_join_labels": (
        _labels,
        _with(f"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS hits FROM ({_has('the')} INTERSECT {_has('of')}) JOIN labels USING (doc_id) GROUP BY ALL"),
    ),
    "batch_benchmark_queries": (
        _batch,
        _with(r"""
, i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))) AS term FROM benchmark),
p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
h AS (SELECT item_id, doc_id, count(*) AS terms, sum(tf) AS tf FROM i JOIN p USING (term) GROUP BY ALL)
SELECT item_id, count(*) AS docs, max(terms) AS most_terms, sum(tf)::BIGINT AS postings FROM h GROUP BY item_id""").replace("\n\n,", ",", 1),
    ),
    "page_ranked_1": (_page(True, 0), _page_sql(True, 0)),
    "page_ranked_2": (_page(True, 10), _page_sql(True, 10)),
    "page_past_end": (_page(True, 1_000_000), _page_sql(True, 1_000_000)),
    "page_unranked": (_page(False, 5), _page_sql(False, 5)),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _match(q) for name, (q, _) in MATCHES.items()}
    out |= {name: _anchors(q) for name, (q, _) in ANCHORS.items()}
    out |= {name: _bm25(q, **p) for name, (q, _, _, p) in RANKED.items()}
    return out | {name: q for name, (q, _) in (INDEX | CORPORA).items()}


def oracle_sql() -> dict[str, str]:
    out = {name: _with(f"SELECT doc_id FROM ({sql})") for name, (_, sql) in MATCHES.items()}
    out |= {name: _with(f"SELECT doc_id, count(*) AS frequency, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM ({sql}) GROUP BY doc_id") for name, (_, sql) in ANCHORS.items()}
    out |= {
        name: f"WITH {_TOK}, {_bm25_sql(sql, terms, **p)}\nSELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20"
        for name, (_, sql, terms, p) in RANKED.items()
    }
    return out | {name: sql for name, (_, sql) in (INDEX | CORPORA).items()}
