"""Registered queries of the loaders, the markup cleaner and the Python, command-line and HTTP surfaces, each with its SQL.

Loaders read what the query has written from a whole table into the shared folder; surfaces answer over the saved index.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift import cli
from lumensift.engine import SearchEngine
from lumensift.functions.markup import clean_wikitext_column
from lumensift.functions.text import tokens
from lumensift.http_api import SearchApi
from lumensift.operators import codecs
from lumensift.operators.index import index_meta, load_index
from lumensift.plans.language import QuerySyntaxError, parse
from lumensift.plans.planner import candidates
from lumensift.plans.queries import _TOK, Query, _bm25_sql, _big, _has, _with, index_of, saved_at
from lumensift.sources.loaders import find_source_pages, read_jsonl, read_txt_folder, read_wiki_xml, renumbered, wiki_pages
from lumensift.workspace import scratch


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Words of each benchmark item, in Spark and in SQL: text that no markup rule changes.
_WORDS_SQL = r"w AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ' ') AS w FROM benchmark)"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select("item_id", F.array_join(tokens(F.col("text")), " ").alias("w"))


# Loaders.


def _txt_folder(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "txt")
    _table(spark, sf, "benchmark").repartition("item_id").write.partitionBy("item_id").text(path)
    return read_txt_folder(spark, path).select("doc_id", F.regexp_extract("external_id", r"^item_id=(\d+)/[^/]*\.txt$", 1).alias("folder"), "text")


def _jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    docs = _table(spark, sf, "documents")
    docs.select(F.concat(F.lit("d"), "doc_id").alias("_id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("title"), "text", "doc_id").orderBy("doc_id").drop("doc_id").write.json(path)
    return read_jsonl(spark, path)


def _jsonl_odd(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as other tools write them: blank ones, numbers for ids, nulls, escapes, fields in another order, unknown fields."""
    path = scratch(spark, "jsonl-odd")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    i = F.col("item_id")
    lines = F.array(
        line('{"text":"a \\u00e9 ', i, '","_id":', i, "}"), F.lit(""), line('{"title":null,"x":{"title":"no"},"text":"b\\/', i, '\\n","_id":"s', i, '"}'), line('{"_id":"t', i, '","title":"T \\"', i, '\\""}'),
    )
    _table(spark, sf, "benchmark").select("item_id", F.explode(lines).alias("value")).orderBy("item_id").select("value").write.text(path)
    return read_jsonl(spark, path).select("external_id", "text")


def _wiki_lines(spark: SparkSession, sf: str) -> DataFrame:
    page = F.format_string(
        "<page><title>Item %d</title><id>%d</id><revision><id>9</id><text xml:space=\"preserve\">'''%s''' [[Target page|label]] &amp;amp; {{tpl|{{x}}}}&lt;ref&gt;n&lt;/ref&gt; end</text></revision></page>",
        F.col("item_id"), F.col("item_id"), F.col("w"),
    )
    pages = _words(spark, sf).select(F.lit(1).alias("k"), "item_id", page.alias("value"))
    root = spark.createDataFrame([(0, 0, "<mediawiki>"), (2, 0, "</mediawiki>")], "k int, item_id bigint, value string")
    return pages.union(root).orderBy("k", "item_id").select("value")


def _wiki_file(spark: SparkSession, sf: str) -> str:
    """A dump is one document, so one file; each of its lines a page."""
    path = scratch(spark, "wiki")
    _wiki_lines(spark, sf).coalesce(1).write.text(path)
    return path


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    return read_wiki_xml(spark, _wiki_file(spark, sf))


def _wiki_first(spark: SparkSession, sf: str) -> DataFrame:
    return read_wiki_xml(spark, _wiki_file(spark, sf), max_docs=5, clean=False).select("doc_id", "external_id")


def _wiki_entities(spark: SparkSession, sf: str) -> DataFrame:
    """A dump whose text refers to an external entity: whatever the parser makes of it, the file's content is not read."""
    path, secret = scratch(spark, "wiki-entity"), scratch(spark, "secret")
    spark.createDataFrame([("TOPSECRET",)], "value string").write.text(secret)
    xml = f'<!DOCTYPE m [<!ENTITY x SYSTEM "{secret}">]><mediawiki><page><title>t</title><id>1</id><revision><id>1</id><text>&x;</text></revision></page></mediawiki>'
    spark.createDataFrame([(xml,)], "value string").write.text(path)
    return wiki_pages(spark, path).agg(F.count(F.when(F.col("text").contains("TOPSECRET"), 1)).alias("leaked"))


def _page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = _words(spark, sf).select(F.col("item_id").cast("string").alias("page_id"), F.concat(F.lit("Item "), "item_id").alias("title"), F.col("w").alias("text"))
    return find_source_pages(pages, ["7", "404", "3", "", "7", "12"])


def _renumbered(spark: SparkSession, sf: str) -> DataFrame:
    """Every third item has an id of its own, the others take the next free numbers."""
    docs = _table(spark, sf, "benchmark").orderBy("item_id").select(
        F.when(F.col("item_id") % 3 == 0, F.col("item_id") * 10 + 10).otherwise(-F.col("item_id")).alias("doc_id"), F.col("item_id").cast("string").alias("external_id"), "text"
    )
    return renumbered(docs).select("doc_id", "external_id")


#: Markup around an item's words (@), and what is to be read of it.
MARKUP: dict[str, tuple[str, str]] = {
    "markup_templates": ("{{a|{{b}}|c}}@{| class=x\n| cell\n|}{{open @", "@\n{{open @"),
    "markup_links": ("[[A_b#c]] [[x|@]] [[File:q.png|thumb|z [[y]]]][[Category:K]][http://e.org the @] [//e.org] [no] [[open", "A b @ the @ [no] [[open"),
    "markup_tags": ("a<ref name=x>gone</ref> <b>@</b><br/><!-- gone\n -->''i'' '''@'''<gallery>\ng\n</gallery>__TOC__z", "a @i @\nz"),
    "markup_entities": ("&lt;@&gt; &amp;lt; &#65;&#x42;&nbsp;&quot;&hellip;&mdash;&laquo;&#x110000;&unknown;", '<@> < AB "...-«&unknown;'),
    "markup_lines": ("== @ ==\r\n* one ,two\n## @\n; term : @\n:: x\t\ty\n\n\n\n  end .", "@\n- one,two\n- @\nterm: @\n: x y\n\nend."),
    "markup_unclosed": ("@ {{never [[closed <!-- @", "@ {{never [[closed <!-- @"),
}


def _markup(source: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _words(spark, sf).select("item_id", clean_wikitext_column(F.replace(F.lit(source), F.lit("@"), F.col("w"))).alias("text"))

    return run


def _markup_sql(text: str) -> str:
    return f"WITH {_WORDS_SQL} SELECT item_id, replace('{text}', '@', w) AS text FROM w"


# The index as a file, and the search facade.


def _reader(reader: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return candidates(load_index(spark, saved_at(spark, sf), reader), "the AND of").select("doc_id", *_big("frequency"))

    return run


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    meta = index_meta(spark, saved_at(spark, sf))
    return meta.select(*_big("format_version", "n", "total_len", "terms", "postings"), "codec", F.round("avgdl", 6).alias("avgdl"), F.forall(F.map_values("bytes"), lambda b: b > 0).alias("on_disk"))


def _one_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of single documents: one that matches, one that may not, one that is unknown."""
    engine = SearchEngine(index_of(spark, sf))
    return spark.createDataFrame([(i, round(engine.score_document("the OR of AND NOT zzz", i), 6)) for i in (7, 8, -1)], "doc_id bigint, score double")


def _has_more(spark: SparkSession, sf: str) -> DataFrame:
    engine = SearchEngine(index_of(spark, sf))
    pages = [engine.search_page("the AND of", offset, 10, rank=False) for offset in (0, 5, 1_000_000)]
    return spark.createDataFrame([(p.offset, len(p.results), p.total, p.has_more) for p in pages], "start bigint, shown bigint, total bigint, has_more boolean")


#: Texts of the search language and whether they are queries.
TEXTS: tuple[tuple[str, bool], ...] = (
    ("a", True), ("", False), ("   ", False), ("a AND", False), ("AND a", False), ("(a", False), ("a)", False), ("()", False), ("a NEAR/x b", False), ("a NEAR/ b", False), ("a NEAR/2147483647 b", True),
    ("a NEAR/2147483648 b", False), ("a b", False), ("NOT NOT a", True), ("a ADJ (b OR NOT c)", True), ("a OR OR b", False), ("a and not B near/0 c", True), ("a EDGE b", True),
)


def _syntax(spark: SparkSession, sf: str) -> DataFrame:
    def parses(text: str) -> bool:
        try:
            parse(text)
        except QuerySyntaxError:
            return False
        return True

    return spark.createDataFrame([(t, parses(t)) for t, _ in TEXTS], "text string, parses boolean")


def _standalone_codec(spark: SparkSession, sf: str) -> DataFrame:
    """The gaps of a table's keys, 25 nations, encoded by themselves and read back."""
    keys = [r.n_nationkey * 300 for r in _table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    data = codecs.encode_mode(keys, "delta-varbyte")
    return spark.createDataFrame([(data.hex(), codecs.decode_mode(data, "delta-varbyte") == keys)], "bytes string, same boolean")


# Command line and HTTP.


def _said(spark: SparkSession, sf: str, *args: str, lines: tuple[str, ...] = ()) -> list[str]:
    out = io.StringIO()
    cli.main(["--index-dir", saved_at(spark, sf), *args], lines, out, spark)
    return out.getvalue().splitlines()


def _cli_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = _said(spark, sf, "--query", "of ADJ the", "--no-ranking", "--limit", "5")
    return spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "line bigint, said string")


def _cli_talk(spark: SparkSession, sf: str) -> DataFrame:
    """Interactive lines: the first with a byte order mark, a wrong query, an end, and one that is never read."""
    lines = _said(spark, sf, "--no-ranking", "--limit", "1", lines=("﻿the AND of", "", "(the", ":quit", "of"))
    return spark.createDataFrame([(sum(x.endswith(" matches") for x in lines), lines[0])], "answers bigint, first string")


def _http_search(spark: SparkSession, sf: str) -> DataFrame:
    """/api/search, ranked, the second page of five."""
    status, body = SearchApi(SearchEngine(index_of(spark, sf))).answer("GET", "/api/search?q=the+AND+of&offset=5&limit=5")
    rows = [(status, k + 1, r["docId"], r["pageId"], round(r["score"], 6), body["total"], body["hasMore"], r["terms"]["the"]["total"]) for k, r in enumerate(body["results"])]
    return spark.createDataFrame(rows, "status bigint, rank bigint, doc_id bigint, page_id string, score double, total bigint, has_more boolean, the_count bigint")


#: Requests and their status.
REQUESTS: tuple[tuple[str, str, int], ...] = (
    ("GET", "/api/config", 200), ("GET", "/api/search", 400), ("GET", "/api/search?q=%20", 400), ("GET", "/api/search?q=(a", 400), ("GET", "/api/search?q=a&limit=0", 400), ("GET", "/api/search?q=a&limit=51", 400),
    ("GET", "/api/search?q=a&offset=-1", 400), ("GET", "/api/search?q=a&ranking=maybe", 400), ("POST", "/api/search?q=a", 405), ("GET", "/api/document?pageId=9", 404), ("GET", "/nope", 404), ("GET", "/", 200),
)


def _http_status(spark: SparkSession, sf: str) -> DataFrame:
    api = SearchApi(SearchEngine(index_of(spark, sf)))
    return spark.createDataFrame([(m, t, api.answer(m, t)[0]) for m, t, _ in REQUESTS], "method string, target string, status bigint")


def _http_document(spark: SparkSession, sf: str) -> DataFrame:
    pages = _words(spark, sf).select(F.col("item_id").cast("string").alias("page_id"), F.lit("T").alias("title"), F.concat(F.lit("'''"), "w", F.lit("'''")).alias("text"))
    status, body = SearchApi(SearchEngine(index_of(spark, sf)), pages).answer("GET", "/api/document?pageId=3")
    return spark.createDataFrame([(status, body["pageId"], body["title"], body["text"])], "status bigint, page_id string, title string, text string")


def _values(rows: tuple, names: str) -> str:
    lit = lambda v: {True: "true", False: "false"}[v] if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


_BOTH = f"{_has('the')} INTERSECT {_has('of')}"
_EITHER = f"{_has('the')} UNION {_has('of')}"

SURFACES: dict[str, tuple[Query, str]] = {
    "load_txt_folder": (_txt_folder, "SELECT row_number() OVER (ORDER BY 'item_id=' || item_id || '/') AS doc_id, item_id::VARCHAR AS folder, text || chr(10) AS text FROM benchmark"),
    "load_jsonl": (
        _jsonl,
        "SELECT row_number() OVER (ORDER BY doc_id) AS doc_id, 'd' || doc_id AS external_id, CASE WHEN doc_id % 3 > 0 AND lang <> '' THEN lang || ' ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents",
    ),
    "load_jsonl_odd": (
        _jsonl_odd,
        """SELECT item_id::VARCHAR AS external_id, 'a é ' || item_id AS text FROM benchmark UNION ALL SELECT 's' || item_id, 'b/' || item_id || chr(10) FROM benchmark
           UNION ALL SELECT 't' || item_id, 'T "' || item_id || '" ' FROM benchmark""",
    ),
    "load_wiki_xml": (
        _wiki, f"WITH {_WORDS_SQL} SELECT row_number() OVER (ORDER BY item_id) AS doc_id, item_id::VARCHAR AS external_id, 'Item ' || item_id || ' ' || w || ' label &' || chr(10) || 'end' AS text FROM w",
    ),
    "load_wiki_max_docs": (_wiki_first, "SELECT row_number() OVER (ORDER BY item_id) AS doc_id, item_id::VARCHAR AS external_id FROM benchmark ORDER BY item_id LIMIT 5"),
    "load_wiki_no_entities": (_wiki_entities, "SELECT 0::BIGINT AS leaked"),
    "page_lookup": (_page_lookup, f"WITH {_WORDS_SQL} SELECT item_id::VARCHAR AS page_id, 'Item ' || item_id AS title, w AS text FROM w WHERE item_id IN (3, 7, 12, 404)"),
    "renumbered_ids": (
        _renumbered,
        "SELECT CASE WHEN item_id % 3 = 0 THEN item_id * 10 + 10 ELSE (item_id - item_id % 3) * 10 + 10 + item_id % 3 END AS doc_id, item_id::VARCHAR AS external_id FROM benchmark",
    ),
    **{name: (_markup(source), _markup_sql(text)) for name, (source, text) in MARKUP.items()},
    "reader_disk": (_reader("disk"), _with(f"SELECT doc_id, max(n) AS frequency FROM (SELECT doc_id, term, count(*) AS n FROM tok WHERE term IN ('the', 'of') AND doc_id IN ({_BOTH}) GROUP BY ALL) GROUP BY doc_id")),
    "reader_mmap": (_reader("mmap"), _with(f"SELECT doc_id, max(n) AS frequency FROM (SELECT doc_id, term, count(*) AS n FROM tok WHERE term IN ('the', 'of') AND doc_id IN ({_BOTH}) GROUP BY ALL) GROUP BY doc_id")),
    "index_meta": (
        _meta,
        _with("""SELECT 1::BIGINT AS format_version, count(*) AS n, sum(length)::BIGINT AS total_len, (SELECT count(DISTINCT term) FROM tok) AS terms, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM tok)) AS postings,
            'zstd' AS codec, round(sum(length)::DOUBLE / count(*), 6) AS avgdl, true AS on_disk FROM meta"""),
    ),
    "score_one_document": (
        _one_score, f"WITH {_TOK}, {_bm25_sql('SELECT doc_id FROM documents WHERE doc_id IN (7, 8)', ['the', 'of'])}\nSELECT doc_id, score FROM scored UNION ALL SELECT -1, 0.0",
    ),
    "has_more": (
        _has_more,
        _with(f", t2 AS (SELECT count(*) AS total FROM ({_BOTH})) SELECT start, least(10, greatest(0, total - start))::BIGINT AS shown, total, start + least(10, greatest(0, total - start)) < total AS has_more FROM t2, (VALUES (0::BIGINT), (5), (1000000)) v(start)").replace("\n,", ",", 1),
    ),
    "syntax_errors": (_syntax, _values(TEXTS, "text, parses")),
    "standalone_codec": (
        _standalone_codec,
        "SELECT '19' || '00' || string_agg(CASE WHEN n_nationkey > 0 THEN 'ac02' ELSE '' END, '') AS bytes, true AS same FROM nation",  # 25 keys: 0, then gaps of 300
    ),
    "cli_query": (
        _cli_query,
        _with(f""", m AS (SELECT doc_id FROM (SELECT DISTINCT l.doc_id FROM tok l JOIN tok r ON l.doc_id = r.doc_id AND r.position = l.position + 1 WHERE l.term = 'of' AND r.term = 'the')),
            p AS (SELECT row_number() OVER (ORDER BY doc_id) AS line, doc_id FROM m)
            SELECT line, format('{{:2d}}. score=0.000000 docId={{:d}} page={{:d}}', line, doc_id, doc_id) AS said FROM p WHERE line <= 5 UNION ALL SELECT 0, count(*) || ' matches' FROM m""").replace("\n,", ",", 1),
    ),
    "cli_talk": (_cli_talk, _with(f"SELECT 1::BIGINT AS answers, count(*) || ' matches' AS first FROM ({_BOTH})")),
    "http_search": (
        _http_search,
        f"""WITH {_TOK}, {_bm25_sql(_BOTH, ['the', 'of'])}
        SELECT 200::BIGINT AS status, row_number() OVER (ORDER BY score DESC, doc_id) - 5 AS rank, doc_id, doc_id::VARCHAR AS page_id, score, (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored) > 10 AS has_more,
            (SELECT count(*) FROM tok WHERE tok.doc_id = scored.doc_id AND term = 'the') AS the_count FROM scored ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5""",
    ),
    "http_status": (_http_status, _values(REQUESTS, "method, target, status")),
    "http_document": (_http_document, f"WITH {_WORDS_SQL} SELECT 200::BIGINT AS status, item_id::VARCHAR AS page_id, 'T' AS title, w AS text FROM w WHERE item_id = 3"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in SURFACES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SURFACES.items()}
