import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from lumensift import cli
from lumensift.engine import SearchEngine
from lumensift.http_api import SearchApi, serve
from lumensift.operators.index import build_index
from lumensift.operators.index_report import index_report
from lumensift.sources.loaders import read_wiki_xml, wiki_pages


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    f = tmp_path_factory.mktemp("w") / "wiki.xml"
    f.write_text("<mediawiki>" + "".join(f"<page><title>T{k}</title><id>{k}</id><revision><id>9{k}</id><text>common '''bold''' page {k}</text></revision></page>" for k in range(100, 112)) + "</mediawiki>")
    return str(f)


@pytest.fixture(scope="module")
def url(spark, dump):
    server = serve(SearchApi(SearchEngine(build_index(read_wiki_xml(spark, dump))), wiki_pages(spark, dump)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def get(url, method="GET"):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method)) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_http(url):
    status, one = get(f"{url}/api/search?q=common&ranking=false")
    _, two = get(f"{url}/api/search?q=common&ranking=false&offset=10")
    assert status == 200 and one["total"] == 12 and one["hasMore"] and not two["hasMore"] and len(one["results"]) == 10 and len(two["results"]) == 2
    first = one["results"][0]
    assert first["pageId"] == "100" and first["terms"] == {"common": {"total": 1, "positions": [1]}} and first["score"] == 0
    assert get(f"{url}/api/document?pageId=105")[1]["text"] == "common bold page 105" and get(f"{url}/api/document?pageId=9")[0] == 404
    assert get(f"{url}/api/config")[0] == 200 and get(f"{url}/api/config", "POST")[0] == 405 and get(f"{url}/nope")[0] == 404
    for bad in ("", "?q=%20", "?q=a&limit=51", "?q=a&limit=0", "?q=a&offset=-1", "?q=a&ranking=maybe", "?q=(a"):
        assert get(f"{url}/api/search{bad}")[0] == 400


def test_cli(spark, dump, tmp_path):
    def run(*args, lines=()):
        out = io.StringIO()
        assert cli.main(list(args), lines, out, spark) == 0
        return out.getvalue()

    ix = str(tmp_path / "ix")
    out = run("--wiki", dump, "--index-dir", ix, "--query", "common AND 105", "--show-docs", "--show-source", "--compare-compression")
    assert " 1. score=" in out and "docId=6 page=105" in out and "delta-pfor, " in out and "--- 105 T105\ncommon bold page 105" in out and "common: [1]" in out
    out = run("--index-dir", ix, "--limit", "2", "--no-ranking", "--reader", "mmap", "--source-wiki", dump, lines=["﻿common", ":help", "a b", "", ":open 103", ":open 1", ":quit", "never"])
    assert out.startswith("12 matches\n 1. score=0.000000 docId=1 page=100\n 2.") and "Invalid query" in out and "T103\ncommon bold page 103" in out and "no page 1\n" in out
    assert run("--source-wiki", dump, "--page-id", "101") == "T101\ncommon bold page 101\n"
    for bad in (["--limit", "0"], ["--wiki", "a", "--txt", "b"], ["--compression", "zip"], []):
        with pytest.raises(SystemExit):
            run(*bad)


def test_registered_queries_have_sql_and_run(spark):
    import __spark_entry__ as e
    from lumensift.plans import queries as q

    assert set(q.queries()) == set(q.oracle_sql()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 87


def test_nothing_else_imports_the_llm_package():
    from pathlib import Path

    root = Path(cli.__file__).parent
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert "lumensift.llm" not in f.read_text(), f


def test_index_report(spark, tmp_path, dump):
    docs = read_wiki_xml(spark, dump)
    rows = index_report(docs, str(tmp_path), "common", ("none", "zstd")).collect()
    assert [r.codec for r in rows] == ["none", "zstd"] and all(r.write_seconds > 0 and r.bytes > r.postings_bytes > 0 and r.warm_seconds > 0 for r in rows)
    out = io.StringIO()
    assert cli.main(["--wiki", dump, "--query", "common", "--index-report", "common"], [], out, spark) == 0
    assert [line.split(",")[0] for line in out.getvalue().splitlines()[:4]] == ["none", "snappy", "gzip", "zstd"]


def test_page_and_headers(url):
    for path, kind in (("/", "text/html"), ("/search.js", "text/javascript"), ("/search.css", "text/css")):
        with urllib.request.urlopen(url + path) as r:
            assert r.status == 200 and r.headers["Content-Type"] == f"{kind}; charset=utf-8" and r.headers["X-Frame-Options"] == "DENY" and "default-src 'none'" in r.headers["Content-Security-Policy"]
            assert r.read()
    assert get(f"{url}/../cli.py")[0] == 404
