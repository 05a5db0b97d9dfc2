"""A thin JSON API over a saved index, GET /api/search, /api/document and /api/config, and a page that uses it."""

from __future__ import annotations

import argparse
import json
import time
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Lock
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from lumensift.engine import SearchEngine
from lumensift.functions.markup import clean_wikitext
from lumensift.sources.loaders import find_source_pages, wiki_pages

MAX_LIMIT, SHOWN_POSITIONS, CACHED_PAGES = 50, 32, 32
HEADERS = {
    "X-Content-Type-Options": "nosniff", "Cache-Control": "no-store", "Referrer-Policy": "no-referrer", "X-Frame-Options": "DENY",
    "Content-Security-Policy": "default-src 'none'; script-src 'self'; style-src 'self'; connect-src 'self'",
}
#: Path and content type of the page's files, which lie in the folder web.
FILES = {"/": ("search.html", "text/html"), "/search.js": ("search.js", "text/javascript"), "/search.css": ("search.css", "text/css")}


class BadRequest(ValueError):
    pass


class SearchApi:
    def __init__(self, engine: SearchEngine, source_pages: DataFrame | None = None):
        self.engine, self.pages, self.cache, self.lock = engine, source_pages, OrderedDict(), Lock()

    @staticmethod
    def _whole(params: dict, name: str, default: int, low: int, high: int) -> int:
        value = params.get(name, str(default))
        if not value.isascii() or not value.isdigit() or not low <= int(value) <= high:
            raise BadRequest(f"{name} must be a whole number from {low} to {high}")
        return int(value)

    def search(self, params: dict) -> dict:
        query, ranking = params.get("q", "").strip(), params.get("ranking", "true")
        if not query:
            raise BadRequest("q is required")
        if ranking not in ("true", "false"):
            raise BadRequest("ranking must be true or false")
        offset, limit = self._whole(params, "offset", 0, 0, 2**31 - 1), self._whole(params, "limit", 10, 1, MAX_LIMIT)
        began = time.monotonic()
        page = self.engine.search_page(query, offset, limit, ranking == "true")
        rows = [
            {
                "docId": r.doc_id, "pageId": r.external_id, "score": r.score, "snippet": r.snippet,
                "terms": {t: {"total": len(p), "positions": list(p)[:SHOWN_POSITIONS]} for t, p in r.term_positions.items()},
            }
            for r in page.results
        ]
        return {
            "query": query, "ranking": ranking == "true", "elapsedMs": round((time.monotonic() - began) * 1000, 3), "total": page.total, "offset": offset, "limit": limit,
            "hasMore": page.has_more, "results": rows,
        }

    def document(self, page_id: str) -> dict | None:
        """The cleaned source page, or None; the last pages are remembered."""
        if self.pages is None or not page_id:
            return None
        with self.lock:
            if page_id in self.cache:
                self.cache.move_to_end(page_id)
                return self.cache[page_id]
        row = find_source_pages(self.pages, [page_id]).first()
        if row is None:
            return None
        out = {"pageId": row.page_id, "title": row.title, "text": clean_wikitext(row.text)}
        with self.lock:
            self.cache[page_id] = out
            while len(self.cache) > CACHED_PAGES:
                self.cache.popitem(last=False)
        return out

    def answer(self, method: str, target: str) -> tuple[int, dict | str]:
        """The status and the body: an object, or the text of one of FILES."""
        url = urlsplit(target)
        params = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        if method != "GET":
            return 405, {"error": "only GET is allowed"}
        try:
            if url.path == "/api/search":
                return 200, self.search(params)
            if url.path == "/api/document":
                found = self.document(params.get("pageId", ""))
                return (200, found) if found else (404, {"error": "unknown page"})
            if url.path == "/api/config":
                return 200, {"defaultLimit": 10, "maxLimit": MAX_LIMIT, "operators": ["AND", "OR", "NOT", "ADJ", "EDGE", "NEAR/k"]}
            if url.path in FILES:
                return 200, (Path(__file__).parent / "web" / FILES[url.path][0]).read_text(encoding="utf-8")
        except (ValueError, OverflowError) as e:
            return 400, {"error": str(e)}
        return 404, {"error": "unknown path"}


def serve(api: SearchApi, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            status, body = api.answer(self.command, self.path)
            text = isinstance(body, str)
            kind = FILES[urlsplit(self.path).path][1] if text else "application/json"
            data = (body if text else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            for k, v in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(data)), **HEADERS}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _reply  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="JSON API over a saved index")
    p.add_argument("--index-dir", required=True)
    p.add_argument("--source-wiki")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--reader", choices=("disk", "mmap"), default="disk")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lumensift-http").getOrCreate()
    pages = wiki_pages(spark, a.source_wiki).persist() if a.source_wiki else None
    serve(SearchApi(SearchEngine.open(spark, a.index_dir, a.reader), pages), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
