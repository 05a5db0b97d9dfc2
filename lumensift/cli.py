"""Command line: build an index of a text folder, JSON lines or a wiki dump, and search it."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from lumensift.engine import SearchEngine
from lumensift.functions.markup import clean_wikitext
from lumensift.operators import codecs
from lumensift.operators.index import build_index
from lumensift.operators.index_report import index_report
from lumensift.sources.loaders import find_source_pages, read_jsonl, read_txt_folder, read_wiki_xml, wiki_pages
from lumensift.workspace import scratch

SHOWN_POSITIONS = 32
HELP = ":open <id> shows a source page, :help this, :quit ends"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumensift", description=__doc__)
    source = p.add_mutually_exclusive_group()
    source.add_argument("--txt", help="folder of .txt files")
    source.add_argument("--jsonl", "--beir", dest="jsonl", help="JSON lines with _id, title, text")
    source.add_argument("--wiki", help="MediaWiki XML dump")
    p.add_argument("--index-dir")
    p.add_argument("--max-docs", type=int)
    p.add_argument("--top-k", "--limit", dest="limit", type=int, default=10)
    p.add_argument("--query")
    p.add_argument("--show-docs", action="store_true")
    p.add_argument("--show-source", action="store_true")
    p.add_argument("--source-wiki")
    p.add_argument("--page-id")
    p.add_argument("--no-ranking", action="store_true")
    p.add_argument("--reader", choices=("mmap", "disk"), default="disk")
    p.add_argument("--compression", type=str.lower, choices=codecs.MODES, default="delta-varbyte", help="for the size report; tables are Parquet with zstd")
    p.add_argument("--compare-compression", action="store_true", help="sizes of the index under eight integer codecs")
    p.add_argument("--index-report", metavar="QUERY", help="write time, size and query times of the index under each table codec")
    return p


class Cli:
    def __init__(self, spark: SparkSession, options: argparse.Namespace, out: TextIO):
        self.spark, self.o, self.out = spark, options, out
        self.pages = wiki_pages(spark, w) if (w := options.source_wiki or options.wiki) else None

    def say(self, text: str = "") -> None:
        print(text, file=self.out)

    def engine(self) -> SearchEngine:
        o = self.o
        path = o.index_dir or scratch(self.spark, "index")
        docs = None
        if o.txt:
            docs = read_txt_folder(self.spark, o.txt)
        elif o.jsonl:
            docs = read_jsonl(self.spark, o.jsonl)
        elif o.wiki:
            docs = read_wiki_xml(self.spark, o.wiki, o.max_docs)
        elif not o.index_dir:
            raise SystemExit("give a source (--txt, --jsonl or --wiki) or an existing --index-dir")
        if docs is not None:
            if o.max_docs is not None:
                docs = docs.filter(docs.doc_id <= o.max_docs)
            if o.index_report:
                for r in index_report(docs, scratch(self.spark, "report"), o.index_report).collect():
                    self.say(f"{r.codec}, {r.write_seconds:.3f} s, {r.bytes} bytes, postings {r.postings_bytes}, cold {r.cold_seconds:.3f} s, warm {r.warm_seconds:.3f} s")
            build_index(docs).save(path)
        engine = SearchEngine.open(self.spark, path, o.reader)
        if o.compare_compression:
            for r in codecs.size_report(engine.index).collect():
                self.say(f"{r.mode}, {r.raw_bytes}, {r.compressed_bytes}, {r.ratio:.3f}")
        return engine

    def show(self, engine: SearchEngine, query: str) -> None:
        page = engine.search_page(query, 0, self.o.limit, not self.o.no_ranking)
        self.say(f"{page.total} matches")
        for k, r in enumerate(page.results, 1):
            self.say(f"{k:2d}. score={r.score:.6f} docId={r.doc_id} page={r.external_id}")
            if self.o.show_docs:
                self.say(f"    {r.snippet}")
                for t, p in r.term_positions.items():
                    self.say(f"    {t}: {list(p)[:SHOWN_POSITIONS]}{' ...' if len(p) > SHOWN_POSITIONS else ''}")
        if self.o.show_source and self.pages is not None:
            for row in find_source_pages(self.pages, [r.external_id for r in page.results]).collect():
                self.say(f"--- {row.page_id} {row.title}\n{clean_wikitext(row.text)}")

    def open_page(self, page_id: str) -> None:
        row = find_source_pages(self.pages, [page_id]).first() if self.pages is not None else None
        self.say(f"{row.title}\n{clean_wikitext(row.text)}" if row else f"no page {page_id}")

    def talk(self, engine: SearchEngine, lines: Iterable[str]) -> None:
        for line in lines:
            line = line.removeprefix("﻿").strip()
            if line in (":quit", ":q", "exit"):
                return
            if line == ":help":
                self.say(HELP)
            elif line.startswith(":open "):
                self.open_page(line[6:].strip())
            elif line:
                try:
                    self.show(engine, line)
                except ValueError as e:
                    self.say(str(e))


def main(args: list[str] | None = None, lines: Iterable[str] | None = None, out: TextIO = sys.stdout, spark: SparkSession | None = None) -> int:
    parser = arguments()
    o = parser.parse_args(args)
    if o.limit <= 0 or (o.max_docs is not None and o.max_docs <= 0):
        parser.error("limits must be positive")
    cli = Cli(spark or SparkSession.builder.appName("lumensift").getOrCreate(), o, out)
    if o.page_id and not (o.txt or o.jsonl or o.wiki or o.index_dir):
        cli.open_page(o.page_id)
        return 0
    engine = cli.engine()
    if o.page_id:
        cli.open_page(o.page_id)
    if o.query:
        cli.show(engine, o.query)
    elif not o.page_id:
        cli.talk(engine, lines if lines is not None else sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
