"""Main-text extraction: a template of equivalence classes is deduced for each host and what remains in its slots is read.

Tokens are the element paths of a page and its text blocks under their paths. Tokens of a host with the same occurrence
vector over its pages (how often on which page) form an equivalence class; a class is valid if it stands on a share of the
host's pages, and a valid class nests by its paths: the text of a class is template text if it stands on most of the pages
that have its path, so a template of one section, or one that an odd page lacks, is found as well. The blocks that differ
are the slots. Slots whose path names a menu, header, footer, sidebar, notice, advert, form, script or reader comment are
not main text. A page that marks its article (article, main or role=main) is read there only, without its template text,
unless what it marks is but a teaser: less than TEASER of the text in the page's slots. A name that speaks against an
element above the marked article may be a layout's (search-results, overlay-wrap), and a form may span the whole page: that
rules the article out only if the page has another one under fewer such names. Without an article, what lies under such
names is read if nothing but template text lies outside them.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import lookup, pieces, staged
from lumensift.llm.token_counts import _arrow

#: A class of a host's template stands on at least so many different pages, and on this share of the host's different pages.
LEAST_PAGES, LEAST_SHARE = 3, 0.2
#: A text nests in the template if it stands on more than this share of the pages that have its path.
OF_PATH = 0.5
#: Marked articles with less than this share of a page's slot text are teasers: then all slots are read.
TEASER = 0.25
#: Bytes of pages whose texts are returned at a time, unless one page has more.
PIECE = 1_000_000

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NOT_MAIN = _RAW | {"head", "nav", "footer", "aside", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "fieldset", "math"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _RAW
#: What may stand in a head; anything else ends it, its end tag being optional.
_IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template", "head"}
#: Elements with optional end tags that an opening element ends if they are innermost.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"td", "th", "tr", "tbody", "caption"}, "tbody": {"td", "th", "tr", "thead", "tbody", "caption"}, "tfoot": {"td", "th", "tr", "thead", "tbody", "caption"},
}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"} - _RAW
_NOT_MAIN_WORD = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|masthead|topbar|site-header|page-header|footer|sidebar|aside|widgets?|related|recommend(?:ed|ations)?|"
    r"ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|notices?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|login|"
    r"shar(?:e|ing)|social|comments?|commentlist|disqus|respond|repl(?:y|ies)|pagination|pager|toolbar|skip-link|skip|hidden|sr-only|forms?|search|tagcloud)(?=$|[\s_-]|\d)"
)
#: Classes that say what a page has, how a box is clipped or where a post is filed, not what an element is.
_STATE = re.compile(r"(?:has|no|not|with|without|overflow|hide|show|enabled?|disabled?|category|tag|format)[_-]")
_NOT_MAIN_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")


@dataclass(slots=True)
class Block:
    path: str
    text: str
    main: bool
    dropped: bool
    wraps: int  # elements above, outside any article, whose name speaks against main text


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', data, '') , ('open', name, attributes) and ('close', name, ''). Comments, declarations and raw elements' contents are left out."""
    at, n, low = 0, len(page), None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "text", _html.escape(page[lt + 9 : n if end < 0 else end]), ""
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing and (end := page.find(">", lt)) >= 0:
                at = end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        tag = name[0].lower()
        stop = _TAG_END.match(page, name.end())
        end = stop.end() if stop else page.find(">", name.end()) + 1
        if end <= 0:  # a tag that the page's end cuts off
            return
        if closing:
            yield "close", tag, ""
        else:
            attributes = page[name.end() : end - 1]
            yield "open", tag, attributes
            if tag in _RAW:
                low = page.lower() if low is None else low
                close = low.find(f"</{tag}", end) if len(low) == n else page.find(f"</{tag}", end)
                if close < 0:
                    return
                end = close
        at = end


def _not_main(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, str]:
    """Whether the element is not main text, whether its name speaks against it, whether it marks the article, and its name in paths."""
    if tag in _NOT_MAIN or (tag == "header" and not in_article):
        return True, False, False, tag
    if not attributes.strip(" /"):
        return False, tag == "form", tag in ("article", "main"), tag
    a = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attributes)}
    mark = " ".join(x for x in (a.get("id", ""), a.get("class", "")) if x)
    out = "hidden" in a or a.get("role") in _NOT_MAIN_ROLE or "display:none" in a.get("style", "").replace(" ", "")
    against = tag == "form" or tag not in ("html", "body", "main") and a.get("role") != "main" and any(_NOT_MAIN_WORD.search(x) for x in mark.split() if not _STATE.match(x))
    # Numbers tell pages apart (post-17), not places in the template.
    return out, against, tag in ("article", "main") or a.get("role") == "main", tag + ("." + ".".join(sorted(_DIGITS.sub("0", mark).split())) if mark else "")


class Blocks(list):
    """The text blocks of a page; marked says whether it marks an article, be it an empty one."""

    marked = False


def blocks(page: str | None) -> Blocks:
    """The non-empty text blocks of a page, in order. White space runs are one space, character references decoded."""
    out = Blocks()
    stack: list[tuple[str, bool, bool, str, int]] = []  # tag, not main here or above, article here or above, path, names against it above the article
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                _, dropped, main, path, wraps = stack[-1] if stack else ("", False, False, "", 0)
                out.append(Block(path, text, main, dropped, wraps))
            parts.clear()

    for kind, data, attributes in _events(page or ""):
        if stack and stack[-1][0] == "head" and (kind == "open" and data not in _IN_HEAD or kind == "text" and not data.isspace()):
            flush()
            stack.pop()
        if kind == "text":
            parts.append(data)
        elif data == "br":
            parts.append(" ")
        elif kind == "open":
            if data in _BLOCK:
                flush()
                if data in _ENDS_P and stack and stack[-1][0] == "p":
                    stack.pop()
                while stack and stack[-1][0] in _ENDS.get(data, ()):
                    stack.pop()
            if data not in _VOID:
                _, dropped, main, path, wraps = stack[-1] if stack else ("", False, False, "", 0)
                bad, against, is_main, name = _not_main(data, attributes, main)
                out.marked = out.marked or (is_main and not dropped and not bad)
                if against:
                    if main or is_main or data not in _BLOCK:
                        bad = True
                    else:
                        wraps += 1
                if data in _BLOCK or bad:
                    if bad and data not in _BLOCK:
                        flush()
                    if not attributes.endswith("/") or data in _BLOCK:
                        # A path is carried as a hash, so that deep nesting stays cheap.
                        stack.append((data, dropped or bad, main or is_main, xxhash.xxh64_hexdigest(f"{path}/{name}"), wraps))
        else:
            if data in _BLOCK or any(s[0] == data for s in stack):
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == data:
                        del stack[k:]
                        break
    flush()
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host_of(url: str | None) -> str | None:
    m = re.match(HOST, url or "")
    return m[1].lower() or None if m else None


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page, token, path, n: the paths of each page's blocks (path null), and its blocks with their paths."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("path", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, int] = {}
            for i in range(batch.num_rows):
                host = host_of(batch.column(0)[i].as_py())
                if host is None:
                    continue
                every = blocks(batch.column(1)[i].as_py())
                found = [b for b in every if not b.dropped]
                whole = _hash(main_text(every))  # pages that read alike count once, whatever advert or comment stands beside
                own: dict[tuple, int] = {}
                for b in found:
                    path = _hash(b.path)
                    own[path, None] = own.get((path, None), 0) + 1
                    text = _hash(b.path, b.text)
                    own[text, path] = own.get((text, path), 0) + 1
                rows |= {(host, whole, token, path): n for (token, path), n in own.items()}
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = {}
            if rows:
                yield _batch(rows, schema)
            del batch, rows  # before the next one is read

    return pages.select("__url", "__html").mapInArrow(run, "host string, page bigint, token bigint, path bigint, n bigint")


def _batch(rows: dict[tuple, int], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True), rows.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def deduce_templates(tokens: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, of_path: float = OF_PATH) -> DataFrame:
    """host, class_id, pages, texts: the valid equivalence classes of each host that hold template text.

    A token's occurrence vector is summed up in an order-free hash of (page, count), with its number of pages; equal
    vectors are equal hashes. A class is valid if its tokens occur on least_pages different pages and on least_share of
    the host's. It nests under its elements' paths, which stand wherever its texts do; its texts on more than of_path of
    their path's pages are template text, the others fill slots. All texts of a host's classes together are at most
    1 / least_share times what one page holds.
    """
    unique = staged(tokens.dropDuplicates(["host", "page", "token", "path"]), "page-tokens")
    vectors = unique.groupBy("host", "token", "path").agg(F.bit_xor(F.xxhash64("page", "n")).alias("v"), F.count(F.lit(1)).alias("pages"))
    # A host's number of different pages: each has a token, so the largest support bounds it from below, a distinct count is exact.
    sizes = unique.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    valid = vectors.filter(F.col("pages") >= least_pages).join(sizes, "host").filter(F.col("pages") >= F.col("host_pages") * least_share)
    paths = valid.filter("path is null").select("host", F.col("token").alias("path"), F.col("pages").alias("path_pages"))
    nested = valid.filter("path is not null").join(paths, ["host", "path"]).filter(F.col("pages") > F.col("path_pages") * of_path)
    return nested.groupBy("host", F.col("v").alias("class_id"), "pages").agg(F.collect_list("token").alias("texts"))


def main_text(found: Blocks, template: set[int] = frozenset()) -> str:
    """The marked article's blocks, if there are any and they are no teaser, else all; without what their path or the host's template rules out."""
    rest = [b for b in found if not b.dropped and not (template and _hash(b.path, b.text) in template)]
    article = [b for b in rest if b.main]
    least = min((b.wraps for b in article), default=0)
    article = [b for b in article if b.wraps == least]
    lowest = min((b.wraps for b in rest), default=0)
    slots = [b for b in rest if b.wraps == lowest or b.main and b.wraps == least]
    size = lambda some: sum(len(b.text) for b in some)
    if found.marked and (lowest > 0 or size(article) >= TEASER * size(slots)):
        return "\n\n".join(b.text for b in article)
    return "\n\n".join(b.text for b in slots)


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points), and the columns of keep as they are.

    Blocks of the main text are joined by two line feeds. A null or empty html, or one without main text, gives an empty
    text. A null or odd url has no host and so no template. Pages of a host with fewer than least_pages different pages
    are read by their paths alone. Ids may be null or repeat; other columns play no part; pages are read whole.
    """
    pages = df.select(df[f"`{id_col}`"].alias("__id"), df[f"`{url_col}`"].alias("__url"), df[f"`{html_col}`"].alias("__html"), *(df[f"`{c}`"].alias(f"__k{i}") for i, c in enumerate(keep)))
    classes = deduce_templates(page_tokens(pages), least_pages)
    templates = staged(classes.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts")), "templates")
    ahead = [("__id", df.schema[id_col].dataType), ("__url", df.schema[url_col].dataType)]
    behind = [(f"__k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    ddl = ", ".join([*(f"{n} {t.simpleString()}" for n, t in ahead), "text string, n_chars bigint", *(f"{n} {t.simpleString()}" for n, t in behind)])
    schema = pa.schema([*((n, _arrow(t)) for n, t in ahead), ("text", pa.string()), ("n_chars", pa.int64()), *((n, _arrow(t)) for n, t in behind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in pieces(batch.column(2), PIECE):
                some = batch.slice(at, end - at)
                sources, template = some.column(2), some.column(3)
                texts = [main_text(blocks(sources[i].as_py()), set(template[i].as_py() or ())) for i in range(some.num_rows)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *some.columns[4:]], schema=schema)
            batch = some = sources = template = None  # before the next one is read

    if templates.limit(1).count() == 0:  # no host has template text: there is nothing to join
        ready = pages.withColumn("texts", F.lit(None).cast("array<bigint>"))
    else:
        hosted = pages.withColumn("host", F.nullif(F.lower(F.regexp_extract("__url", HOST, 1)), F.lit("")))
        weights = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("w"))
        sized = templates.withColumn("size", F.size("texts"))
        ready = lookup(hosted, sized.join(weights, "host").select("host", "w", "texts", "size"), "host", "w", salt="__url", size="size")
    names = {"__id": id_col, "__url": url_col} | {f"__k{i}": c for i, c in enumerate(keep)}
    return ready.select("__id", "__url", "__html", "texts", *(n for n, _ in behind)).mapInArrow(read, ddl).withColumnsRenamed(names)
