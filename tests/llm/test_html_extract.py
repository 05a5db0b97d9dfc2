import html
import re

from pyspark.sql import types as T

from lumensift.llm.html_extract import blocks, extract, host_of, main_text


def read(page):
    return main_text(blocks(page))


def test_plain_article():
    page = """<!DOCTYPE html><html lang=en><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no";</script></head>
    <body><nav><ul><li><a href="/a">a</a></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div><header>site</header>
    <article><header><h1>Head &amp; &eacute;</h1></header><p><b>One  two<br>three<br><p>Four &lt;p&gt; 5 < 6</p><div class="share-buttons">tweet</div>
    <aside>also</aside><form><p>mail</p></form><section id=comments><p>first!</p></section>last</article><footer>&copy;</footer>"""
    assert read(page) == "Head & é\n\nOne two three\n\nFour <p> 5 < 6\n\nlast"


def test_odd_pages():
    assert read(None) == read("") == read("<p>") == read("<!-- <p>x</p>") == read("<script>x") == ""
    assert read("just text") == "just text"
    assert read("<p>a<td>b</p><p>c<div>d</p>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert read('<article class="comment"><p>hi</p></article><p>real</p>') == "real"
    assert read("<p>x &am &amp y</p>") == "x &am & y"
    assert read('<p title="a>b">t</p><a <p>') == "t"
    assert read("<div hidden>no</div><div style='display: none'>no</div><div role=banner>no</div><main><p>yes</p></main><p>after</p>") == "yes"
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert read(deep) == "x" and read(deep[:100_001]) == "x" and read(deep[:40_000]) == ""


def test_hosts():
    assert [host_of(u) for u in ("https://U@A.example.org:80/x?y", "http://b", "nope", None, "http:///x")] == ["a.example.org", "b", None, None, None]


def soup(k):
    return f"<html><body><div>Best site ever</div><div><p>Article number {k} of many</p><p>More of {k * 7}</p></div><div>All about us</div></body></html>"


def test_template_is_deduced_where_no_article_is_marked(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.StringType()), ("host", T.StringType()))])
    rows = [(k, f"http://s.example.org/{k}", soup(k), "x", "y") for k in range(6)]
    rows += [(10, "http://t.example.org/", soup(1), None, None), (11, "http://u.example.org/", soup(1), None, None), (12, "http://u.example.org/2", soup(1), None, None), (13, "http://u.example.org/3", soup(1), None, None)]
    rows += [(20, None, "<article><p>a</p></article>", None, None), (None, "bad", None, None, None), (21, "http://s.example.org/21", "<article>Best site ever</article><div>Best site ever</div><div>All about us</div>", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.page_id: r.text for r in extract(df.filter("page_id is null or page_id < 21")).collect()}
    assert [got[k] for k in range(6)] == [f"Article number {k} of many\n\nMore of {k * 7}" for k in range(6)]
    # One page, or copies of one, tell nothing of a template.
    assert {got[k] for k in (10, 11, 12, 13)} == {"Best site ever\n\nArticle number 1 of many\n\nMore of 7\n\nAll about us"}
    assert got[20] == "a" and got[None] == ""
    assert {r.page_id: r.text for r in extract(df).collect()}[21] == "Best site ever"
    assert extract(df.limit(0)).count() == 0


def test_driver_pages_against_a_regex_reader(spark):
    import glob

    df = spark.read.parquet(*glob.glob("/root/testdata/sf0.001/pages.parquet"))
    for r in extract(df).join(df.drop("url"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_template_that_some_pages_lack(spark):
    """One odd page, a section's own template, and repeated blocks inside a marked article."""
    rows = [(k, f"http://s.example.org/{k}", soup(k)) for k in range(20)] + [(99, "http://s.example.org/404", "<html><body><p>Gone away</p></body></html>")]
    section = lambda k: "<div id=lane><p>News desk</p></div>" if k < 6 else ""
    rows += [(200 + k, f"http://n.example.org/{k}", f"<body>{section(k)}<div id=post-{k}><p>Story {k % 19} told</p><p>Part {k}</p></div></body>") for k in range(20)]
    rows += [(300 + k, f"http://a.example.org/{k}", f"<body><article><p>Tale {k}</p><div>Buy our mugs</div></article></body>") for k in range(12)]
    rows += [(400, "http://a.example.org/x", "<body><article><p>Buy our mugs</p></article></body>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[k] for k in range(20)] == [f"Article number {k} of many\n\nMore of {k * 7}" for k in range(20)] and got[99] == "Gone away"
    assert [got[200 + k] for k in range(20)] == [f"Story {k % 19} told\n\nPart {k}" for k in range(20)]
    assert [got[300 + k] for k in range(12)] == [f"Tale {k}" for k in range(12)] and got[400] == "Buy our mugs"


def test_names_of_wrappers():
    for name in ("layout has-sidebar", "no-sidebar", "overflow-hidden", "with-comments", "search-results", "overlay-wrap form"):
        page = f'<div class="{name}"><article><p>Story</p><div class=share-buttons>tweet</div></article><div id=comments><article><p>first!</p></article></div></div><p>after</p>'
        assert read(page) == "Story", name
    assert read('<article class="post category-social"><p>a</p></article><p>b</p>') == "a"
    assert read('<div id=comments><article><p>first!</p></article></div><article><p>a</p></article>') == "a"
    assert read('<article><p>a</p><section id=comments><article><p>first!</p></article></section></article>') == "a"
    assert read('<nav class=no-sidebar>n</nav><div class="search-results"><p>a</p><div class=comments>c</div></div>') == "a"
    assert read('<p>a</p><div class=sidebar>s</div><div class=visually-hidden>v</div>') == "a"


def test_page_shapes():
    assert read("<html><head><title>t</title><meta charset=utf-8><body><p>a</p></body>") == "a"
    assert read("<title>t</title><link rel=x><div>a</div>") == read("<head><title>t</title><div>a</div>") == read("<head><title>t</title>a") == "a"
    assert read("<html><head><title>t</title><style>p{}</style>\n<script>1</script>\n<nav>n</nav><article><p>a") == "a"
    assert read('<body class="has-sidebar"><div class="has-sidebar"><p>a</p></div>') == "a"
    # A form around the page is its layout; one beside or inside the text is a form.
    assert read('<body><form id=aspnetForm><nav>n</nav><div><h1>h</h1><p>a</p></div><footer>f</footer></form></body>') == "h\n\na"
    assert read("<form><article><p>a</p><form><p>mail</p></form></article></form>") == "a"
    assert read("<p>a</p><form><p>search</p></form>") == read("<article><p>a</p></article><form><p>search</p></form>") == "a"
    # A teaser is not the page's text, and several articles are.
    body = "".join(f"<p>Paragraph {k} of a long report.</p>" for k in range(9))
    assert read(f"<div>{body}</div><article><p>Next week</p></article>") == "\n\n".join(f"Paragraph {k} of a long report." for k in range(9)) + "\n\nNext week"
    assert read(f"<article>{body[:60]}</article><article><p>two</p></article><p>x</p>").endswith("\n\ntwo")
    assert read('<article> </article><div class="ad">Buy</div>') == ""
    # End tags that may be left out.
    assert read("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert read("<dl><dt>a<dd>b<dt>c</dl><table><tr><td>1<td>2<tr><th>3<tbody><tr><td>4</table>z") == "a\n\nb\n\nc\n\n1\n\n2\n\n3\n\n4\n\nz"


def test_template_alone_decides(spark):
    """No marked article, no telling names: menus, notices and sidebars go because they recur, whatever stands between them, nested deep or cut short."""
    def page(k):
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in ("Start", "Archive", "Contact"))
        own = "".join(f"<p>Sentence {k * 31 + j} is told once, here.</p>" for j in range(k % 4 + 1))
        side = f"<div><b>Hot now</b><ul><li>Story of the week<li>Top ten</ul></div>" if k % 3 else ""
        return f"<div id=p{k}><div><ul>{menu}</ul></div><div><div><h2>Title {k}</h2>{own}</div>{side}</div><div><p>We use many cookies<p>Terms apply</div></div>"

    rows = [(k, f"https://plain.example.org/{k}", page(k)) for k in range(40)] + [(k + 40, f"https://plain.example.org/{k}", page(k)) for k in range(5)]
    rows += [(100, "https://plain.example.org/odd", "<div><h2>Not here</h2></div>"), (100, None, page(3))]
    got = [(r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    want = {k: "\n\n".join([f"Title {k}", *(f"Sentence {k * 31 + j} is told once, here." for j in range(k % 4 + 1))]) for k in range(40)}
    alone = ["Start", "Archive", "Contact", "Title 3", *(f"Sentence {93 + j} is told once, here." for j in range(4)), "We use many cookies", "Terms apply"]
    assert sorted(got) == sorted([*want.items(), *((k + 40, want[k]) for k in range(5)), (100, "Not here"), (100, "\n\n".join(alone))])


def test_columns_carried_along_and_long_pages(spark):
    page = "<article>" + "".join(f"<p>word {k} &amp; more</p>" for k in range(100_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://x.example.org/", page, "u"), (1, "http://x.example.org/", page, None)], "page_id bigint, url string, html string, text string")
    got = extract(df, keep=["text"])
    assert got.columns == ["page_id", "url", "text", "n_chars", "text"]
    rows = got.toDF("page_id", "url", "text", "n_chars", "kept").collect()
    assert {r.kept for r in rows} == {"u", None} and all(r.text == "\n\n".join(f"word {k} & more" for k in range(100_000)) for r in rows)
