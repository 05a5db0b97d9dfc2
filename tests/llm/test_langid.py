import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.llm import langid, queries
from lumensift.llm.html_extract import blocks, main_text

WORDS = {
    "en": "the of and to in is that was for with this from have which their there".split(),
    "de": "der die das und nicht eine ist auf für über sich werden können schön".split(),
    "fr": "le la les des une est dans pour que être avec où déjà français".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_trigrams_against_a_loop():
    texts = ["aB1c!", "", None, "a", "Üb", "x" * 50]
    found, starts = langid.trigrams(texts)
    want, at = [], [0]
    for t in texts:
        b = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (t or "").encode().lower()) + b" "
        g = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2)]
        want += g
        at.append(at[-1] + len(g))
    assert found.tolist() == want and starts.tolist() == at and found.max() < langid.BUCKETS


def corpus(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, text(rng, lang, rng.randint(5, 60)), lang, f"h{list(WORDS).index(lang)}", "x", "y"))
    schema = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "lang", "source", "host", "prob")])
    return spark.createDataFrame(rows, schema), schema


def test_held_out_accuracy_and_odd_rows(spark):
    df, schema = corpus(spark)
    model = langid.train(df.filter("doc_id < 200"), "text", "lang", "doc_id")
    assert model.languages == ("de", "en", "fr")
    odd = [(1000, None, "en", "h1", None, None), (1001, "", None, None, None, None), (None, "the of and that was", None, None, None, None), (1002, "12 34 !!", "de", "h0", None, None), (1003, "日本語の文章です。これは何語でしょうか。", "en", "h1", None, None)]
    odd += [(1004, text(random.Random(1), "fr", 30_000), "en", "h1", None, None)]
    test = df.filter("doc_id >= 200").union(spark.createDataFrame(odd, schema)).union(df.filter("doc_id = 200"))
    got = langid.identify(test, model, host=F.col("source"), declared=F.col("lang")).collect()
    truth = {r.doc_id: r.lang for r in df.collect()}
    plain = [r for r in got if r.doc_id in truth]
    assert len(plain) == 201 and all(r.lang == truth[r.doc_id] == r.text_lang and r.kept for r in plain)
    by = {r.doc_id: r for r in got}
    assert not any(by[k].kept for k in (1000, 1001, 1002, 1003)) and by[None].kept and by[None].lang == "en"
    assert by[1004].lang == "fr" and by[1004].kept
    assert langid.identify(df.limit(0), model).count() == 0


def test_short_text_is_decided_by_the_other_evidence(spark):
    df, schema = corpus(spark)
    model = langid.train(df, "text", "lang", "doc_id")
    short = [(1, "xq", "de", "h1", None, None), (2, "xq", None, "h2", None, None)]
    # A host of 100 French texts outweighs a text that says nothing.
    rows = df.union(spark.createDataFrame(short, schema))
    by = {r.doc_id: r for r in langid.identify(rows.filter("doc_id > 2 or text = 'xq'"), model, host=F.col("source"), declared=F.when(F.col("text") == "xq", F.col("lang"))).collect()}
    assert by[2].lang == "fr"


def test_priors_against_a_loop(spark):
    scored = spark.createDataFrame([("a.x.org", 0)] * 5 + [("b.x.org", 1)] * 3 + [("b.x.org", 0)] + [("src7", 1), ("src8", None)], "host string, best int")
    got = {r.host: r.prior for r in langid.host_priors(scored, ("p", "q"), 20.0).collect()}
    g = np.array([6, 4])
    top = (g + 1) / 12
    x = (np.array([6, 3]) + 20 * top) / (9 + 20)
    assert np.allclose(got["b.x.org"], (np.array([1, 3]) + 20 * x) / (4 + 20))
    s = (np.array([0, 1]) + 20 * top) / 21
    assert np.allclose(got["src8"], s)


def test_address_and_markup(spark):
    rows = [("https://a.example.org/de/1", "<html lang='FR-ca'>"), ("http://www.x.de:80/en", "<html class=a lang=es>"), ("http://x.fr", "<p lang=de>"), ("http://x.org/xx/", None), (None, "")]
    df = spark.createDataFrame(rows, "u string, h string").select(langid.suffix_language(F.col("u")), langid.declared_in_markup(F.col("h")))
    assert list(map(tuple, df.collect())) == [("de", "fr"), ("en", "es"), ("fr", None), (None, None), (None, None)]


def test_no_labelled_row_leaves_one_unknown_language(spark):
    df, _ = corpus(spark, 5)
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    for rows in (unlabelled, df.limit(0)):
        model = langid.train(rows, "text", "lang", "doc_id")
        assert model.languages == (langid.UNKNOWN,)
        assert [(r.lang, r.prob, r.kept) for r in langid.identify(rows, model, host=F.col("source"), declared=F.col("lang")).collect()] == [("und", 1.0, True)] * rows.count()


def test_rare_labels_do_not_take_foreign_text(spark):
    """Far more rows than are sampled; one label on a few rows, one on a single short row."""
    df, schema = corpus(spark, 3000)
    rare = "ja kaj estas la de en mi vi ne kiu por kun tio".split()
    rng = random.Random(9)
    rows = [(5000 + k, " ".join(rng.choice(rare) for _ in range(60)), "eo", "h9", None, None) for k in range(8)] + [(6000, "zz", "qq", "h9", None, None)]
    table = df.union(spark.createDataFrame(rows, schema))
    model = langid.train(table, "text", "lang", "doc_id", rows=300)
    assert model.languages == ("de", "en", "eo", "fr")
    foreign = [(7000 + k, "日本語の文章です。これは何語でしょうか。" * (k + 1), lang, "h9", None, None) for k, lang in enumerate(("eo", "qq", "en", None))]
    tests = table.filter("doc_id < 200 or doc_id between 5000 and 5999").union(spark.createDataFrame(foreign, schema))
    got = langid.identify(tests, model, host=F.col("source"), declared=F.col("lang")).collect()
    assert not any(r.kept for r in got if r.doc_id >= 7000) and all(r.kept for r in got if r.doc_id < 7000)
    assert all(r.text_lang == "eo" for r in got if 5000 <= r.doc_id < 6000)


def test_levels_and_shares_at_any_size(spark):
    counts = lambda *n: spark.createDataFrame([(str(k), x) for k, x in enumerate(n)], "label string, n bigint")
    assert langid._level(counts(5, 6), 100) == 100 and 80 <= langid._level(counts(5, 100, 1000), 205) <= 100 and 1.6 <= langid._level(counts(10, 10), 4) <= 2
    assert 8_000 < langid._level(counts(3 * 10**13, 4 * 10**15), 20_000) <= 10_000 and langid._level(counts(*[10**9] * 50), 20) == 1.0
    # The draw of train() at 10^4 of 10^16 rows: as many hashes lie below the limit as the share says.
    drawn = spark.range(1_000_000).select(F.xxhash64("id", F.lit(5)).alias("h")).filter(F.shiftrightunsigned("h", 1).cast("double") < F.lit(1e-3) * float(1 << 63))
    assert 800 < drawn.count() < 1200 and 1e-12 * float(1 << 63) > 9e6


def test_two_hundred_labels(spark):
    rng = random.Random(10)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03d}": ["".join(rng.choice(alphabet) for _ in range(6)) for _ in range(12)] for k in range(200)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 200:03d}"]) for _ in range(60)), f"l{i % 200:03d}", f"h{i % 7}") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.train(df, "text", "lang", "doc_id", rows=1600)
    assert len(model.languages) == 200
    got = langid.identify(df, model, host=F.col("source"), declared=F.lit(None).cast("string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == 1600 and all(r.lang == truth[r.doc_id] and r.kept for r in got)


def languages(train, rows=None):
    """id -> (language, probability, kept) for rows (id, text, declared, host, suffix language) under a model of train (the same rows, if none are given):

    byte trigrams of letters, host counts smoothed twice, what is declared and what the address says. All in plain loops.
    """

    def grams(text):
        b = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").encode().lower()) + b" "
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2)]

    rows = train if rows is None else rows
    seen = defaultdict(Counter)
    for _, t, lang, *_ in train:
        if lang and t is not None:
            seen[lang].update(grams(t))
    seen = {k: v for k, v in seen.items() if sum(v.values()) >= 1000}
    names = sorted(seen)
    every = Counter()
    for c in seen.values():
        every.update(c)
    base = sum(every.values()) + 0.05 * 32768
    common = [(every[g] + 0.05) / base for g in range(32768)]
    log_p = {n: [math.log((seen[n][g] + 0.05 * 32768 * common[g]) / (sum(seen[n].values()) + 0.05 * 32768)) for g in range(32768)] for n in names}
    own = {n: sum(math.exp(x) * x for x in log_p[n]) for n in names}
    of = [grams(t) for _, t, *_ in rows]
    ll = [[sum(log_p[n][g] for g in gs) for n in names] for gs in of]
    host, parent, corpus, where = defaultdict(Counter), defaultdict(Counter), Counter(), []
    for k, (_, _, _, source, *_) in enumerate(rows):
        h = source or ""
        where.append((h, ".".join(h.split(".")[-2:]) if "." in h else "".join(c for c in h if not c.isdigit())))
        if of[k]:
            best = ll[k].index(max(ll[k]))
            host[h][best] += 1
            parent[where[k][1]][best] += 1
            corpus[best] += 1
    out, n = [], len(names)
    for j, (i, t, lang, _, *rest) in enumerate(rows):
        h, p = where[j]
        top = [(corpus[k] + 1) / (sum(corpus.values()) + n) for k in range(n)]
        mid = [(parent[p][k] + 20 * top[k]) / (sum(parent[p].values()) + 20) for k in range(n)]
        prior = [(host[h][k] + 20 * mid[k]) / (sum(host[h].values()) + 20) for k in range(n)]
        says = lambda named, error: [(math.log(1 - error) if named == m else math.log(error / (n - 1))) if named in names else 0 for m in names]
        declared, suffix = says((lang or "").lower(), 0.05), says(rest[0] if rest else None, 0.2)
        lp = [ll[j][k] / 3 + math.log(prior[k]) + declared[k] + suffix[k] for k in range(n)]
        k = lp.index(max(lp))
        count = max(1, len(of[j]))
        usual = ll[j][k] / count >= own[names[k]] - 4 - 6 / math.sqrt(count)
        prob = 1 / sum(math.exp(x - lp[k]) for x in lp)
        out.append((i, names[k], prob, any(map(str.isalpha, t or "")) and usual and prob >= 0.5))
    return out


def agree(got, want):
    assert len(got) == len(want)
    for (i, lang, prob, kept), (j, lang2, prob2, kept2) in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert (i, lang, kept) == (j, lang2, kept2) and abs(prob - prob2) < 1e-4


def test_documents_and_pages_against_plain_loops(spark):
    """The registered queries on the smallest tables; each page's main text, markup, host and address as plain code reads them."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    result = lambda df, i: [(r[i], r.lang, r.prob, r.kept) for r in df.collect()]
    agree(result(queries.op5_language_id(spark, sf), "doc_id"), languages(docs))
    pages = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host = re.match(r"\w+://([^/:?#]*)", r.url)[1].lower()
        path, country = re.match(r"\w+://[^/]+/([a-z]{2})(?:/|$|\?|#)", r.url), host.rpartition(".")[2]
        suffix = path[1] if path and path[1] in langid.COUNTRIES else next((k for k, v in langid.COUNTRIES.items() if country in v.split()), None)
        declared = re.match(r'<!DOCTYPE html><html lang="(..)"', r.html)
        pages.append((r.page_id, main_text(blocks(r.html)), declared and declared[1], host, suffix))
    agree(result(queries.page_languages(spark, sf), "page_id"), languages(docs, pages))
