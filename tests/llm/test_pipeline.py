"""run() against a plain version of its five stages, on the smallest tables with some planted rows."""

from collections import Counter, defaultdict

import duckdb
import pytest
from test_decontaminate import shingles
from test_langid import languages
from test_simhash import long_brute, long_components

import corpus_pipeline
from lumensift.llm import common
from lumensift.llm.mixing import mix_sql
from lumensift.llm.queries import TARGETS

SF = "/root/testdata/sf0.001"


def leaking(docs, items):
    import re

    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in items}
    by_first = defaultdict(set)
    for i, w in words.items():
        for s in set(shingles(w, 5)):
            by_first[s].add(i)
    out = set()
    for d, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for i in {i for s in shingles(w, 5) for i in by_first.get(s, ())}:
            want = Counter(shingles(words[i], 5))
            for a in range(len(w) - len(words[i]) + 1):
                have = Counter(shingles(w[a : a + len(words[i])], 5))
                same = sum((want & have).values())
                if same and same / (sum(want.values()) + sum(have.values()) - same) >= 0.8:
                    out.add(d)
                    break
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The driver's tables with more rows: nothing to identify, copies, a leak."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = base.filter("length(text) > 300").orderBy("doc_id").limit(3).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(9000, None, "en", "src1"), (9001, "", "de", "src2"), (9002, "123 456", "en", "src0"), (9003, "漢字仮名交じり文の例です。" * 5, "en", "src0")]
    rows += [(9010 + k, r.text.upper(), r.lang, r.source) for k, r in enumerate(some) if r.text.isascii()] + [(9020 + k, r.text, r.lang, r.source) for k, r in enumerate(some)]
    rows += [(9030, "The of and that in. " * 3 + item + " and the rest of it.", "en", "src3")]
    out = tmp_path_factory.mktemp("sf")
    extra = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    base.union(extra.select(*base.columns)).write.parquet(str(out / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]


def test_run_against_plain_stages(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {i: lang for i, lang, _, kept in languages([(r.doc_id, r.text, r.lang, r.source) for r in docs.values()]) if kept}
    assert set(docs) - set(found) == {9000, 9001, 9002, 9003}
    groups = defaultdict(list)
    for i in found:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in docs[i].text)].append(i)
    kept = {max(g) for g in groups.values()}
    assert {9020, 9021, 9022} <= kept
    components = long_components({i: long_brute(docs[i].text) for i in kept})
    kept = {i for i in kept if components[i] == i}
    leaks = leaking([(i, docs[i].text) for i in kept], [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert 9030 in leaks
    rows = [(i, docs[i].text, found[i], docs[i].source) for i in sorted(kept - leaks)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    want = con.sql(mix_sql(TARGETS))
    before = len(common._staged)
    got = corpus_pipeline.run(spark, folder)
    assert len(common._staged) == before + 1  # of all that the stages have staged, the result is left
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(str, want.fetchall())) and got.count() > 50


def test_each_stage_but_the_last_returns_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_with_null_and_repeated_ids(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    texts = [(None, "Same text here"), (7, "same text here"), (None, "only under null"), (None, "only under null"), (8, "twice the same row"), (8, "twice the same row"), (7, "own text of seven")]
    texts += [(None, item), (9, item + " again"), (9, "clean text of nine")]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts], spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)
    rest = [(7, "own text of seven"), (7, "same text here"), (8, "twice the same row"), (9, "clean text of nine"), (9, item + " again"), (None, item), (None, "only under null")]
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_dedup_stage(spark, df, folder).collect()), key=str) == sorted(rest, key=str)
    # Without its last word the item is a near copy, and of the two the one with an id stays.
    near = [r for r in rest if r != (None, item)]
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, df, folder).collect()), key=str) == sorted(near, key=str)
    left = [(i, t) for i, t in texts if item not in t]
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, df, folder).collect()), key=str) == sorted(left, key=str)
