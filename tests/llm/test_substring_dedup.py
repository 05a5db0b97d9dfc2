import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from lumensift.llm import substring_dedup
from lumensift.llm.fm_index import FMIndex, WaveletMatrix, matching_first
from lumensift.llm.substring_dedup import dedup_substrings
from lumensift.llm.windows import minimizers, split, words_of


def brute(docs, n=13):
    w = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (i, t) in enumerate(docs)}
    first = {}
    for k, (i, _) in enumerate(docs):
        for a in range(len(w[k]) - n + 1) if i is not None else ():
            g = tuple(w[k][a : a + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for k, (i, _) in enumerate(docs):
        gone = set()
        for a in range(len(w[k]) - n + 1) if i is not None else ():
            if first[tuple(w[k][a : a + n])] < i:
                gone.update(range(a, a + n))
        kept = [x for j, x in enumerate(w[k]) if j not in gone]
        out.append((i, len(w[k]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_wavelet_matrix_and_search():
    rng = np.random.default_rng(1)
    for sigma in (1, 2, 3, 9, 64):
        s = rng.integers(0, sigma, 200)
        m = WaveletMatrix(s, sigma)
        i, c = rng.integers(0, 201, 300), rng.integers(0, sigma, 300)
        assert m.rank(c, i).tolist() == [int((s[:a] == b).sum()) for a, b in zip(i, c, strict=True)]
    s = np.concatenate([rng.integers(1, 4, 300), [0]])
    low, high = FMIndex(s, 4).search(p := rng.integers(1, 4, (200, 5)))
    assert (high - low).tolist() == [sum((s[a : a + 5] == q).all() for a in range(297)) for q in p]


def test_first_owners_against_a_dictionary():
    rng = random.Random(40)
    for _ in range(40):
        seqs = [[rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(1, 12))]
        owners, k = np.array([rng.randint(0, 50) for _ in seqs]), rng.choice([1, 3, 5, 13])
        first = {}
        for s, o in zip(seqs, owners, strict=True):
            for i in range(len(s) - k + 1):
                first[tuple(s[i : i + k])] = min(first.get(tuple(s[i : i + k]), 99), o)
        for s, g in zip(seqs, matching_first(seqs, owners, k), strict=True):
            assert list(g) == [first[tuple(s[i : i + k])] for i in range(len(s) - k + 1)]


def test_words_and_minimizers():
    texts = ["a  bb\tccc\n", None, "", "\x0b", "é a\xa0b", "x" * 3000, "a bb ccc d e f g h"]
    w = words_of(texts)
    assert [[w.text(k, k + 1) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))] == [split(t) for t in texts]
    same = {}
    for k, h in enumerate(w.hashes):
        assert same.setdefault(w.text(k, k + 1), h) == h
    first, place, _ = minimizers(w, 7, 5)
    assert first.tolist() == [w.first[6], w.first[6] + 1] and all(f <= p <= f + 2 for f, p in zip(first, place, strict=True))
    assert w.text(0, 3) == b"a bb ccc"


def corpus():
    rng = random.Random(41)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{rng.randint(0, 300)}" for _ in range(3))])
    shared = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(8)]
    docs = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        docs.append((i * 3 % 151, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(1000 + i, docs[5][1]) for i in range(20)] + [(2000, None), (2001, ""), (2002, "short text"), (None, docs[5][1]), (2003, "ha " * 500), (2004, "ha " * 13), (2005, shared[0]), (2005, shared[0])]
    return docs + [(3000, " ".join(word() for _ in range(60_000)))]


@pytest.mark.parametrize("hot", [5_000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", 50)
    docs = corpus()
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("windows", T.StringType()), ("v", T.LongType()))])
    df = spark.createDataFrame([(i, t, "x", None) for i, t in docs], schema)
    got = sorted(map(tuple, dedup_substrings(df).collect()), key=str)
    want = brute(docs)
    assert sum(r[2] for r in want) > 500
    # Rows that repeat an id are one document: neither is earlier than the other.
    assert got == want


def test_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    assert dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{k}" for k in range(13))
    df = spark.createDataFrame([(1, text), (2, f"x {text} y"), (3, text.replace("w12", "z"))], schema)
    assert sorted(tuple(r) for r in dedup_substrings(df, with_text=True).select("doc_id", "n_removed", "kept_text").collect()) == [(1, 0, text), (2, 13, "x y"), (3, 0, text.replace("w12", "z"))]


@pytest.mark.parametrize("window", [1, 3, 40])
def test_other_windows(spark, window):
    docs = corpus()[:120]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, dedup_substrings(df, window=window).collect()), key=str) == brute(docs, window)


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    """Thue-Morse words and their complements agree in every polynomial hash modulo 2^64: only their letters tell them apart."""
    for n in (1024, 2048):
        plain = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
        other = plain.translate({97: "b", 98: "a"})
        same = " ".join(f"w{k}" for k in range(12))
        docs = [(1, f"{same} {plain}"), (2, f"{same} {other}"), (3, f"{same}  {plain}"), (4, f"{other} {same}"), (5, f"{plain} {same}")]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df).collect())
        assert got == brute(docs)
        assert [g[2] for g in got] == [0, 0, 13, 0, 0]
