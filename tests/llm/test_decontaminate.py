import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.llm import decontaminate
from lumensift.llm.decontaminate import RADIUS, blocks, clean, fingerprint, leaks, simhash, variants


def shingles(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for i, t in items:
            q = re.findall(r"[^\W_]+", (t or "").lower())
            if not q:
                continue
            k = min(5, len(q))
            want = Counter(shingles(q, k))
            for s in range(len(w) - len(q) + 1):
                have = Counter(shingles(w[s : s + len(q)], k))
                same = sum((want & have).values())
                sim = same / (sum(want.values()) + sum(have.values()) - same)
                if sim >= 0.8 and sim > out.get((d, i), (0,))[0]:
                    out[d, i] = (round(sim, 6), s)
    return out


def make(seed=11):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "délta", "e9", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "s", "ed", "ing"])
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 45))) + ".") for i in range(12)] + [(50, "tiny item"), (51, ""), (52, None), (53, "Echo echo echo echo echo echo echo echo")]
    docs = []
    for d in range(70):
        w = [word() for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            q = items[d % 12][1].upper().split(" ")
            for _ in range(rng.randint(0, 2)):
                q[rng.randrange(len(q))] = word() + "x"
            w[len(w) // 2 : len(w) // 2] = q
        docs.append((d, ", ".join(w)))
    return docs + [(100, None), (101, ""), (102, "a TINY  item!"), (103, "echo " * 30), (104, items[3][1]), (104, items[3][1]), (105, "w " * 30_000 + items[4][1])], items


def frames(spark, docs, items):
    d = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sh", T.StringType()), T.StructField("n", T.StringType())])
    return spark.createDataFrame([(*x, "u", None) for x in docs], d), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark, monkeypatch):
    docs, items = make()
    a, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 12
    for inline in (60_000, 0):
        monkeypatch.setattr(decontaminate, "INLINE_SHINGLES", inline)
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in leaks(a, b).collect()}
        # Equally similar windows that don't start with a shingle of the benchmark aren't laid: the place may come later, never the similarity.
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] >= want[k][1] for k in want)
    assert leaks(a.limit(0), b).count() == 0 and leaks(a, b.limit(0)).count() == 0
    left = {r.doc_id for r in clean(a, b).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_most_similar_window_between_two_edits(spark, monkeypatch):
    """First and last word changed, two words put in: no shingle of the best window stands where the item has it, counted from its start."""
    w = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(["x", *w[1:30], "in", "in2", *w[30:59], "y", "z"])), (2, " ".join([*w[4:30], "in", *w[30:]])), (3, " ".join(["a", *w[:20], "b", *w[20:40], "c", *w[40:]]))]
    a, b = frames(spark, docs, [(7, " ".join(w)), (8, " ".join(w[:30])), (9, " ".join(w[10:40]))])
    want = brute(docs, [(7, " ".join(w)), (8, " ".join(w[:30])), (9, " ".join(w[10:40]))])
    assert (1, 7) in want and want[1, 7][1] == 1
    for inline in (60_000, 0):
        monkeypatch.setattr(decontaminate, "INLINE_SHINGLES", inline)
        assert {(r.doc_id, r.item_id): r.similarity for r in leaks(a, b).collect()} == {k: v[0] for k, v in want.items()}


def test_simhash_and_blocks(spark):
    rng = random.Random(12)
    rows = [([rng.getrandbits(63) - rng.getrandbits(63) for _ in range(rng.randint(0, 9))],) for _ in range(50)]
    for r in spark.createDataFrame(rows, "sh array<bigint>").select("sh", simhash(F.col("sh")).alias("fp"), fingerprint(F.col("sh")).alias("f"), blocks(fingerprint(F.col("sh"))).alias("b")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum((h & (2**64 - 1)) >> b & 1 for h in r.sh) > len(r.sh))
        assert r.fp & (2**64 - 1) == want and len(r.f) == 3 and (len(set(r.f)) == 3 or not r.sh)
        assert [sum(r.b[3 * k + j] << 21 * j for j in range(3)) for k in range(3)] == [x & (2**63 - 1) for x in r.f]


def test_recall_of_the_blocks(spark):
    """All pairs within RADIUS meet, of those at similarity 0.8 nearly all, and of unlike ones few."""
    rng = random.Random(13)
    base = [rng.getrandbits(63) for _ in range(60)]
    far = [[rng.getrandbits(63) for _ in range(60)] for _ in range(400)]
    near = [base[:53] + [rng.getrandbits(63) for _ in range(7)] for _ in range(400)]  # 53 of 67: 0.79
    rows = [(k, 60, sh) for k, sh in enumerate([*near, *far])]
    windows = spark.createDataFrame(rows, "window bigint, n int, sh array<bigint>").withColumn("fp", fingerprint(F.col("sh"))).persist()
    item = spark.createDataFrame([(0, 60, base)], "item bigint, n int, sh array<bigint>").withColumn("fp", fingerprint(F.col("sh")))
    met = {r.window for r in variants(windows, 1, "window").join(variants(item, 2, "item"), "key").select("window").distinct().collect()}
    (own,) = item.collect()
    apart = {r.window: sum(bin((x ^ y) & (2**63 - 1)).count("1") for x, y in zip(r.fp, own.fp, strict=True)) for r in windows.collect()}
    assert RADIUS == 35 and all(w in met for w, d in apart.items() if d <= RADIUS)
    assert sum(w < 400 for w in met) >= 398 and sum(w >= 400 for w in met) < 20
    windows.unpersist()


def test_larger_benchmarks_are_shuffled(spark, monkeypatch):
    docs, items = make(14)
    a, b = frames(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert {(r.doc_id, r.item_id): r.similarity for r in leaks(a, b).collect()} == {k: v[0] for k, v in brute(docs, items).items()}


def test_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    a, b = frames(spark, [(None, text), (None, "x " + text), (None, "clean"), (1, text)], [(None, text), (2, text)])
    assert sorted((tuple(r)[:4] for r in leaks(a, b).collect()), key=str) == sorted([(d, i, 1.0, 0) for d in (None, 1) for i in (None, 2)], key=str)
    assert [r.text for r in clean(a, b).collect()] == ["clean"]


def test_documents_shorter_than_an_item(spark, monkeypatch):
    """A document that is an item without its first or last words is compared as a whole."""
    w = [f"w{k}" for k in range(50)]
    docs = [(1, " ".join(w[:49])), (2, " ".join(w[1:])), (3, " ".join(w[3:46])), (4, " ".join(w[:37])), (5, " ".join(["x", *w[2:47]])), (6, " ".join(w[:2])), (7, " ".join(w))]
    items = [(7, " ".join(w)), (8, "tiny item here now"), (9, " ".join(w[:20])), (10, " ".join([*w[:45], "y"]))]
    want = {}
    for d, text in docs:
        for i, t in items:
            q, v = t.split(), text.split()
            k = min(5, len(q))
            for s in range(max(1, len(v) - len(q) + 1)):
                a, b = Counter(shingles(q, k)), Counter(shingles(v[s : s + len(q)], k))
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), round(sim, 6))
    assert want[1, 7] == round(45 / 46, 6) and {(2, 7), (3, 7)} <= set(want) and (4, 7) not in want
    a, b = frames(spark, docs, items)
    for inline in (60_000, 0):
        monkeypatch.setattr(decontaminate, "INLINE_SHINGLES", inline)
        got = leaks(a, b).collect()
        assert {(r.doc_id, r.item_id): r.similarity for r in got} == want and len(got) == len(want)
        assert all(r.start_word == 0 for r in got if (r.doc_id, r.item_id) == (1, 7))
