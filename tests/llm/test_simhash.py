import random

import xxhash
from pyspark.sql import types as T

from lumensift.llm.components import connected_components
from lumensift.llm.simhash import ball_links, bits_for, fingerprinter, keep_one, long_fingerprinter, near_duplicates, part_links, similar_groups


def brute_fp(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def docs(rng, n=120):
    base = [" ".join(rng.choice("alpha Beta gamma délta x eps zeta".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(25)]
    out = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(["eta", "Theta", "\n"])
        out.append((i, " ".join(t)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "ONE"), (n + 4, "one")]


def test_fingerprint():
    f = fingerprinter()
    for _, t in docs(random.Random(5)):
        assert f(t) & (2**64 - 1) == brute_fp(t)


def test_fingerprints_of_a_very_long_text():
    rng = random.Random(15)
    words = [f"w{rng.randint(0, 99)}" for _ in range(70_000)]
    counts, n = [0] * 64, len(words) - 2
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    assert fingerprinter()(" ".join(words)) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * counts[b] > n)


def test_near_duplicates_against_brute_force(spark):
    rows = docs(random.Random(6))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType())])
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], schema)
    want_fp = {i: brute_fp(t) for i, t in rows}
    want = brute_components(want_fp)
    got = near_duplicates(df).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want_fp[i]:016x}", want[i]) for i, _ in rows} and len(got) == len(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_ball_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for s in seeds for _ in range(30)} | {0, 2**64 - 1, 2**63}
    signed = {f: f - 2**64 if f >> 63 else f for f in fps}
    want = {signed[f] for f in fps}
    df = spark.createDataFrame([(s,) for s in want], "fp bigint")
    links = ball_links(df)
    got = {r.node: r.component for r in connected_components(links).collect()}
    groups = {}
    for k, v in brute_components({k: k for k in fps}).items():
        groups.setdefault(v, set()).add(signed[k])
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == c) for c in set(got.values())}


def test_long_chain_and_null_ids(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert {r.component for r in connected_components(links).collect()} == {0}
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "q r s t u v w"), (4, "q r s t u v w")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(df).collect()) == [("4", "4")] * 2 + [("None", "None")] * 2


def test_a_hub_and_its_spokes(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)] + [(5000, 5001)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {n: 5000 if n >= 5000 else 0 for n in (*range(300), *range(1001, 1300), 5000, 5001)}


def long_brute(text):
    """The fingerprint's bits by plain arithmetic, as one number."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []
    top, out = 2**64 - 1, 0
    for k in range(4):
        zs = []
        for s in sh:
            z = (xxhash.xxh64_intdigest(s.encode(), seed=42) + (k + 1) * 0x9E3779B97F4A7C15) & top
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & top
            z = (z ^ z >> 27) * 0x94D049BB133111EB & top
            zs.append(z ^ z >> 31)
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(z >> b & 1 for z in zs) > len(zs))
    return out


def long_components(fps, radius=38):
    """id -> smallest id reachable by pairs within the radius that share a 32-bit part up to two bits."""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            d = fps[i] ^ fps[j]
            if d.bit_count() <= radius and min((d >> 32 * k & 2**32 - 1).bit_count() for k in range(8)) <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def near_copies(rng, families=12, copies=12):
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for f in range(families):
        base = [word() for _ in range(rng.randint(30, 400))]
        for c in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 2 + len(t) // 120)):
                t[rng.randrange(len(t))] = word()
            out.append((f * 100 + c, " ".join(t)))
    return out


def test_long_fingerprint():
    f = long_fingerprinter()
    assert bits_for(0.8) == 38 and bits_for(1) == 0
    for _, t in [*docs(random.Random(5), 30), *near_copies(random.Random(6), 2, 2)]:
        assert sum((x & 2**64 - 1) << 64 * k for k, x in enumerate(f(t))) == long_brute(t)


def test_similar_groups_against_brute_force(spark):
    rows = near_copies(random.Random(9)) + [(9000, None), (9001, ""), (9002, "ONE"), (9003, "one")]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id bigint, text string, f string, node int")
    got = {r.doc_id: r.component_id for r in similar_groups(df).collect()}
    assert got == long_components({i: long_brute(t) for i, t in rows}) and len(set(got.values())) < 60
    assert similar_groups(df.limit(0)).count() == 0


def test_part_links_of_a_large_family(spark):
    """Every pair that meets is in the components, whether its members share a part or not; links stay far fewer than pairs."""
    rng = random.Random(10)
    seed = rng.getrandbits(256)
    fps = {i: seed ^ sum(1 << rng.randrange(256) for _ in range(rng.randint(0, 12))) for i in range(600)} | {1000 + i: rng.getrandbits(256) for i in range(50)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(f >> 64 * k & 2**64 - 1) for k in range(4)]) for i, f in fps.items()], "node bigint, f array<bigint>")
    links = part_links(df, 38).collect()
    assert len(links) < 700  # a family of 600 has 180 000 pairs
    parent = {r.node: r.component for r in connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a bigint, b bigint")).collect()}
    want = long_components(fps)
    assert {i: parent.get(i, i) for i in fps} == want


def far_within(rng, f, radius=38):
    """f with radius bits changed, no 32-bit part by fewer than four."""
    bits = [32 * k + b for k in range(8) for b in rng.sample(range(32), 4)]
    rest = [b for b in range(256) if b not in bits]
    return f ^ sum(1 << b for b in bits + rng.sample(rest, radius - len(bits)))


def components_of(spark, fps, radius=38):
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, [signed(f >> 64 * k & 2**64 - 1) for k in range(4)]) for i, f in fps.items()], "node bigint, f array<bigint>")
    parent = {r.node: r.component for r in connected_components(part_links(df, radius)).collect()}
    return {i: parent.get(i, i) for i in fps}


def within(fps, radius=38):
    """id -> smallest id reachable by pairs within the radius, by all pairs."""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_part_links_lose_no_pair_within_the_radius(spark):
    """Pairs at the radius whose differences lie all over the fingerprint, pairs one bit beyond it, and others within it at random."""
    rng = random.Random(11)
    fps = {}
    for i in range(0, 300, 3):
        fps[i] = rng.getrandbits(256)
        fps[i + 1], fps[i + 2] = far_within(rng, fps[i]), far_within(rng, fps[i], rng.choice((33, 39, 40)))
    want = within(fps)
    assert sum(want[i] == i - 1 for i in fps) >= 100 and components_of(spark, fps) == want
    assert components_of(spark, fps, 60) == within(fps, 60) != want


def test_part_links_of_texts_that_share_a_part(spark):
    """Unlike fingerprints share a part; each has one partner at the radius, which no other is near."""
    rng = random.Random(12)
    seeds = [rng.getrandbits(256) >> 64 << 64 | 0x123456789ABCDEF0 for _ in range(150)]
    fps = {2 * i: s for i, s in enumerate(seeds)} | {2 * i + 1: s ^ sum(1 << b for b in rng.sample(range(64, 256), 36)) ^ 0b11 for i, s in enumerate(seeds)}
    fps |= {1000 + i: seeds[0] ^ sum(1 << b for b in rng.sample(range(64, 256), rng.randint(0, 12))) for i in range(200)}
    want = within(fps)
    assert len({want[i] for i in range(300)}) == 150 and components_of(spark, fps) == want


def test_keep_one(spark):
    """One of each group stays, the smallest id; a null id is last; a text of fewer words than a shingle is one shingle."""
    df = spark.createDataFrame([(1, "a b c d"), (2, "A B C D"), (3, "a b c e"), (None, "a b c e"), (None, "z"), (None, "z")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.text) for r in keep_one(df).collect()) == [("1", "a b c d"), ("3", "a b c e"), ("None", "z")]
