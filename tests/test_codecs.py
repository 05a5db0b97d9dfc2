import random

import pytest
from pyspark.sql import functions as F

from lumensift.operators import codecs
from lumensift.operators.index import build_index

LISTS = [[], [0], [10, 15, 21], [0, 1, 127, 128, 16384], [0, 1, 3, 7, 15, 31, 2**31 - 1], [1, 2, 5, 100, 101, 10000], list(range(300)), [7] * 129]
#: Payload bytes of the 10,000 x 80 corpus below, as published for the eight codecs.
PUBLISHED = {
    "none": 8209548, "delta": 8209548, "varbyte": 2676901, "delta-varbyte": 2084521, "bitpacking": 1938169, "delta-bitpacking": 1369746, "pfor": 2294914, "delta-pfor": 1643321,
}


@pytest.mark.parametrize("method", codecs.METHODS)
def test_round_trips(method):
    rng = random.Random(30)
    for values in [*LISTS, [1, 1, 2, 1, 3, 2, 1, 1000000, 2, 1, 2, 3], *([rng.getrandbits(rng.randint(1, 31)) for _ in range(rng.randint(1, 400))] for _ in range(50))]:
        assert codecs.decode(codecs.encode(values, method), method) == values


@pytest.mark.parametrize("mode", codecs.MODES)
def test_modes(mode):
    for values in LISTS:
        assert codecs.decode_mode(codecs.encode_mode(values, mode), mode) == values
    tfs = [3, 1, 7, 2, 2, 9]
    assert codecs.decode_mode(codecs.encode_mode(tfs, mode, False), mode, False) == tfs
    assert codecs.mode_of(mode.upper()) == codecs.mode_of(mode)


def test_bits(spark):
    values = [0, *(v for k in range(63) for v in (2**k - 1, 2**k, 2**k + 1)), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert {r.v: r.b for r in df.select("v", codecs.bits(F.col("v")).alias("b")).collect()} == {v: max(1, v.bit_length()) for v in values}


def test_errors():
    for bad in (lambda: codecs.mode_of("zip"), lambda: codecs.gaps([2, 1]), lambda: codecs.encode([-1], "varbyte"), lambda: codecs.encode([-1], "pfor"), lambda: codecs.encode([1], "zip")):
        with pytest.raises(ValueError):
            bad()


def test_report_counts_the_bytes_that_the_encoders_write(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choice(["a", "a", "a", "b", "c", f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    ix = build_index(spark.createDataFrame([(i * 7, str(i), t) for i, t in enumerate(texts)], "doc_id bigint, external_id string, text string"))
    want = dict.fromkeys(codecs.MODES, 0)
    lists = {}
    for r in sorted(ix.postings.collect(), key=lambda r: r.doc_id):
        lists.setdefault(r.term, []).append(r)
    for rows in lists.values():
        ids, tfs = [r.doc_id for r in rows], [r.tf for r in rows]
        for m in codecs.MODES:
            method, delta = codecs.mode_of(m)
            places = [p for r in rows for p in (codecs.gaps(r.positions) if delta else r.positions)]
            want[m] += len(codecs.encode_mode(ids, m)) + len(codecs.encode(tfs, method)) + len(codecs.encode(places, method))
    raw = 4 * sum(2 + r.tf for rows in lists.values() for r in rows)
    assert {r.mode: (r.raw_bytes, r.compressed_bytes) for r in codecs.size_report(ix).collect()} == {m: (raw, n) for m, n in want.items()}


def test_published_sizes(spark):
    """d from 1, p in 0..79: common at every fifth place, else medium at every seventeenth, else one of 4096 terms."""
    docs = spark.sql("""
        select id doc_id, cast(id as string) external_id, array_join(transform(sequence(0L, 79L),
            p -> case when p % 5 = 0 then 'common' when p % 17 = 0 then concat('medium', id % 32) else concat('term', (id * 31 + p * 17) % 4096) end), ' ') text from range(1, 10001)""")
    got = {r.mode: r.compressed_bytes for r in codecs.size_report(build_index(docs)).collect()}
    assert got == PUBLISHED


def test_sample_and_skips(spark):
    ix = build_index(spark.createDataFrame([(i, str(i), "a b a") for i in range(3, 30, 3)], "doc_id bigint, external_id string, text string"))
    rows = codecs.sample(ix, 4).collect()
    assert [tuple(r) for r in rows] == [("a", 9, d, 3, 2, "0,2") for d in (3, 6, 9, 12)]
    assert sorted(map(tuple, codecs.skip_table(ix).collect())) == [("a", 9, 3, 2), ("b", 9, 3, 2)]
