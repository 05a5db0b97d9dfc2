"""How large the index would be under eight integer codecs: a report in DataFrame operations, and byte codecs for round trips."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.operators.index import Index
from lumensift.workspace import once

METHODS = ("none", "varbyte", "bitpacking", "pfor")
MODES = ("none", "delta", "varbyte", "delta-varbyte", "bitpacking", "delta-bitpacking", "pfor", "delta-pfor")
BLOCK = 128


def mode_of(name: str) -> tuple[str, bool]:
    """(method, gaps?) of a mode's name, in any case."""
    low = name.lower()
    if low not in MODES:
        raise ValueError(f"unknown compression mode {name}")
    return (low.removeprefix("delta-") if low != "delta" else "none"), low.startswith("delta")


def bits(v: Column) -> Column:
    """Bits of a non-negative integer, 1 for 0. The logarithm may be one off near a power of two: what is left above its place tells."""
    n = F.greatest(v.cast("bigint"), F.lit(1).cast("bigint"))
    e = F.floor(F.log2(n)).cast("int")
    return (e + F.least(F.call_function("shiftright", n, e), F.lit(2).cast("bigint"))).cast("int")


def streams(index: Index, span: int = 1 << 16) -> DataFrame:
    """term, stream (docs, tfs, positions), i (place in the term's stream), v and gap (v less the one before; gaps of positions restart at each posting, tfs have none).

    Postings are numbered by (term, span of doc_ids): a task orders no more than `span` of them at a time, and what comes
    before is added from sums, of which a term has one for each span.
    """
    spans = F.floor(F.col("doc_id") / span).alias("span")
    in_term, in_span = Window.partitionBy("term").orderBy("span"), Window.partitionBy("term", "span").orderBy("doc_id")
    sums = index.postings.groupBy("term", spans).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tfs"), F.max("doc_id").alias("last"))
    heads = sums.select(
        "term", "span", (F.sum("n").over(in_term) - F.col("n")).alias("i0"), (F.sum("tfs").over(in_term) - F.col("tfs")).alias("first0"), F.lag("last", 1, 0).over(in_term).alias("before0")
    )
    inside = index.postings.select("term", "doc_id", "tf", "positions", spans).select(
        "*", (F.row_number().over(in_span) - 1).alias("i1"), F.lag("doc_id").over(in_span).alias("before1"), (F.sum("tf").over(in_span) - F.col("tf")).alias("first1")
    )
    rows = inside.join(heads, ["term", "span"]).select(
        "term", "doc_id", "tf", "positions", (F.col("i0") + F.col("i1")).alias("i"), F.coalesce("before1", "before0").alias("before"), (F.col("first0") + F.col("first1")).alias("first")
    )
    gaps = F.transform("positions", lambda x, k: F.struct(x.cast("bigint").alias("v"), (x - F.when(k == 0, 0).otherwise(F.get("positions", k - 1))).cast("bigint").alias("gap")))
    own = lambda stream, i, v, gap: F.struct(F.lit(stream).alias("stream"), i.alias("i"), v.alias("v"), gap.alias("gap"))
    tf = F.col("tf").cast("bigint")
    two = F.array(own("docs", F.col("i"), F.col("doc_id"), F.col("doc_id") - F.col("before")), own("tfs", F.col("i"), tf, tf))
    places = F.transform(gaps, lambda p, k: own("positions", F.col("first") + k, p["v"], p["gap"]))
    return rows.select("term", F.explode(F.concat(two, places)).alias("x")).select("term", "x.*")


#: Counts of up to BLOCK values by their bits are kept as bytes, seven to a long.
_PER_LONG, _WIDEST = 7, 63


def _by_width(width: Column) -> list[Column]:
    at = width - 1
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (8 * (at % _PER_LONG)).cast("int"))
    return [F.sum(F.when(F.floor(at / _PER_LONG) == j, one).otherwise(F.lit(0).cast("bigint"))) for j in range(_WIDEST // _PER_LONG)]


def _percentile(counts: list[Column], need: Column, widest: Column) -> Column:
    """(w, s): the least width up to which s >= need values reach; none is wider than widest."""
    packed = F.array(*counts)
    count = lambda at: F.call_function("shiftright", F.get(packed, F.floor(at / _PER_LONG).cast("int")), (8 * (at % _PER_LONG)).cast("int")).bitwiseAND(F.lit(255))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("s"))
    return F.aggregate(F.sequence(F.lit(0), widest - 1), start, lambda a, at: F.when(a["s"] >= need, a).otherwise(F.struct((at + 1).alias("w"), (a["s"] + count(at)).alias("s"))))


def size_report(index: Index) -> DataFrame:
    """mode, raw_bytes, compressed_bytes, ratio for the eight modes.

    A term's stream is summed by blocks of 128 values first, so no task holds a posting list; pfor's width of a block is
    the 90th percentile of its values' bits.
    """
    of = {"p": F.col("v"), "d": F.col("gap")}
    width = {x: bits(v) for x, v in of.items()}
    blocks = streams(index).groupBy("term", "stream", F.floor(F.col("i") / BLOCK).alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.greatest(F.lit(1), F.ceil(w / 7))).alias(f"vb_{x}") for x, w in width.items()),
        *(F.max(w).alias(f"w_{x}") for x, w in width.items()),
        *(c.alias(f"c_{x}{j}") for x, w in width.items() for j, c in enumerate(_by_width(w))),
    )
    for x in of:
        counts = [F.col(f"c_{x}{j}") for j in range(_WIDEST // _PER_LONG)]
        blocks = once(blocks, f"q_{x}", _percentile(counts, F.ceil(F.col("n") * 0.9), F.col(f"w_{x}")))
        blocks = blocks.withColumn(f"pf_{x}", 9 + F.ceil(F.col("n") * F.col(f"q_{x}.w") / 8) + 6 * (F.col("n") - F.col(f"q_{x}.s")))
    lists = blocks.groupBy("term", "stream").agg(
        F.sum("n").alias("n"), *(F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in ("vb", "pf") for x in of), *(F.max(f"w_{x}").alias(f"w_{x}") for x in of)
    )
    n = F.col("n")
    varbyte_n = F.greatest(F.lit(1), F.ceil(bits(n) / 7))
    size = {"none": lambda x: 4 + 4 * n, "varbyte": lambda x: varbyte_n + F.col(f"vb_{x}"), "bitpacking": lambda x: 5 + F.ceil(n * F.col(f"w_{x}") / 8), "pfor": lambda x: 4 + F.col(f"pf_{x}")}
    sums = lists.agg(F.coalesce(F.sum(4 * n), F.lit(0)).alias("raw"), *(F.coalesce(F.sum(size[mode_of(m)[0]]("d" if mode_of(m)[1] else "p")), F.lit(0)).alias(m) for m in MODES))
    rows = sums.select("raw", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"`{m}`").cast("bigint").alias("bytes")) for m in MODES))).alias("m"))
    ratio = F.when(F.col("m.bytes") > 0, F.round(F.col("raw") / F.col("m.bytes"), 3)).otherwise(0.0)
    return rows.select("m.mode", F.col("raw").cast("bigint").alias("raw_bytes"), F.col("m.bytes").alias("compressed_bytes"), ratio.alias("ratio"))


def sample(index: Index, limit: int = 16) -> DataFrame:
    """The first postings of the term in most documents (the first of equal ones): term, df, doc_id, gap, tf, and its first positions joined by commas."""
    longest = index.dictionary.orderBy(F.desc("df"), "term").limit(1).select("term", "df")
    rows = index.postings.join(F.broadcast(longest), "term").orderBy("doc_id").limit(limit)
    w = Window.orderBy("doc_id")  # over at most `limit` rows
    return rows.select(
        "term", F.col("df").cast("bigint").alias("df"), "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(w)).alias("gap"), F.col("tf").cast("bigint").alias("tf"),
        F.array_join(F.slice("positions", 1, limit).cast("array<string>"), ",").alias("positions"),
    )


def skip_table(index: Index) -> DataFrame:
    """term, df, step and skips that a skip table would have: steps of the root of df, for lists of four postings or more."""
    step = F.floor(F.sqrt("df")).cast("bigint")
    return index.dictionary.filter("df >= 4").select("term", F.col("df").cast("bigint").alias("df"), step.alias("step"), F.floor((F.col("df") - 1) / step).cast("bigint").alias("skips"))


# Byte codecs, for round trips on the driver.


def gaps(values: list[int]) -> list[int]:
    if any(b < a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("values must not decrease")
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def ungaps(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += v
        out.append(at)
    return out


def _varbyte(v: int) -> bytes:
    if v < 0:
        raise ValueError("values must not be negative")
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _width(v: int) -> int:
    if v < 0:
        raise ValueError("values must not be negative")
    return max(1, v.bit_length())


def _packed(values: list[int], width: int) -> bytes:
    total = sum(v << k * width for k, v in enumerate(values))
    return total.to_bytes((len(values) * width + 7) // 8, "little")


def _unpacked(data: bytes, n: int, width: int) -> list[int]:
    total, mask = int.from_bytes(data, "little"), (1 << width) - 1
    return [total >> k * width & mask for k in range(n)]


def encode(values: list[int], method: str) -> bytes:
    """The bytes of non-negative 31-bit integers."""
    n = len(values)
    if method == "none":
        return struct.pack(f">i{n}i", n, *values)
    if method == "varbyte":
        return b"".join(map(_varbyte, [n, *values]))
    if method == "bitpacking":
        width = max(map(_width, values), default=1)
        return struct.pack(">iB", n, width) + _packed(values, width)
    if method == "pfor":
        out = [struct.pack(">i", n)]
        for a in range(0, n, BLOCK):
            block = values[a : a + BLOCK]
            width = sorted(map(_width, block))[-(-9 * len(block) // 10) - 1]
            odd = [(k, v) for k, v in enumerate(block) if _width(v) > width]
            body = _packed([0 if _width(v) > width else v for v in block], width)
            out += [struct.pack(">HBi", len(block), width, len(body)), body, struct.pack(">H", len(odd)), *(struct.pack(">Hi", k, v) for k, v in odd)]
        return b"".join(out)
    raise ValueError(f"unknown method {method}")


def decode(data: bytes, method: str) -> list[int]:
    if method == "none":
        return list(struct.unpack_from(f">{struct.unpack_from('>i', data)[0]}i", data, 4))
    if method == "varbyte":
        out, v, shift = [], 0, 0
        for b in data:
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                out.append(v)
                v = shift = 0
        return out[1:]
    n = struct.unpack_from(">i", data)[0]
    if method == "bitpacking":
        return _unpacked(data[5:], n, data[4])
    if method == "pfor":
        out, at = [], 4
        while len(out) < n:
            count, width, size = struct.unpack_from(">HBi", data, at)
            block = _unpacked(data[at + 7 : at + 7 + size], count, width)
            at += 7 + size
            odd = struct.unpack_from(">H", data, at)[0]
            for k in range(odd):
                place, v = struct.unpack_from(">Hi", data, at + 2 + 6 * k)
                block[place] = v
            at += 2 + 6 * odd
            out += block
        return out
    raise ValueError(f"unknown method {method}")


def encode_mode(values: list[int], mode: str, sorted_values: bool = True) -> bytes:
    """Sorted values (document ids, a posting's positions) go as gaps in a delta mode; others never do."""
    method, delta = mode_of(mode)
    return encode(gaps(values) if delta and sorted_values else values, method)


def decode_mode(data: bytes, mode: str, sorted_values: bool = True) -> list[int]:
    method, delta = mode_of(mode)
    values = decode(data, method)
    return ungaps(values) if delta and sorted_values else values
