"""SimHash near-deduplication by meet-in-the-middle ball hashing.

near_duplicates() links 64-bit fingerprints within a few bits, all of them. similar_groups() links texts by similarity: its
fingerprints are long and fall into so many parts that all within its radius meet in the balls of a part.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.llm.common import clean, lookup, one_of_each, only, only_staged, per_row, row_key, staged, without
from lumensift.llm.components import connected_components
from lumensift.llm.token_counts import _arrow


def fingerprinter(shingle: int = 3, seed: int = 42):
    """text -> 64-bit SimHash, as a signed integer.

    A-Z are lower-cased; words are runs without U+0020 and U+0009-U+000D; the hashes are XXH64 of the space-joined shingles,
    repeats included; with fewer words, of the whole sequence; without words the fingerprint is 0.
    """
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    block = 1 << 16

    def fingerprint(text: str | None) -> int:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return 0
        parts = list(zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [words]
        counts = np.zeros(64, dtype=np.int64)
        for a in range(0, len(parts), block):
            hashes = np.array([h(b" ".join(p), seed) for p in parts[a : a + block]], dtype="<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(weights[counts * 2 > len(parts)].sum(dtype=np.uint64).astype(np.int64))

    return fingerprint


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: __id, fp. A null text counts as empty."""
    id_type = df.schema[id_col].dataType
    schema = pa.schema([("i", _arrow(id_type)), ("f", pa.int64())])

    def make():
        f = fingerprinter(shingle)
        return lambda i, t: (i, f(t))

    return per_row(only(df, __id=id_col, __text=text_col), ["__id", "__text"], schema, f"__id {id_type.simpleString()}, fp bigint", make)


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints fps(fp) whose components are those of all pairs within radius bits.

    Every fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant, and
    two that share one are within the radius: so a variant's members, at most as many as a ball has points, need only be
    linked to the smallest of them. Every link is verified all the same.
    """
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("radius must be 0, 2, 4 or 6")
    masks = [0] + [sum(1 << b for b in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    emitted = fps.select("fp", F.explode(F.array(*(F.lit(m) for m in signed))).alias("mask"))
    w = Window.partitionBy("variant").orderBy("fp")
    met = emitted.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")).select(F.col("fp").alias("b"), F.first("fp").over(w).alias("a"))
    return met.filter("a <> b").distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links of at most
    `radius` differing bits, itself included).

    Copies share a fingerprint and are reduced to one before any link is sought. Null and empty texts have fingerprint
    zero and are linked like any other. Ids may repeat; rows with a null id join their component but never name it (a
    component of such rows only has a null component_id). Other columns play no part; an empty table gives an empty result.
    """
    docs = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = staged(docs.groupBy("fp").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")), "classes")
    out = _named(docs, classes, staged(ball_links(classes.select("fp"), radius), "links"), "fp")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(docs: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """docs(__id, key) with component_id, the smallest first_id of the classes(key, node, first_id, n) that links(a, b) of nodes connect.

    classes and links, both staged, are deleted.
    """

    def ids() -> DataFrame:
        named = connected_components(links).join(classes, "node").select("node", "component", "first_id")
        smallest = named.groupBy("component").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
        of_node = lookup(named.select("node", "component"), smallest, "component", "n", salt="node")
        return classes.join(of_node.select("node", "smallest"), "node", "left").select(key, "n", F.coalesce("smallest", "first_id").alias("component_id"))

    return lookup(docs, only_staged(ids, "ids", docs.sparkSession, classes, links), key, "n", salt="__id")


#: A long fingerprint is LONGS x 64 bits, read as at least so many parts, of at most 32 bits.
LONGS = 4
_FEWEST_PARTS = LONGS * 2


def long_fingerprinter(shingle: int = 5, seed: int = 42):
    """text -> LONGS signed integers: a SimHash of words as in fingerprinter(), each shingle's XXH64 stretched by a mixing function."""
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    steps = np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = 1 << 13

    def stretched(hashes):
        z = hashes[:, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def fingerprint(text: str | None) -> tuple[int, ...]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return (0,) * LONGS
        parts = list(zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [words]
        counts = np.zeros(64 * LONGS, dtype=np.int64)
        for a in range(0, len(parts), block):
            hashes = np.array([h(b" ".join(p), seed) for p in parts[a : a + block]], dtype="<u8")
            counts += np.unpackbits(stretched(hashes).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return tuple(np.packbits(counts * 2 > len(parts), bitorder="little").view("<i8").tolist())

    return fingerprint


def long_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per input row: __id, f (an array of LONGS longs)."""
    id_type = df.schema[id_col].dataType
    schema = pa.schema([("i", _arrow(id_type)), ("f", pa.list_(pa.int64()))])

    def make():
        f = long_fingerprinter(shingle)
        return lambda i, t: (i, f(t))

    return per_row(only(df, __id=id_col, __text=text_col), ["__id", "__text"], schema, f"__id {id_type.simpleString()}, f array<bigint>", make)


def bits_for(similarity: float) -> int:
    """The most bits in which the long fingerprints of two equally long texts of that Jaccard similarity are expected to differ."""
    cosine = 2 * similarity / (1 + similarity)
    return math.floor(64 * LONGS * math.acos(cosine) / math.pi)


#: Of a part's bits so many choose the tasks that see it; rows that a task of part_links() is meant for; runs over the parts.
_PREFIX, _TASK_ROWS, _RUNS = 8, 300_000, 3


def part_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, of the nodes of classes(node, f) whose components are those of all pairs within radius bits.

    With more than radius / 3 parts, two fingerprints within the radius have a part in which they differ in at most two bits:
    both reach a variant of it within one bit, so none is missed. A row is sent where the variants of a part's first bits
    lie, with the whole fingerprint, and varied in the other bits there. Those that share a variant are compared all with
    all, but for pairs that are in one component already: so a large family of copies needs few of its pairs. Each task
    returns its components' links to their smallest nodes.
    """
    count = max(_FEWEST_PARTS, radius // 3 + 1)
    edges = [64 * LONGS * k // count for k in range(count + 1)]
    cuts = list(zip(edges, edges[1:], strict=False))
    spark = classes.sparkSession
    words = [F.col("f")[k].alias(f"f{k}") for k in range(LONGS)]
    masks = [0, *(1 << b for b in range(_PREFIX))]
    rows, tasks = classes.count() * -(-count // _RUNS) * len(masks), int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    found = []
    for run in range(_RUNS):
        places = []
        for p, (start, end) in list(enumerate(cuts))[run::_RUNS]:
            first = _bits(end - _PREFIX, end)
            places += [first.bitwiseXOR(F.lit(m)) + (p << _PREFIX) for m in masks]
        sent = classes.select("node", *words, F.explode(F.array(*places)).alias("place")).repartition(max(tasks, -(-rows // _TASK_ROWS)), "place")
        found.append(staged(sent.mapInArrow(_task_links(cuts, radius, schema), "a bigint, b bigint").distinct(), "links"))
        clean(spark)
    return reduce(DataFrame.union, found).distinct()


def _bits(start: int, end: int) -> Column:
    """Bits start to end - 1 of the fingerprint f, as a long; at most 32."""
    k, low = divmod(start, 64)
    value = F.shiftrightunsigned(F.col("f")[k], low)
    if end > 64 * (k + 1):
        value = value.bitwiseOR(F.shiftleft(F.col("f")[k + 1], 64 - low))
    return value.bitwiseAND(F.lit((1 << end - start) - 1))


def _task_links(cuts: list[tuple[int, int]], radius: int, schema: pa.Schema):
    """Batches of (node, the fingerprint's words, place) -> the links of one task's rows."""

    def run(batches):
        import numpy as np

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        of_batches = lambda k: np.concatenate([b.column(k).to_numpy() for b in held])
        node, place = of_batches(0), of_batches(LONGS + 1)
        f = np.stack([of_batches(1 + k).view(np.uint64) for k in range(LONGS)], axis=1)
        del held
        nodes, number = np.unique(node, return_inverse=True)
        label = np.arange(len(nodes))
        by_place = np.argsort(place, kind="stable")
        ends = np.flatnonzero(np.diff(place[by_place])) + 1
        for rows in np.split(by_place, ends):
            start, end = cuts[int(place[rows[0]]) >> _PREFIX]
            x, y = _near(f[rows], start, end, int(place[rows[0]]) & (1 << _PREFIX) - 1, radius)
            if len(x):
                label = _joined(label, number[rows[x]], number[rows[y]])
        b = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[b]]), pa.array(nodes[b])], schema=schema)

    return run


def _joined(label, a, b):
    """Each node's smallest node, by the labels so far and the pairs (a, b)."""
    import numpy as np

    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _near(f, start: int, end: int, prefix: int, radius: int, shifts: int = 12, block: int = 64):
    """Pairs (x, y) of the rows of f that give the components of all pairs within the radius which share a variant of the part.

    The part's first bits are varied already, to prefix: rows that have it unvaried are varied in each other bit.
    """
    import numpy as np

    k, low = divmod(start, 64)
    part = f[:, k] >> np.uint64(low)
    if end > 64 * (k + 1):
        part = part | f[:, k + 1] << np.uint64(64 - low)
    rest = end - start - _PREFIX
    own = np.flatnonzero((part >> np.uint64(rest)) & np.uint64((1 << _PREFIX) - 1) == prefix)
    part = (part & np.uint64((1 << rest) - 1)).astype(np.uint16 if rest <= 16 else np.uint32)
    keys = np.concatenate([part, *(part[own] ^ part.dtype.type(1 << b) for b in range(rest))])
    row = np.concatenate([np.arange(len(f)), *[own] * rest])
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    found = []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    # Small groups are compared all at once, by the distance of their rows in the order; large ones one by one.
    left = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= shifts + 1, sizes))
    for s in range(1, shifts + 1):
        at = at[at + s < left[at]]
        if not len(at):
            break
        x, y = row[at], row[at + s]
        some = np.flatnonzero(_apart_in(f[x, 0], f[y, 0]) + _apart_in(f[x, 1], f[y, 1]) <= radius)
        x, y = x[some], y[some]
        some = sum(_apart_in(f[x, k], f[y, k]) for k in range(LONGS)) <= radius
        found.append((x[some], y[some]))
    for g in np.flatnonzero(sizes > shifts + 1):
        found += _near_in_group(f, row[starts[g] : starts[g] + sizes[g]], radius, block)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else ([], [])


def _near_in_group(f, rest, radius: int, block: int) -> list[tuple]:
    """Pairs that give the components of all pairs within the radius among the rows `rest` of f."""
    import numpy as np

    def near(some, others):
        return sum(_apart_in(f[some, k][:, None], f[others, k]) for k in range(LONGS)) <= radius

    found, family = [], True
    while len(rest) > 1:
        if family:  # all of the first row's component leave together, each compared with those that are not in it
            seed, rest, queue = rest[0], rest[1:], [rest[:1]]
            family = False
            while queue and len(rest):
                some = queue.pop()
                if len(some) > block:
                    queue.append(some[block:])
                hit = near(some[:block], rest).any(axis=0)
                if hit.any():
                    family = True
                    found.append((np.full(int(hit.sum()), seed), rest[hit]))
                    queue.append(rest[hit])
                    rest = rest[~hit]
        else:  # a block of rows leaves, compared with all that are left and with each other
            x, y = np.nonzero(near(rest[:block], rest))
            found.append((rest[x[x < y]], rest[y[x < y]]))
            family = len(found[-1][0]) > block
            rest = rest[block:]
    return found


def _apart_in(x, y):
    import numpy as np

    return np.bitwise_count(x ^ y).astype(np.uint16)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per input row: id, component_id (the smallest id reachable by links).

    Texts are linked if their long fingerprints of `shingle`-word shingles differ in at most bits_for(similarity) bits: all
    of them. At 256 bits the estimate has a standard deviation of 0.02 to 0.03 in similarity. Null and empty
    texts are one class; rows with a null id join their component but never name it; ids may repeat; other columns play
    no part; an empty table gives an empty result.
    """
    docs = staged(long_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    grouped = docs.groupBy("f").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    links = only_staged(lambda: part_links(classes, bits_for(similarity)), "links", df.sparkSession)
    out = _named(docs, classes, links, "f")
    return out.select(F.col("__id").alias(id_col), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of df that stay, with all their columns: of each group of similar texts the one with the smallest id, null ids last.

    Rows are told apart by id and text, whether ids are null or repeat; of rows alike in both, one stays.
    """
    keys = df.select(row_key(df, id_col, text_col, "last").alias("k"), df[f"`{text_col}`"].alias("t"))
    gone = similar_groups(keys, "k", "t", similarity, shingle).filter(F.col("k") != F.col("component_id")).select("k.i", "k.h")
    return one_of_each(without(df, gone, id_col, text_col), id_col, text_col)
