"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact similarity. DataFrame functions only.

A window of a document, as long as an item in words, leaks the item if the weighted Jaccard similarity of their word
shingles (each weighted by how often it occurs) is at least the threshold. A document shorter than the item is its own
only window for it.

1. Moving a window right past a shingle that is not the item's never lowers the similarity: so the most similar window
   starts with one of the item's shingles or ends the document, and only such windows are laid. The threshold asks for a
   number of shared shingles; windows that hold fewer shingles of the benchmark are not laid either.
2. Each window gets a SimHash of its shingles, 189 bits in 9 blocks of 21. Windows and items of equal length meet where a
   block differs in at most 3 bits: a window emits all variants of its blocks within 1 bit, an item those within 2. Of 9
   blocks one at least is so near if the fingerprints differ in at most 9 x 4 - 1 = 35 bits: none within that radius is
   missed. Of unlike pairs, of which about half the bits differ, 0.7 percent meet.
3. What meets is verified by the exact similarity, once a pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import only, row_key, staged, without
from lumensift.workspace import once

#: Up to so many distinct shingles of the benchmark are tested for inside each document's row; beyond it they are joined.
INLINE_SHINGLES = 60_000
#: A table of the items' block variants below this size in bytes is broadcast to the windows' side; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20
#: The fingerprint: three longs, each read as three blocks of 21 bits; bits that a window's and an item's block may vary in.
LONGS, BLOCK_BITS = 3, 21
BLOCKS = LONGS * (64 // BLOCK_BITS)
WINDOW_BALL, ITEM_BALL = 1, 2
#: Fingerprints that differ in at most so many bits always meet.
RADIUS = BLOCKS * (WINDOW_BALL + ITEM_BALL + 1) - 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(hashed_words: Column, k: int) -> Column:
    """The hash of each run of k words, by place; empty if there are fewer words."""
    n = F.size(hashed_words) - (k - 1)
    at = lambda i, j: F.get(hashed_words, i + j)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(at(i, j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits of an array of hashes; a bit is set if more than half of them have it, repeats counted.

    Two 32-bit counters share a long: 32 sums by bit pairs, whole for fewer than 2^31 shingles.
    """
    right, left = (lambda x, n: F.call_function("shiftrightunsigned", x, n)), (lambda x, n: F.call_function("shiftleft", x, n))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    pairs = F.aggregate(shingles, F.array_repeat(zero, 32), lambda a, h: F.transform(a, lambda x, b: x + right(h, b).bitwiseAND(F.lit(0x0000000100000001))))
    over = lambda n: n * 2 > F.size(shingles)
    bits = F.transform(
        pairs,
        lambda c, b: F.when(over(c.bitwiseAND(F.lit(0xFFFFFFFF))), left(one, b)).otherwise(zero).bitwiseOR(F.when(over(right(c, F.lit(32))), left(one, b + 32)).otherwise(zero)),
    )
    return F.aggregate(bits, zero, lambda a, x: a.bitwiseOR(x))


def fingerprint(shingles: Column) -> Column:
    """LONGS SimHashes of an array of hashes, each of other hashes of theirs."""
    return F.array(*(simhash(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k)))) for k in range(LONGS)))  # noqa: B023


def blocks(fp: Column) -> Column:
    """The BLOCKS blocks of a fingerprint, as longs."""
    per = 64 // BLOCK_BITS
    return F.array(*(F.shiftrightunsigned(fp[k // per], BLOCK_BITS * (k % per)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for k in range(BLOCKS)))


def ball(radius: int) -> list[int]:
    """All masks of a block with at most that many bits."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(BLOCK_BITS), k)]


def variants(df: DataFrame, radius: int, *keep: str) -> DataFrame:
    """keep.., block (number), mask and key for each block of df(n, fp) and each mask of the ball: the key names length, block and the varied bits."""
    each = df.select("n", *keep, F.posexplode(blocks(F.col("fp"))).alias("block", "v")).select("*", F.explode(F.array(*map(F.lit, ball(radius)))).alias("mask"))
    return each.select(*keep, "block", "mask", F.xxhash64("n", "block", F.col("v").bitwiseXOR(F.col("mask"))).alias("key"))


def item_table(benchmark: DataFrame, item_col: str, text_col: str, shingle: int) -> DataFrame:
    """item_id, n (words), k (words of a shingle: fewer if the item is shorter), sh (hashes), fp, item (a number). Items without words are left out."""
    base = only(benchmark, item_id=item_col, __text=text_col)
    base = once(base, "w", F.transform(words(F.col("__text")), lambda w: F.xxhash64(w)))
    base = base.withColumn("n", F.size("w")).filter("n > 0").withColumn("k", F.least(F.col("n"), F.lit(shingle)))
    sh = F.when(F.col("k") == shingle, shingle_hashes(F.col("w"), shingle))
    for k in range(1, shingle):
        sh = sh.when(F.col("k") == k, shingle_hashes(F.col("w"), k))
    return once(base, "sh", sh).select("item_id", "n", "k", "sh", fingerprint(F.col("sh")).alias("fp"), F.monotonically_increasing_id().alias("item"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = 0.8, shingle: int = 5,
) -> DataFrame:
    """One row per leaking document and item: id, item_id, similarity (of the best window), start_word, hamming.

    Of equally similar windows, start_word is that of the first which starts with a shingle of the benchmark or ends the text.

    Null and empty texts leak nothing; items without words match nothing; an item of fewer words than a shingle is one
    shingle. Equal items each get their rows; documents repeated with the same id give one row. Rows with a null id or item id are
    reported under null. Other columns play no part; an empty table on either side gives an empty result. hamming is the
    number of bits in which the fingerprints differ. A window of similarity 0.8 (a bit differs with a chance of 0.15) meets
    its item with a chance of 0.9998, a more similar one with a higher.
    """
    items = staged(item_table(benchmark, item_col, item_text_col, shingle), "items")
    sizes = items.agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("sh")).alias("shingles"), F.collect_set(F.struct("k", "n")).alias("lengths")
    ).first()  # the lengths are bounded by that of the longest item
    out = None
    base = once(only(docs, __id=id_col, __text=text_col), "w", F.transform(words(F.col("__text")), lambda w: F.xxhash64(w))).select("__id", "w")
    for k in sorted({x.k for x in sizes["lengths"]}):  # at most `shingle` sizes; one, if no item is that short
        hashed = once(base, "sh", shingle_hashes(F.col("w"), k)).select("__id", "sh")
        found = _windows(hashed, items.filter(F.col("k") == k), k, sorted(x.n for x in sizes["lengths"] if x.k == k), similarity, sizes["shingles"])
        out = found if out is None else out.union(found)
    if out is None:
        out = base.filter("false").select("__id", F.lit(0).alias("n"), F.lit(0).alias("start"), F.col("w").alias("sh"))
    laid = out.withColumn("fp", fingerprint(F.col("sh"))).withColumnRenamed("sh", "win").withColumn("window", F.monotonically_increasing_id())
    windows = staged(laid, "windows")  # once written, its numbers stay
    far = variants(items, ITEM_BALL, "item").select("item", "key")
    small = (sizes["items"] or 0) * BLOCKS * len(ball(ITEM_BALL)) * 32 < BROADCAST_BYTES
    met = variants(windows, WINDOW_BALL, "window", "fp", "n").join(F.broadcast(far) if small else far, "key")
    others = items.select("item", F.col("n").alias("n2"), F.col("fp").alias("fp2"))
    met = met.join(F.broadcast(others) if small else others, "item").filter("n = n2")
    # A pair that meets in several ways counts once: in its first near block, by the window's mask that is the lowest of the
    # bits in which the blocks differ, if the item can't bridge them alone.
    apart = once(met, "apart", F.zip_with(blocks(F.col("fp")), blocks(F.col("fp2")), lambda x, y: x.bitwiseXOR(y)))
    first = F.array_position(F.transform("apart", lambda x: F.bit_count(x) <= WINDOW_BALL + ITEM_BALL), True) - 1
    bits = F.get("apart", F.col("block"))
    own = F.when(F.bit_count(bits) <= ITEM_BALL, F.lit(0).cast("bigint")).otherwise(bits.bitwiseAND(-bits))
    pairs = apart.filter((F.col("block") == first) & (F.col("mask") == own)).select("window", "item", _apart(F.col("fp"), F.col("fp2")).alias("hamming"))
    near = pairs.join(windows.select("window", "__id", "start", "win"), "window")
    read = items.select("item", "item_id", "sh")
    near = near.join(F.broadcast(read) if small and (sizes["shingles"] or 0) * 8 < BROADCAST_BYTES else read, "item")
    same = F.aggregate(
        F.array_distinct("win"), F.lit(0),
        lambda a, h: a + F.least(F.size(F.filter("win", lambda x: x == h)), F.size(F.filter("sh", lambda x: x == h))),
    )
    all_of = F.size("win") + F.size("sh")
    near = once(near, "same", same).withColumn("sim", F.col("same") / (all_of - F.col("same"))).filter(F.col("sim") >= similarity)
    best = near.groupBy("__id", "item_id").agg(F.max(F.struct("sim", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("d"))).alias("m"))
    return best.select(
        F.col("__id").alias(id_col), F.col("item_id").alias(item_col), F.round("m.sim", 6).alias("similarity"), (-F.col("m.s")).cast("bigint").alias("start_word"),
        (-F.col("m.d")).cast("int").alias("hamming"),
    )


def _apart(f: Column, g: Column) -> Column:
    return sum((F.bit_count(f[k].bitwiseXOR(g[k])) for k in range(LONGS)), F.lit(0))


def _windows(hashed: DataFrame, items: DataFrame, k: int, lengths: list[int], similarity: float, shingles: int) -> DataFrame:
    """__id, n, start, sh: the windows, as long as some item, that can be the most similar ones; each once."""
    span = lambda n: n - (k - 1)  # noqa: E731  shingles of n words
    least = lambda n: F.greatest(F.lit(1), F.ceil(span(n) * (2 * similarity / (1 + similarity)) - 1e-9).cast("int"))  # noqa: E731  that must be shared
    anchors = items.select("n", F.explode("sh").alias("h")).groupBy("h").agg(F.sort_array(F.collect_set("n")).alias("ns"))
    if shingles <= INLINE_SHINGLES:
        known = [r.h for r in anchors.select("h").collect()]  # bounded by INLINE_SHINGLES
        place = F.filter(F.transform("sh", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
        some = once(hashed, "places", place).filter(F.size("places") > 0)
    else:
        hits = hashed.select("__id", F.posexplode("sh").alias("pos", "h")).join(anchors.select("h"), "h")
        places = hits.groupBy(F.col("__id").alias("__of")).agg(F.array_sort(F.collect_set("pos")).alias("places"))  # of one document
        some = hashed.join(places, F.col("__id").eqNullSafe(F.col("__of"))).select("__id", "sh", "places")
    longest, size = span(max(lengths)), F.size("sh")
    # A document shorter than n starts its window at 0, and can share enough only if it has at least similarity x span(n) shingles.
    enough = lambda n: size >= F.ceil(span(n) * similarity - 1e-9)
    starts = lambda n: F.greatest(F.lit(0), size - span(n))
    last = F.filter(
        F.array(*map(F.lit, lengths)),
        lambda n: F.when(size >= span(n), (F.size("places") >= least(n)) & (F.get("places", F.size("places") - least(n)) >= starts(n)))
        .otherwise(enough(n) & (F.size("places") >= F.ceil((size + span(n)) * (similarity / (1 + similarity)) - 1e-9))),
    )
    # (place, its number, null), and (start, null, length) for each window that ends the document.
    null = F.lit(None).cast("int")
    begins = F.transform("places", lambda p, i: F.struct(p.alias("pos"), i.alias("i"), null.alias("n")))
    spots = some.select("__id", "sh", "places", F.explode(F.concat(begins, F.transform(last, lambda n: F.struct(starts(n).alias("pos"), null.alias("i"), n.alias("n"))))).alias("at"))
    # A row for each spot holds what follows it, no more than the longest item has.
    spots = spots.select(
        "__id", F.col("at.pos").alias("start"), F.col("at.n").alias("own"), F.when(F.col("at.n").isNull(), F.get("sh", F.col("at.pos"))).alias("h"),
        F.slice("sh", F.col("at.pos") + 1, longest).alias("sh"), F.when(F.col("at.n").isNull(), F.slice("places", F.col("at.i") + 1, longest)).alias("next"),
    )
    by_length = spots.join(F.broadcast(anchors) if shingles <= INLINE_SHINGLES else anchors, "h", "left").select(
        "__id", "start", "own", "sh", "next", F.explode(F.when(F.col("own").isNull(), F.col("ns")).otherwise(F.array("own"))).alias("n")
    )
    fits = (F.size("sh") >= span(F.col("n"))) & (F.get("next", least(F.col("n")) - 1) < F.col("start") + span(F.col("n")))
    return by_length.filter(F.col("own").isNotNull() | fits).select("__id", "n", "start", F.slice("sh", 1, span(F.col("n"))).alias("sh")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that leak no item, with all their columns, whether ids are null or repeat."""
    keys = docs.select(row_key(docs, id_col, text_col, "last").alias("k"), docs[f"`{text_col}`"].alias("t"))
    return without(docs, leaks(keys, benchmark, "k", "t", **options).select("k.i", "k.h"), id_col, text_col)
