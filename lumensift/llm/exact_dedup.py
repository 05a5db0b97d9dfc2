"""Exact deduplication by a tree merge of sorted digest runs. DataFrame functions only.

Rows are dealt into 2^levels runs by their ids' hash; each run is sorted by digest and keeps the best identifier of each.
In round j the runs are exchanged as in a binomial tree: those whose number has bit j hand over to the run without it, and
the two are merged in the digests' order. After the last round one run is left, dealt over the tasks by digest. The
identifiers are kept in structs, whose aggregates Spark computes by merging sorted rows (SortAggregate), before and after
each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import lookup, lower_ascii, one_of_each, only, row_key, staged, without

#: Rounds of the tree; 2^LEVELS runs.
LEVELS = 4


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, key for each input row. The key is what a match is verified by at every level: SHA-256 of the A-Z-lowered text,
    its length in bytes and an independent hash of it, in 48 bytes."""
    long = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    keyed = only(df, __id=id_col, __text=text_col).withColumn("__text", lower_ascii(F.coalesce(F.col("__text"), F.lit(""))))
    return keyed.select("__id", F.concat(F.unhex(F.sha2("__text", 256)), long(F.octet_length("__text").cast("bigint")), long(F.xxhash64("__text"))).alias("key"))


def sha_of(key: Column) -> Column:
    """The digest in a key of digest_runs, in lowercase hex."""
    return F.lower(F.hex(F.substring(key, 1, 32)))


def merge_tree(runs: DataFrame, levels: int = LEVELS, keep: str = "largest") -> DataFrame:
    """key, keep_id, group_size: the rows (__id, key) as one merged run.

    A key that holds a third of all rows is one row in each run after the first level: a task gets at most two of it
    from each exchange, whatever the key's size.
    """
    best, given = (F.max, F.col("__id").isNotNull()) if keep == "largest" else (F.min, F.col("__id").isNull())  # an id before none
    run = F.pmod(F.xxhash64("__id"), F.lit(1 << levels)).cast("int")
    level = runs.groupBy(run.alias("run"), "key").agg(best(F.struct(given.alias("given"), "__id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    for j in range(levels):
        level = level.groupBy(F.col("run").bitwiseAND(F.lit(~(1 << j))).alias("run"), "key").agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.select("key", F.col("best.__id").alias("keep_id"), "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: id, keep_id (the id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty, so null and empty rows form one
    group. Of a group, the row with the largest (or smallest) id stays; a row with a null id stays only if its group has
    no other id. Rows repeated with the same id count each in group_size and are all marked kept or not alike. Empty
    input gives an empty result; other columns of df, whatever their names, play no part.
    """
    digests = staged(digest_runs(df, id_col, text_col), "digests")
    groups = staged(merge_tree(digests, keep=keep).withColumn("w", F.col("group_size")), "groups")
    found = lookup(digests, groups, "key", "w")
    return found.select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), sha_of(F.col("key")).alias("text_sha256")
    )


def keep_one_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of df that stay, with all their columns: one of each group of equal texts.

    Rows are told apart by id and text, so a null or repeated id neither saves a copy nor takes another text with it; of
    rows alike in both, one stays.
    """
    keys = df.select(row_key(df, id_col, text_col, "first" if keep == "largest" else "last").alias("k"), df[f"`{text_col}`"].alias("t"))
    dropped = exact_dedup(keys, "k", "t", keep).filter(~F.col("kept")).select("k.i", "k.h")
    return one_of_each(without(df, dropped, id_col, text_col), id_col, text_col)
