"""What several training-data operators share: column hygiene, staged tables and skew-safe lookups."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.workspace import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: At most so many of the heaviest keys are sent to every task of a lookup, and only keys with more rows than COLD_ROWS.
HOT_KEYS, COLD_ROWS = 1024, 64
#: Where values have a size, those of the hot keys are broadcast as far as they come to no more than this together.
HOT_SIZE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so that other columns can't clash with an operator's own."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in columns.items()))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain lower() does that for pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(df: DataFrame, id_col: str, text_col: str, nulls: str) -> Column:
    """(where null ids go, id, hash of the text): tells rows apart whose ids are null or repeat. nulls, 'first' or 'last', orders null ids."""
    i = df[f"`{id_col}`"]
    return F.struct((i.isNotNull() if nulls == "first" else i.isNull()).alias("o"), i.alias("i"), F.xxhash64(F.coalesce(df[f"`{text_col}`"], F.lit(""))).alias("h"))


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose row_key is not in gone(i, h), with all their columns."""
    h = F.xxhash64(F.coalesce(df[f"`{text_col}`"], F.lit("")))
    dropped = gone.select(F.col("i").alias("__gone_i"), F.col("h").alias("__gone_h")).distinct()
    return df.join(dropped, df[f"`{id_col}`"].eqNullSafe(F.col("__gone_i")) & (h == F.col("__gone_h")), "left_anti")


def one_of_each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows repeated with the same id and text one stays; all columns are kept."""
    key = row_key(df, id_col, text_col, "last")
    repeated = staged(df.groupBy(key["i"].alias("i"), key["h"].alias("h")).count().filter("count > 1").select("i", "h"), "repeated")
    if repeated.limit(1).count() == 0:
        return df
    marked = df.withColumn("__h", F.xxhash64(F.coalesce(df[f"`{text_col}`"], F.lit(""))))
    again = marked.join(repeated, marked[f"`{id_col}`"].eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h")), "left_semi")
    return without(df, repeated, id_col, text_col).union(again.dropDuplicates([id_col, "__h"]).drop("__h"))


#: Paths of the staged tables that are there, in the order of writing; tables written so far; how many between two calls of clean().
_staged: list[str] = []
_written = 0
CLEAN_EVERY = 3


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: cuts the lineage, survives lost executors, and is computed once."""
    global _written
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _staged.append(path)
    _written += 1
    if _written % CLEAN_EVERY == 0:
        clean(df.sparkSession)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _staged.remove(p)


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes staged tables that no later plan reads. With shuffles, also lets Spark's cleaner delete the shuffle files of plans that are written by now."""
    spark = tables[0].sparkSession
    _delete(spark, [t.staged_at for t in tables])
    if shuffles:
        clean(spark)


def clean(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and broadcast tables of a plan when the driver's JVM has collected it: this is asked for, so that neither piles up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only_staged(result: Callable[[], DataFrame], name: str, spark: SparkSession, *before: DataFrame) -> DataFrame:
    """The staged result; all that was staged on the way to it, and the tables `before` it, which it was read from, are deleted."""
    known = set(_staged)
    out = staged(result(), name)
    _delete(spark, [p for p in _staged if p not in known and p != out.staged_at] + [t.staged_at for t in before])
    clean(spark)
    return out


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, hot: int = HOT_KEYS, salt: str | None = None, size: str | None = None) -> DataFrame:
    """left LEFT JOIN right on key, where right has one row per key and weight counts the rows of left with that key.

    The `hot` heaviest keys (a bounded number of rows, whatever the data) are broadcast, and the rows of left that they
    match leave the shuffle key; so no key in the shuffle join has more than 1/hot of all rows. No row of left is lost,
    and one with a null key gets nulls. weight itself is not returned. salt is a column of left (the first, if not given)
    that spreads the answered rows; it is hashed, not drawn, so a task that is run again deals its rows alike.

    Values that are not of fixed size come with a column `size` of theirs: the hot keys stop where the sizes add up to
    HOT_SIZE, and a key beyond is joined by shuffle, where adaptive execution splits it.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    packed = right.select(F.col(key), F.col(weight), F.struct(*values).alias("__ls_v"))
    top = packed.filter(F.col(weight) > COLD_ROWS).orderBy(F.desc(weight), key).limit(hot)
    if size:
        so_far = Window.orderBy(F.desc(weight), key).rowsBetween(Window.unboundedPreceding, 0)  # over at most `hot` rows
        top = top.withColumn("__ls_sum", F.sum(f"__ls_v.{size}").over(so_far)).filter(F.col("__ls_sum") <= HOT_SIZE)
    top = top.select(F.col(key).alias("__ls_hk"), F.col("__ls_v").alias("__ls_hv"))
    first = left.join(F.broadcast(top), left[key] == F.col("__ls_hk"), "left")
    # A row that the hot keys have answered gets a null key and a salt of its own, so that such rows spread over the tasks.
    answered = F.col("__ls_hk").isNotNull() | F.col(key).isNull()
    keyed = first.withColumn("__ls_k", F.when(answered, F.lit(None)).otherwise(F.col(key))).withColumn(
        "__ls_s", F.when(answered, F.pmod(F.xxhash64(salt or left.columns[0]), F.lit(1_000_003)).cast("int")).otherwise(F.lit(0))
    )
    # 0, but not a constant: the optimizer would drop a constant from the join's keys, and the answered rows would meet under the null key.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    rest = packed.select(F.col(key).alias("__ls_rk"), zero.alias("__ls_rs"), F.col("__ls_v").alias("__ls_rv"))
    joined = keyed.join(rest, (F.col("__ls_k") == F.col("__ls_rk")) & (F.col("__ls_s") == F.col("__ls_rs")), "left")
    value = F.coalesce(F.col("__ls_hv"), F.col("__ls_rv"))
    return joined.select(*left.columns, *(value[c].alias(c) for c in values))


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of at most so many bytes together, or of one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def per_row(df: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, make: Callable[[], Callable], every: int = 2000) -> DataFrame:
    """Applies a Python function to each row in Arrow batches. make() runs once a task and gives row -> tuple.

    Only the columns' values of one incoming batch and `every` results are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                rows.append(f(*(a[i].as_py() for a in arrays)))
                if len(rows) >= every:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return df.select(*columns).mapInArrow(run, ddl)
