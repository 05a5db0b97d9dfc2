"""Readers that give documents(doc_id, external_id, text): text folders, JSON lines, wiki dumps, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.functions.markup import clean_wikitext_column
from lumensift.workspace import scratch


def _numbered(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """rows with doc_id 1..n in the given order of their unique keys. Only keys are ordered, never texts, and no task sees them all.

    Keys are range-partitioned and staged; a partition's first number is the sum of the sizes of those before it.
    """
    spark = rows.sparkSession
    path = scratch(spark, "keys")
    rows.select(*keys).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("__p").count().withColumn("__first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row a partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    numbers = ranged.join(F.broadcast(first), "__p").select(*keys, (F.col("__first") + inside).cast("bigint").alias("doc_id"))
    return rows.join(numbers, keys)


def read_txt_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every *.txt below path (any case), UTF-8; ids from 1 by path, external_id the path relative to the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    relative = F.substring(F.col("path"), F.lit(len(full) + 1), F.length("path"))
    rows = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return _numbered(rows, ["path"], ["path"]).select("doc_id", relative.alias("external_id"), "text")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with _id, title and text. The text is "title text", or the text alone; ids from 1 in file order; without _id the number is the external id.

    Real JSON parsing: a null title stays null, blank lines are skipped.
    """
    rows = spark.read.schema("_id string, title string, text string").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__row", F.monotonically_increasing_id())
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    joined = rows.select("__file", "__block", "__row", "_id", F.when(title == "", text).otherwise(F.concat(title, F.lit(" "), text)).alias("text"))
    keys = ["__file", "__block", "__row"]
    return _numbered(joined, keys, keys).select("doc_id", F.coalesce("_id", F.col("doc_id").cast("string")).alias("external_id"), "text")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, text (raw markup) of a MediaWiki XML dump; all revisions' texts are concatenated. Entities are not resolved from outside."""
    schema = "title string, id string, revision array<struct<id:string,text:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    texts = F.array_join(F.transform(F.coalesce("revision", F.array().cast("array<struct<id:string,text:string>>")), lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return pages.select(F.coalesce("id", F.get("revision", F.lit(0))["id"]).alias("page_id"), "title", texts.alias("text"), F.col("id").isNotNull().alias("own_id"))


def read_wiki_xml(spark: SparkSession, path: str, max_docs: int | None = None, clean: bool = True) -> DataFrame:
    """documents of a dump in page order: "title text" of the cleaned text; external_id is the page id, else the title, else the number."""
    pages = wiki_pages(spark, path).withColumn("__row", F.monotonically_increasing_id())
    keys = pages.select("__row")
    numbered = _numbered(keys, ["__row"], ["__row"])
    if max_docs is not None:
        numbered = numbered.filter(F.col("doc_id") <= max_docs)
    rows = pages.join(numbered, "__row")
    body = clean_wikitext_column(F.col("text")) if clean else F.col("text")
    rows = rows.withColumn("body", body)
    title = F.coalesce("title", F.lit(""))
    text = F.when(title == "", F.col("body")).when(F.col("body") == "", title).otherwise(F.concat(title, F.lit(" "), "body"))
    external = F.coalesce("page_id", F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    return rows.select("doc_id", external.alias("external_id"), text.alias("text"))


def find_source_pages(pages: DataFrame, ids: list[str]) -> DataFrame:
    """page_id, title, text of the pages with these own ids, in the order asked for; unknown, null and empty ids are left out."""
    wanted = [i for i in dict.fromkeys(ids) if i]
    own = pages.filter("own_id") if "own_id" in pages.columns else pages
    if not wanted:
        return own.select("page_id", "title", "text").limit(0)
    order = pages.sparkSession.createDataFrame(list(enumerate(wanted)), "k int, page_id string")
    # The first page of an id counts; the list of ids is the caller's and short.
    first = own.filter(F.col("page_id").isin(wanted)).withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.monotonically_increasing_id()))).filter("n = 1")
    return first.join(F.broadcast(order), "page_id").orderBy("k").select("page_id", "title", "text")


def from_table(df: DataFrame, doc_id: str | Column, text: str | Column, external_id: str | Column | None = None) -> DataFrame:
    """documents of any table; ids are taken as they are."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(of(doc_id).cast("bigint").alias("doc_id"), of(doc_id if external_id is None else external_id).cast("string").alias("external_id"), of(text).cast("string").alias("text"))


def renumbered(docs: DataFrame) -> DataFrame:
    """The rule for ids of 0 or less, in the order of the rows: such a row takes the next free number above all before it.

    With z the number of such rows so far, its number is z plus the largest (id - z) of the other rows before it, or plus 0.
    Counts and maxima run within partitions of the input and over sums of theirs, a row a partition; texts stay where they are.
    """
    spark = docs.sparkSession
    path = scratch(spark, "renumbered")
    docs.select("doc_id", "external_id", "text").withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    given = F.col("doc_id") > 0
    keys = rows.select("__at", F.shiftright("__at", 33).alias("__p"), F.when(given, F.col("doc_id")).alias("given"))
    so_far = Window.partitionBy("__p").orderBy("__at")
    keys = keys.withColumn("z", F.count(F.when(F.col("given").isNull(), 1)).over(so_far))
    keys = keys.withColumn("g", F.max(F.col("given") - F.col("z")).over(so_far))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = keys.groupBy("__p").agg(F.max("z").alias("zs"), F.max("g").alias("gs"))
    parts = parts.withColumn("z0", F.coalesce(F.sum("zs").over(before), F.lit(0)))
    parts = parts.select("__p", "z0", F.greatest(F.lit(0), F.coalesce(F.max(F.col("gs") - F.col("z0")).over(before), F.lit(0))).alias("g0"))
    # Within a partition the count starts at z0, so its own maxima are lower by as much.
    number = F.greatest("g0", F.coalesce(F.col("g") - F.col("z0"), F.lit(0))) + F.col("z0") + F.col("z")
    numbers = keys.join(F.broadcast(parts), "__p").select("__at", F.coalesce("given", number).cast("bigint").alias("number"))
    twice = numbers.groupBy("number").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"Duplicate docId: {twice.number}")
    return rows.join(numbers, "__at").select(F.col("number").alias("doc_id"), "external_id", "text")
