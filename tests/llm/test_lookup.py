from pyspark.sql import functions as F

from lumensift.llm.common import lookup


def test_answered_rows_are_dealt_by_their_salt(spark):
    """Rows of hot keys get their values, and the join deals rows by key and salt, so that they don't meet in one task."""
    left = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") < 490, F.col("id").cast("string")).alias("key"))
    right = left.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("first < 400")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup(left, right, "key", "n")
        assert {r.id: r.first for r in found.collect()} == {i: 0 if i < 300 else i if i < 400 else None for i in range(500)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(__ls_k" in plan and any("__ls_k" in x and "__ls_s" in x for x in plan.split("\n") if "hashpartitioning" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
