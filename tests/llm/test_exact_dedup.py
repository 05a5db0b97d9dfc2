import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from lumensift.llm.exact_dedup import digest_runs, exact_dedup, keep_one_row, merge_tree


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("keep_id", T.IntegerType())])
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], schema)


def rows():
    rng = random.Random(3)
    base = ["", None, "One", "oNE", "ÄRGER", "ärger", "Ärger", "one ", "İ", "x" * 200_000, "X" * 200_000, "a\x00b", "日本"]
    out = [(i, rng.choice(base)) for i in range(200)] + [(1000 + i, "Copy me") for i in range(600)]
    return out + [(7, "twice"), (7, "twice"), (None, "no id"), (None, "TWICE"), (None, "")]


@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
def test_against_brute_force(spark, keep, best):
    got = exact_dedup(frame(spark, rows()), keep=keep)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), best)


def test_kept_rows_and_no_rows(spark):
    df = frame(spark, rows())
    left = keep_one_row(df)
    got = [(r.doc_id, r.text) for r in left.collect()]
    best = {}
    for i, t in rows():
        best[low(t)] = max(best.get(low(t), (False, 0)), (i is not None, i or 0))
    assert sorted((low(t), (i is not None, i or 0)) for i, t in got) == sorted(best.items()) and left.columns == df.columns
    assert exact_dedup(df.limit(0)).count() == 0 and keep_one_row(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    data = [(1, "same"), (1, "unique one"), (2, "same"), (5, "x"), (5, "x"), (None, "same"), (None, "alone"), (None, "ALONE")]
    got = sorted(((r.doc_id, low(r.text)) for r in keep_one_row(frame(spark, data)).collect()), key=str)
    assert got == [(1, "unique one"), (2, "same"), (5, "x"), (None, "alone")]


def test_the_tree_merges_sorted_runs(spark):
    """Whatever the number of rounds, one merged run is left; the plan merges sorted rows and has an exchange for each round."""
    digests = digest_runs(frame(spark, rows())).persist()
    found = [sorted(map(tuple, merge_tree(digests, levels).collect()), key=str) for levels in (0, 1, 3, 5)]
    assert found[0] == found[1] == found[2] == found[3]
    plan = merge_tree(digests, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 8 and plan.count("Exchange hashpartitioning(") == 4 and "HashAggregate" not in plan
    digests.unpersist()
