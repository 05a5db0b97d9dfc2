"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import discard, lookup, staged


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b).

    Each round takes the smallest label of a node and its neighbours, then the label's own label (which halves the way to
    the smallest node), until nothing changes; labels only fall, so it ends. Labels are staged in the shared folder after
    each round, so no round is computed twice and none is lost with an executor; the driver only sees whether a label
    changed. A node with very many neighbours, and a label that very many nodes have, are joined by lookup(), so neither
    gathers its rows in one task.
    """
    both = staged(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select(F.col("b"), F.col("a"))), "adjacency")
    labels = staged(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        theirs = lookup(both, labels.select(F.col("node").alias("near"), "degree", F.col("component").alias("theirs")), "near", "degree", salt="node")
        seen = theirs.groupBy("node").agg(F.min("theirs").alias("theirs"))
        met = staged(labels.join(seen, "node").select("node", "degree", F.col("component").alias("before"), F.least("component", "theirs").alias("now")), "met")
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("up")).join(met.groupBy("now").agg(F.count(F.lit(1)).alias("n")), "now")
        jumped = lookup(met, up, "now", "n", salt="node").withColumn("component", F.least("now", "up"))
        after = staged(jumped.select("node", "degree", "component", (F.col("component") != F.col("before")).alias("changed")), "labels")
        done = after.filter("changed").limit(1).count() == 0
        discard(labels, met, *([both] if done else []))
        if done:
            return after.select("node", "component")
        labels = after
