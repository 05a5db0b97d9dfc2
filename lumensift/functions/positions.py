"""Positional matching on sorted position arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def none() -> Column:
    return F.array().cast("array<int>")


def merged(left: Column, right: Column) -> Column:
    """Sorted distinct union."""
    return F.array_sort(F.array_union(left, right))


def adjacent(left: Column, right: Column) -> Column:
    """The right positions that directly follow a left one. Both sides are hashed once."""
    return F.array_intersect(right, F.transform(left, lambda x: x + 1))


def near(left: Column, right: Column, k: int) -> Column:
    """Left anchors of pairs at most k apart, as a walk along both lists reports them.

    A left position counts if a right one lies in [x, x+k], or in [x-k, x) but not before the previous left position. One
    sort of both lists tells each left position how many right ones come before it: its two neighbours decide.
    """
    if k < 0:
        raise ValueError("distance must not be negative")
    reach = F.lit(k).cast("bigint")
    of_left = F.transform(left, lambda x, i: F.struct(x.alias("at"), F.lit(0).alias("side"), i.alias("i")))
    of_right = F.transform(right, lambda y: F.struct(y.alias("at"), F.lit(1).alias("side"), F.lit(0).alias("i")))
    walk = F.transform(F.array_sort(F.concat(of_left, of_right)), lambda e, j: F.struct(e["at"].alias("at"), e["side"].alias("side"), e["i"].alias("i"), (j - e["i"]).alias("before")))

    def counts(e: Column) -> Column:
        last = F.get(right, e["before"] - 1)
        behind = (last >= e["at"] - reach) & ((e["i"] == 0) | (last >= F.get(left, e["i"] - 1)))
        return (e["side"] == 0) & (F.coalesce(F.get(right, e["before"]) <= e["at"] + reach, F.lit(False)) | F.coalesce(behind, F.lit(False)))

    return F.transform(F.filter(walk, counts), lambda e: e["at"])


def any_near(left: Column, right: Column, k: int) -> Column:
    """Whether any pair is at most k apart: then two that are next to each other in the order of both lists are."""
    sides = F.array_sort(F.concat(F.transform(left, lambda x: F.struct(x.alias("at"), F.lit(0).alias("side"))), F.transform(right, lambda y: F.struct(y.alias("at"), F.lit(1).alias("side")))))
    pairs = F.zip_with(sides, F.slice(sides, 2, F.greatest(F.size(sides) - 1, F.lit(0))), lambda a, b: (a["side"] != b["side"]) & (b["at"].cast("bigint") - a["at"] <= k))
    return F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))
