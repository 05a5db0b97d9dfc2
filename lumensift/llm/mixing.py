"""Mixing sources to target weights: budgets flow down a domain-language-source tree, prefixes of seeded epochs fill them.

All amounts are whole tokens in DECIMAL(38), so the same table gives the same mix on every engine and cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumensift.llm.common import discard, lookup, only, staged

WORDS = r"[^\x20\x09-\x0D]+"
_BIG = "decimal(38,0)"
#: Hex digits of a row's place in its epoch that name its bucket; sums by bucket replace one long running sum.
BUCKET_DIGITS = 4


@dataclass(frozen=True)
class Targets:
    """Weights (whole, 0 to 1000) of domains, languages and sources among their siblings; names that are not listed get `other`.

    domain_of names each source's domain. budget_percent is the mix's size in percent of all tokens; max_epochs bounds how
    often a leaf may be repeated; seed orders the rows in each epoch.
    """

    domains: Mapping[str, int] = field(default_factory=dict)
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    domain_of: Mapping[str, str] = field(default_factory=dict)
    other_domain: str = "web"
    other: int = 10
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 17

    def __post_init__(self):
        if any(not 0 <= w <= 1000 for m in (self.domains, self.languages, self.sources) for w in (*m.values(), self.other)):
            raise ValueError("weights are 0 to 1000")


def _chosen(key: Column, values: Mapping, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to children(parent.., name, weight, cap, parent_budget): the parent's budget by weight, no child above its cap.

    What a child can't use goes to its siblings by their weights. Children are saturated in the order of cap/weight; child
    i is saturated if the level that just fills it still leaves the budget enough for all others at that level. As a
    parent never gets more than its children's caps, shortages leave a family only when all of it is saturated. Shares are
    rounded down.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") * 1000000 / F.col("weight")).cast(_BIG), name)
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: c.cast(_BIG)
    marked = children.filter("weight > 0").select(
        "*", big(F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("cap_before"), big(F.sum("weight").over(behind)).alias("weight_left")
    )
    full = big(F.col("cap_before") * F.col("weight") + F.col("cap") * F.col("weight_left")) <= big(F.col("parent_budget") * F.col("weight"))
    family = Window.partitionBy(*parent)
    split = marked.withColumn("full", full).select(
        "*",
        big(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).alias("used"),
        big(F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(0))).alias("rest_weight"),
    )
    part = F.floor(big((F.col("parent_budget") - F.col("used")) * F.col("weight")) / F.when(F.col("rest_weight") > 0, F.col("rest_weight")))
    out = split.withColumn("budget", big(F.when(F.col("full"), F.col("cap")).otherwise(F.least(big(part), F.col("cap")))))
    return out.drop("cap_before", "weight_left", "full", "used", "rest_weight", "parent_budget")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """domain, lang, source, docs, tokens, budget for leaves(domain, lang, source, docs, tokens). Leaves of weight 0, or below such a node, are left out."""
    big = lambda c: c.cast(_BIG)
    leaf = leaves.withColumns({"cap": big(F.col("tokens") * targets.max_epochs), "weight": _chosen(F.col("source"), targets.sources, targets.other)}).filter("weight > 0")
    lang = leaf.groupBy("domain", "lang").agg(big(F.sum("cap")).alias("cap")).withColumn("weight", _chosen(F.col("lang"), targets.languages, targets.other)).filter("weight > 0")
    domain = lang.groupBy("domain").agg(big(F.sum("cap")).alias("cap")).withColumn("weight", _chosen(F.col("domain"), targets.domains, targets.other)).filter("weight > 0")
    caps = domain.agg(big(F.sum("cap")).alias("all_caps"))
    root = leaves.agg(big(F.floor(F.sum("tokens") * targets.budget_percent / 100)).alias("asked")).crossJoin(caps)  # one row by one row
    top = domain.crossJoin(F.broadcast(root.select(big(F.least("asked", "all_caps")).alias("parent_budget"))))
    domains = share(top, [], "domain")
    langs = share(lang.join(domains.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"], "lang")
    return share(leaf.join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]), ["domain", "lang"], "source").select(
        "domain", "lang", "source", "docs", "tokens", "budget"
    )


def mix(df: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per chosen document and epoch: id, domain, lang, source, n_tokens, epoch.

    A leaf with budget b and t tokens takes b div t whole epochs and, of the next one, the longest prefix of documents
    with at most b mod t tokens. An epoch's order is that of md5(seed:epoch:id). Tokens are white-space words. Null lang
    and source count as empty names, a null text has no tokens; a leaf without tokens takes no part. Rows with equal ids
    stand at one place of the order and are taken together; other columns play no part; an empty table gives an empty mix.

    The order is never held in one task: tokens are first summed by (leaf, leading digits of the place); the sums of a
    leaf's 256 groups of buckets, then those of one group's 256 buckets locate the bucket where its prefix ends, and only
    that bucket's rows are sorted and summed one by one.
    """
    base = only(df, __id=id_col, __text=text_col, lang=lang_col, source=source_col)
    rows = staged(
        base.select(
            "__id", _chosen(F.coalesce("source", F.lit("")), targets.domain_of, targets.other_domain).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
            F.coalesce("source", F.lit("")).alias("source"), F.regexp_count(F.coalesce("__text", F.lit("")), F.lit(WORDS)).cast("bigint").alias("n_tokens"),
        ).withColumn("leaf", F.to_json(F.array("domain", "lang", "source"))),
        "mix-rows",
    )
    leaves = rows.groupBy("domain", "lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    budgets = staged(leaf_budgets(leaves, targets), "budgets").filter("tokens > 0")
    plan = budgets.select(
        F.to_json(F.array("domain", "lang", "source")).alias("leaf"), "docs", F.floor(F.col("budget") / F.col("tokens")).cast("bigint").alias("epochs"),
        (F.col("budget") % F.col("tokens")).cast("bigint").alias("rest"),
    )
    placed = lookup(rows, plan, "leaf", "docs").filter("epochs is not null")
    placed = staged(placed.withColumn("place", F.md5(F.concat_ws(":", F.lit(targets.seed), "epochs", F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary"))), "placed")
    discard(rows)
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = placed.filter("rest > 0").groupBy("leaf", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.count(F.lit(1)).alias("docs"))
    sums = staged(sums.withColumn("group", F.substring("bucket", 1, BUCKET_DIGITS // 2)), "bucket-sums")
    groups = sums.groupBy("leaf", "group").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.sum("docs").alias("docs"))
    leaf_docs = groups.groupBy("leaf").agg(F.sum("docs").alias("docs"))
    # rest < tokens, so each such leaf has a group of buckets, and in it a bucket, in which its prefix ends.
    inside = sums.join(_end(groups.withColumn("start", F.lit(0)), "group").select("leaf", "group", F.col("before").alias("start")), ["leaf", "group"])
    ends = _end(inside, "bucket").join(leaf_docs, "leaf").select("leaf", "docs", "bucket", "before")
    ends = staged(ends, "ends")
    discard(sums)
    near = lookup(placed, ends, "leaf", "docs", salt="__id")
    columns = [F.col("__id").alias(id_col), F.col("domain"), F.col("lang").alias(lang_col), F.col("source").alias(source_col), F.col("n_tokens")]
    whole = placed.filter("epochs > 0").select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)).alias("epoch"))
    ahead = near.filter(bucket < F.col("bucket")).select(*columns, F.col("epochs").alias("epoch"))
    running = F.sum("n_tokens").over(Window.partitionBy("leaf").orderBy("place"))  # by range: equal places together
    edge = near.filter(bucket == F.col("bucket")).withColumn("through", F.col("before") + running).filter("through <= rest").select(*columns, F.col("epochs").alias("epoch"))
    return whole.union(ahead).union(edge)


def _end(sums: DataFrame, name: str) -> DataFrame:
    """leaf, name and the tokens before it: the first of sums(leaf, name, n, rest, start) with which start and the sums, in order of name, exceed rest."""
    through = F.col("start") + F.sum("n").over(Window.partitionBy("leaf").orderBy(name))
    over = sums.withColumn("through", through).filter(F.col("through") > F.col("rest"))
    first = over.groupBy("leaf").agg(F.min(F.struct(name, (F.col("through") - F.col("n")).alias("before"))).alias("end"))
    return first.select("leaf", F.col(f"end.{name}").alias(name), "end.before")


def mix_sql(targets: Targets, documents: str = "documents") -> str:
    """The same mix in DuckDB's SQL, with plain running sums."""

    def chosen(key: str, values: Mapping, other) -> str:
        lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
        return f"CASE {' '.join(f'WHEN {key} = {lit(k)} THEN {lit(v)}' for k, v in values.items())} ELSE {lit(other)} END" if values else lit(other)

    def shared(name: str, source: str, parent: str, key: str) -> str:
        by = f"PARTITION BY {parent} " if parent else ""
        return f"""
            {name}_m AS (SELECT *, coalesce(sum(cap) OVER ({by}ORDER BY round(cap::DECIMAL(38,0) * 1000000 / weight)::HUGEINT, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cap_before,
                sum(weight) OVER ({by}ORDER BY round(cap::DECIMAL(38,0) * 1000000 / weight)::HUGEINT, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weight_left FROM {source} WHERE weight > 0),
            {name}_f AS (SELECT *, cap_before * weight + cap * weight_left <= parent_budget * weight AS filled FROM {name}_m),
            {name}_s AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by.strip()}), 0)::HUGEINT AS used,
                coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({by.strip()}), 0)::HUGEINT AS rest_weight FROM {name}_f),
            {name} AS (SELECT * EXCLUDE (parent_budget), CASE WHEN filled THEN cap ELSE least(((parent_budget - used) * weight) // rest_weight, cap) END::HUGEINT AS budget FROM {name}_s)"""

    return f"""
        WITH r AS (SELECT doc_id, {chosen("coalesce(source, '')", targets.domain_of, targets.other_domain)} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS n_tokens FROM {documents}),
            l AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM r GROUP BY ALL),
            leaf AS (SELECT *, tokens * {targets.max_epochs} AS cap, {chosen("source", targets.sources, targets.other)} AS weight FROM l WHERE {chosen("source", targets.sources, targets.other)} > 0),
            lg AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap, {chosen("lang", targets.languages, targets.other)} AS weight FROM leaf GROUP BY ALL HAVING {chosen("lang", targets.languages, targets.other)} > 0),
            dm AS (SELECT domain, sum(cap)::HUGEINT AS cap, {chosen("domain", targets.domains, targets.other)} AS weight FROM lg GROUP BY ALL HAVING {chosen("domain", targets.domains, targets.other)} > 0),
            top AS (SELECT *, least((SELECT sum(tokens)::HUGEINT * {targets.budget_percent} // 100 FROM l), (SELECT sum(cap)::HUGEINT FROM dm)) AS parent_budget FROM dm),
            {shared("b1", "top", "", "domain")},
            lp AS (SELECT lg.*, b1.budget AS parent_budget FROM lg JOIN b1 USING (domain)),
            {shared("b2", "lp", "domain", "lang")},
            sp AS (SELECT leaf.*, b2.budget AS parent_budget FROM leaf JOIN b2 USING (domain, lang)),
            {shared("b3", "sp", "domain, lang", "source")},
            p AS (SELECT r.*, (budget // tokens)::BIGINT AS epochs, (budget % tokens)::BIGINT AS rest FROM r JOIN b3 USING (domain, lang, source) WHERE tokens > 0),
            c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{targets.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))) AS through FROM p)
        SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, epochs)) AS epoch FROM p
        UNION ALL SELECT doc_id, domain, lang, source, n_tokens, epochs AS epoch FROM c WHERE rest > 0 AND through <= rest"""
