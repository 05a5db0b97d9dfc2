import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lumensift.llm.mixing import Targets, leaf_budgets, mix, mix_sql


def pour(children, budget):
    """(weight, cap) -> shares: raise the level until the budget is used, exactly, in fractions."""
    from fractions import Fraction

    got, left, live = [Fraction(0)] * len(children), Fraction(budget), [k for k, (w, c) in enumerate(children) if w > 0]
    while live:
        level = left / sum(children[k][0] for k in live)
        full = [k for k in live if children[k][1] <= level * children[k][0]]
        for k in full:
            got[k] = Fraction(children[k][1])
            left -= got[k]
        if not full:
            for k in live:
                got[k] = level * children[k][0]
            break
        live = [k for k in live if k not in full]
    return got


def tree(leaves, t):
    domains = {}
    for d, l, s, tokens in leaves:
        domains.setdefault(d, {}).setdefault(l, {})[s] = (t.sources.get(s, t.other), tokens * t.max_epochs)
    total = sum(x[3] for x in leaves) * t.budget_percent // 100
    caps = {d: {l: sum(c for w, c in x.values() if w) for l, x in ls.items()} for d, ls in domains.items()}
    lw = lambda l: t.languages.get(l, t.other)
    top = [(t.domains.get(d, t.other), sum(c for l, c in caps[d].items() if lw(l))) for d in domains]
    out = {}
    for d, b in zip(domains, pour(top, min(total, sum(c for w, c in top if w)))):
        for l, bl in zip(domains[d], pour([(lw(l), caps[d][l]) for l in domains[d]], b)):
            for s, bs in zip(domains[d][l], pour(list(domains[d][l].values()), bl)):
                out[d, l, s] = bs
    return out


def test_budgets_against_exact_fractions(spark):
    rng = random.Random(9)
    for k in range(4):
        t = Targets(domains={"a": 7, "b": 2}, languages={"en": 5, "de": 0 if k == 1 else 3}, sources={"s0": 1, "s1": 30}, budget_percent=[100, 60, 350, 1000][k])
        leaves = [(d, l, f"s{s}", rng.randint(1, 10 ** rng.randint(1, 6))) for d in "abc" for l in ("en", "de", "fr") for s in range(rng.randint(1, 5))]
        df = spark.createDataFrame([(d, l, s, 1, n) for d, l, s, n in leaves], "domain string, lang string, source string, docs bigint, tokens bigint")
        got = {(r.domain, r.lang, r.source): int(r.budget) for r in leaf_budgets(df, t).collect()}
        want = tree(leaves, t)
        assert set(got) == {k for k, v in want.items() if v or k in got}
        assert all(want[k] - 40 <= got[k] <= want[k] + 1 for k in got), [(k, got[k], float(want[k])) for k in got]
        if t.budget_percent == 1000:
            assert all(got[d, l, s] == 4 * n for d, l, s, n in leaves)


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 1000)), min_size=1, max_size=6), st.integers(0, 3000))
def test_pouring_uses_the_whole_budget(children, budget):
    got = pour(children, budget)
    assert sum(got) == min(budget, sum(c for w, c in children if w)) and all(g <= c for g, (_, c) in zip(got, children))


def test_selection_against_brute_force_and_sql(spark):
    rng = random.Random(10)
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "epoch") else T.StringType()) for c in ("doc_id", "text", "lang", "source", "domain", "epoch")])
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), "q", None) for i in range(300)]
    rows += [(7, "twice the same id", "en", "src0", None, 1), (7, "twice the same id", "en", "src0", None, 1), (900, None, "en", "src1", None, None), (901, "word " * 5000, "xx", "src9", None, None), (None, "a b", "en", "src1", None, None)]
    df = spark.createDataFrame(rows, schema)
    t = Targets(domains={"web": 3, "books": 1}, languages={"en": 5}, sources={"src1": 40}, domain_of={"src9": "books"}, budget_percent=120)
    got = sorted(map(str, mix(df, t).collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mix_sql(t)).fetchall()
    cols = [c[0] for c in con.sql(mix_sql(t)).description]
    spark_rows = sorted(str(tuple(r[c] for c in cols)) for r in mix(df, t).collect())
    assert spark_rows == sorted(map(str, want)) and len(got) == len(want)
    # By hand: each leaf takes whole epochs, then the longest prefix in the order of the seeded hash.
    sizes, budgets = {}, {}
    for i, text, lang, source, *_ in rows:
        key = ("books" if source == "src9" else "web", lang or "", source or "")
        sizes.setdefault(key, []).append((i, len((text or "").split())))
    leaves = spark.createDataFrame([(*k, len(v), sum(n for _, n in v)) for k, v in sizes.items()], "domain string, lang string, source string, docs bigint, tokens bigint")
    budgets = {(r.domain, r.lang, r.source): int(r.budget) for r in leaf_budgets(leaves, t).collect()}
    expected = []
    for key, docs in sizes.items():
        tokens = sum(n for _, n in docs)
        epochs, rest = divmod(budgets.get(key, 0), tokens) if tokens else (0, 0)
        expected += [(i, e) for i, _ in docs for e in range(epochs)]
        places = {}
        for i, n in docs:
            places.setdefault(hashlib.md5(f"{t.seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest(), []).append((i, n))
        through = 0
        for p in sorted(places):
            through += sum(n for _, n in places[p])
            if rest == 0 or through > rest:
                break
            expected += [(i, epochs) for i, _ in places[p]]
    assert sorted(map(str, expected)) == sorted(str((r[cols.index("doc_id")], r[cols.index("epoch")])) for r in want)
    assert mix(df.limit(0), t).count() == 0
