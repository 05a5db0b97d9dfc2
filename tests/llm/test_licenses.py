import random
import re

from pyspark.sql import types as T

from lumensift.llm.licenses import BASE, RULES, STEMS, scan_licenses, scanner


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in BASE for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force():
    rng, scan = random.Random(3), scanner()
    parts = ["under the MIT license", "Apache License, Version 2", "apache license version 20", "CC BY-NC", "cc  by\tnc", "CC-BY-NC-SA 4.0", "Ärger", "_x_", "9", "the", "ẞ", "under", "İ"]
    for _ in range(400):
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert scan(text)[:5] == brute(text)
    assert scan(None)[:7] == (0, 0, None, None, "", "", 0.0)


def test_rules():
    scan = scanner()
    for text, labels in [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("All rights reserved.", "all-rights-reserved"),
        ("We walked in the park and had a license to fish.", ""),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
        ("Mozilla Public License", "mpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ]:
        assert scan(text)[5] == labels, (text, scan(text))


def test_containment_drops_the_weaker_rule_only():
    (label, first, end), *rest = scanner()("GNU General Public License version 2")[7]
    assert (label, first, end, rest) == ("gpl-2", 0, 6, [])


def test_each_rule_has_hundreds_of_companions_and_a_keyword_that_its_matches_hold():
    assert len(RULES) > 300 and len({r.pattern for r in RULES}) > 300
    for r in RULES:
        plain = re.sub(r"\(\?!.*?\)+", "", r.pattern)
        assert r.keyword.strip().split()[0] in re.sub(r"\\[bdw]|\[sc\]|\[sz\]", lambda m: {"[sc]": "c", "[sz]": "z"}.get(m[0], ""), plain).replace("?:", ""), r


def test_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("labels", T.StringType()), T.StructField("text", T.StringType())])
    long = "word " * 50_000 + "under the MIT License"
    df = spark.createDataFrame([(1, "a", long), (None, None, None), (2, "b", ""), (2, "b", "")], schema)
    got = sorted((tuple(r)[:7] for r in scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, 50_004, 1, 50_000, 50_000, "mit", "mit"), (None, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", "")], key=str)
    assert scan_licenses(df.limit(0)).count() == 0


def sample(pattern: str, rng: random.Random) -> str:
    """A text that the pattern matches: each choice and number of repeats at random."""

    def of(parsed) -> str:
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = rng.choice(arg)
                out += rng.choice("abc" if "WORD" in str(value) else "0123456789") if str(kind) == "CATEGORY" else chr(value if isinstance(value, int) else value[0])
            elif name == "BRANCH":
                out += of(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += of(arg[3])
            elif name == "MAX_REPEAT":
                low, high, what = arg
                out += "".join(of(what) for _ in range(rng.randint(low, min(high, low + 3))))
        return out

    return of(re._parser.parse(pattern))


def test_every_rule_passes_its_keyword_and_is_found():
    """No gate hides a rule: a text made from its pattern gives its label, or one that contains or outranks it."""
    rng, scan = random.Random(8), scanner()
    for r in RULES:
        for _ in range(3):
            text = sample(r.pattern, rng)
            assert r.keyword in f" {text} " and any(x.decode() in text for x in STEMS), (r, text)
            line, found = f" {text} ", scan(f"x {text} y")
            if re.search(r.pattern, line):
                assert found[5], (r, text)
                assert found[6] > 0


def test_many_matches_take_linear_time():
    scan = scanner()
    n, *rest = scan("cc by nc " * 200_000)
    assert n == 600_000 and rest[:3] == [200_000, 0, 599_997]
    spans = scan("Apache License, Version 2.0, " * 20_000)[7]
    assert [(a, b) for label, a, b in spans if label == "apache-2"][-1] == (19_999 * 5, 100_000) and len(spans) == 20_000
