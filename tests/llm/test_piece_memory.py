"""Python workers hold one Arrow batch and the work on a bounded piece of it, whatever a batch holds."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from lumensift.llm import html_extract, langid
from lumensift.llm.common import pieces


class Plan:
    """Stands for a DataFrame: mapInArrow gives the function."""

    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType())])
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))  # noqa: N815

    def select(self, *columns):
        return self

    def mapInArrow(self, function, ddl):  # noqa: N802
        return function


def peak(function, batch):
    """Bytes of Python and NumPy at the most, and the rows."""
    tracemalloc.start()
    try:
        rows = [r for b in function(iter([batch])) for r in b.to_pylist()]
        return tracemalloc.get_traced_memory()[1], rows
    finally:
        tracemalloc.stop()


def test_pieces():
    rng = random.Random(3)
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "é" * rng.randint(0, 8) for _ in range(rng.randint(0, 12))]
        size = [2 * len(t or "") for t in texts]
        found = list(pieces(pa.array(["x", *texts], pa.string()).slice(1), 10))
        assert [i for a, b in found for i in range(a, b)] == list(range(len(texts)))
        assert all(sum(size[a:b]) <= 10 or b == a + 1 for a, b in found)
        assert all(sum(size[a : b + 1]) > 10 for a, b in found if b < len(texts))


def test_language_evidence():
    model = langid.Model(("a", "b"), np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2)).astype(np.float32))
    texts = [None, "", "x" * (langid.PIECE + 5), *(f"word {k} " * 250 for k in range(1500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["__id", "__text"])
    most, rows = peak(langid.text_evidence(Plan(), model, "__id", "__text"), batch)
    assert [r["__id"] for r in rows] == list(range(len(texts))) and most < 80 * langid.PIECE
    for k in (0, 1, 2, 3, 700, len(texts) - 1):
        grams, _ = langid.trigrams([texts[k]])
        assert rows[k]["n_grams"] == len(grams) and np.allclose(rows[k]["ll"], model.log_p[:, grams].sum(axis=1, dtype=np.float64))


def test_page_tokens():
    n = 300
    html = [f"<!--{'x' * 100_000}--><p>same</p><p>{k}</p>" for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["http://h.de/"] * n), pa.array(html)], names=["__url", "__html"])
    most, rows = peak(html_extract.page_tokens(Plan()), batch)
    assert most < 5_000_000 and len({r["page"] for r in rows}) == n and len({r["token"] for r in rows if r["path"] is not None}) == n + 1
