"""Partial ratios of many pairs at once, against plain ones, and the time that they take."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import edits

from test_similarity import partial, words


def test_pairs_of_all_lengths_equal_plain_ones():
    rng = random.Random(3)
    pairs = [(words(rng, n), words(rng, m)) for n, m in [(1, 1), (8, 8), (9, 9), (16, 17), (17, 40), (32, 33), (33, 33), (63, 64), (64, 64), (64, 70), (65, 70), (2, 90)] for _ in range(3)]
    assert edits.partial_ratios(pairs).tolist() == pytest.approx([partial(a, b) for a, b in pairs])
    assert edits.partial_ratios([]).tolist() == []


def test_columns_of_words_and_lists(spark):
    df = spark.createDataFrame([("pay_test01",), ("TXN-55",), ("",), (None,), ("日 sampl",)], "t string")
    got = [r["r"] for r in df.select(edits.nearest_ratio(F.col("t"), ["test", "sample"]).alias("r")).collect()]
    assert got == pytest.approx([0.0 if t is None else max(partial(t, w) for w in ("test", "sample")) for (t,) in df.collect()])
    rows = [(["ch_1", "", None, "clerk 7"], ["INV-2", "clerk 9"]), (["a"], []), ([], None), (["q"], ["zz", "xq"]), (["INV-10", "x"], ["INV-100"])]
    scored = spark.createDataFrame(rows, "a array<string>, b array<string>").select(edits.id_score(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in scored] == pytest.approx([max((partial(p, q) / 100 for p in a or () for q in b or () if p and q), default=0.0) for a, b in rows])


def test_a_pair_takes_microseconds():
    """About 60 microseconds a pair of ids before, when every stretch was a string of its own."""
    n = 40_000
    texts = pa.array([f"INV-{i * 7919 % 10**8:08d}" for i in range(n)] + [f"clerk {i % 40}" for i in range(n)])
    began = time.process_time()
    edits.partial_ratios_of(texts, np.arange(n), np.arange(n, 2 * n))
    edits.partial_ratios_of(texts, np.arange(n), np.arange(n)[::-1])
    assert time.process_time() - began < 2 * n * 15e-6
