"""The as-of join against a plain search, with one key of nine tenths of the rows, equal moments, nulls and clashing names."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tallyframe.operators.asof import asof_join


@pytest.mark.parametrize("parts", [None, 9])
def test_asof_join(spark, parts):
    rng = random.Random(1)
    pick = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    rows = [(i, pick(), rng.choice([None, *range(60)]) if i % 9 == 0 else rng.randrange(60), "x") for i in range(600)] + [(1, "hot", 30, "x")] * 40
    values = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(5, 60)]), rng.choice([None, *map(float, range(9))])) for _ in range(80)]

    def plain(key, at):
        if key is None or at is None:
            return None, None
        held = [(t, v) for k, t, v in values if k == key and t is not None and v is not None and t <= at]
        best = max(held, default=(None, None))
        return best[1], best[0]

    left = spark.createDataFrame(rows, "id int, currency string, day int, value string").repartition(4)
    right = spark.createDataFrame(values, "cur string, since int, rate double").repartition(3)
    got = asof_join(left, right, "currency", "day", "rate", "cur", "since", out="rate", out_at="__since", parts=parts)
    assert got.columns == ["id", "currency", "day", "value", "rate", "__since"]
    assert Counter(map(tuple, got.collect())) == Counter((*r, *plain(r[1], r[2])) for r in rows)
    assert asof_join(left.limit(0), right, "currency", "day", "rate", "cur", "since").count() == 0
    assert {r["value"] for r in asof_join(left, right.limit(0), "currency", "day", "rate", "cur", "since").select("value").collect()} == {None}
