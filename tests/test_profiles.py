"""Matrix profiles, motifs and regimes against brute force and planted cases, in chunks far shorter than the series."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profiles
from tallyframe.plans import algorithms

SF = "/root/testdata/sf0.001"


def brute(x, m):
    """(distance, neighbour) of each window by comparing all."""
    out = {}
    for i in range(len(x) - m + 1):
        best = (math.inf, None)
        for j in range(len(x) - m + 1):
            if abs(i - j) <= math.ceil(m / 4):
                continue
            a, b = np.array(x[i : i + m]), np.array(x[j : j + m])
            flat = (a.max() == a.min(), b.max() == b.min())
            if any(flat):
                d = 0.0 if all(flat) else math.sqrt(m)
            else:
                d = float(np.linalg.norm((a - a.mean()) / a.std() - (b - b.mean()) / b.std()))
            best = min(best, (round(d, 6), j))
        if best[1] is not None:
            out[i] = best
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    a = rng.normal(size=90)
    a[60:72] = a[10:22] * 3 + 5  # a motif at another scale
    a[30:42] = 1.0  # flat
    return {"a": a.tolist(), "b": rng.integers(0, 3, 70).astype(float).tolist(), None: rng.normal(size=40).tolist(), "short": [1.0, 2.0, 3.0], "one": [1.0] * 7}


@pytest.fixture(scope="module")
def series(spark, data):
    return spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "id string, t int, v double").repartition(4)


@pytest.mark.parametrize("chunk", [8, 31, 1024])
def test_profile_equals_brute_force(series, data, chunk):
    got = {}
    for r in profiles.matrix_profile(series, "id", "t", "v", 6, chunk).collect():
        got.setdefault(r["id"], {})[r["t"]] = (r["distance"], r["neighbour"])
    want = {k: w for k, x in data.items() if (w := brute(x, 6))}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and all(abs(got[k][i][0] - want[k][i][0]) < 2e-6 for i in want[k])
        assert [i for i in want[k] if got[k][i][1] != want[k][i][1]] == []


def plain_lowest(points, k, apart, also):
    out, left = [], sorted((d, i, j) for i, (d, j) in points.items())
    while left and len(out) < k:
        d, i, j = left[0]
        out.append((i, j, d))
        left = [p for p in left if abs(p[1] - i) > apart and not (also and abs(p[1] - j) <= apart)]
    return out


def test_motifs_equal_brute_force(series, data):
    profile = profiles.matrix_profile(series, "id", "t", "v", 6, 16)
    got = {}
    for r in profiles.motifs(profile, "id", "t", 6).orderBy("rank").collect():
        got.setdefault(r["id"], []).append((r["t"], r["neighbour"], r["distance"]))
    assert got == {k: plain_lowest(w, 3, profiles.zone(6), True) for k, x in data.items() if (w := brute(x, 6))}
    assert got["a"][0][2] == 0.0


def test_arc_curve_equals_brute_force(series, data):
    profile = profiles.matrix_profile(series, "id", "t", "v", 6)
    got = {(r["id"], r["t"]): r["crossing"] for r in profiles.arc_curve(profile, "id", "t", 6, 10).collect()}
    for k, x in data.items():
        w = brute(x, 6)
        n = len(w)
        for i in w:
            arcs = sum(min(a, j) <= i < max(a, j) for a, (_, j) in w.items())
            assert abs(got[k, i] - (1.0 if i < 6 or i >= n - 6 else min(arcs / (2 * i * (n - i) / n), 1))) < 1e-8


def test_planted_regimes_are_found(spark):
    t = np.arange(240)
    x = np.concatenate([np.sin(t[:120] * 2 * np.pi / 12) * 10, np.abs((t[:120] % 9) - 4.0) + 50 + np.sign(t[:120] % 9 - 4.5)])
    rng = np.random.default_rng(1)
    x = x + rng.normal(size=len(x)) * 0.05
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "id string, t int, v double")
    found = profiles.regime_changes(df, "id", "t", "v", 18, regimes=2, chunk=50).collect()
    assert len(found) == 1 and abs(found[0]["t"] - 120) <= 18
    at = found[0]["t"]
    assert abs(found[0]["mean_before"] - x[at - 18 : at].mean()) < 1e-9 and abs(found[0]["sd_after"] - x[at : at + 18].std()) < 1e-9
    assert abs(found[0]["magnitude"] - abs(x[at : at + 18].mean() - x[at - 18 : at].mean())) < 1e-9


def test_motif_periods(spark):
    rng = np.random.default_rng(2)
    week = np.tile([0, 5, 1, 7, 2, 9, 3], 6).astype(float)
    rows = [("weekly", i, float(v)) for i, v in enumerate(week + rng.normal(size=42) * 0.001)] + [("short", i, float(i)) for i in range(9)]
    found = {r["id"]: r for r in profiles.motif_periods(spark.createDataFrame(rows, "id string, t int, v double"), "id", "t", "v").collect()}
    ends = [d for d, _ in brute([v for k, _, v in rows if k == "weekly"], 7).values()]
    confidence = 1 - min(ends) / max(ends)
    assert set(found) <= {"weekly"} and (confidence <= 0.5 or (found["weekly"]["period"] == 7 and abs(found["weekly"]["confidence"] - confidence) < 1e-3))


def test_queries_hold_their_series(spark):
    profile = {(r["platform"], r["at_day"]): (r["distance"], r["neighbour"]) for r in algorithms.QUERIES["matrix_profile"](spark, SF).collect()}
    by = {}
    for (k, i), v in profile.items():
        by.setdefault(k, {})[i] = v
    got = {}
    for r in algorithms.QUERIES["motif_discovery"](spark, SF).orderBy("rank").collect():
        got.setdefault(r["platform"], []).append((r["at_day"], r["neighbour"], r["distance"]))
    assert got == {k: plain_lowest(w, 3, profiles.zone(7), True) for k, w in by.items()}
    assert algorithms.QUERIES["regime_segments"](spark, SF).where(F.col("crossing") >= 1).count() == 0
    assert all(0.5 < r["confidence"] <= 1 for r in algorithms.QUERIES["motif_periods"](spark, SF).collect())
