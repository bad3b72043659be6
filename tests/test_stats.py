"""Statistics that SQL can't express, against direct computations."""

import itertools
import math
import random

import numpy as np
import pytest

from reachwell.functions import stats
from reachwell.operators import classify


def test_hac_trend(spark):
    rng = random.Random(4)
    series = {"a": [(2013 + i, 3 + 0.4 * i + rng.gauss(0, 1)) for i in range(10)], "b": [(2013 + i, rng.gauss(0, 1)) for i in range(5)], "c": [(2013, 1.0), (2014, 2.0), (2015, 2.5)]}
    rows = [(k, y, v) for k, own in series.items() for y, v in own] + [("a", 2023, 99.0), ("b", 2019, None)]
    found = {r["k"]: r for r in stats.hac_trend(spark.createDataFrame(rows, "k string, year int, v double"), "year", "v", "k").collect()}
    assert found["c"]["slope"] is None or math.isnan(found["c"]["slope"])
    for k in "ab":
        t, v = (np.array(c, float) for c in zip(*series[k], strict=True))
        n, x = len(t), t - t.mean()
        slope = (x @ v) / (x @ x)
        left = v - v.mean() - slope * x
        assert found[k]["slope"] == pytest.approx(slope)
        # The slope's variance from the scores x_i e_i alone, with Bartlett weights.
        g = x * left
        total = sum((1 - abs(i - j) / 5) * g[i] * g[j] for i in range(n) for j in range(n) if abs(i - j) < 5)
        for name, variance in (("p_ols", (left @ left) / (n - 2) / (x @ x)), ("p_hac", total * n / (n - 2) / (x @ x) ** 2)):
            z, nu = abs(slope) / math.sqrt(variance), n - 2
            u = np.linspace(0, z, 200_001)
            density = math.gamma((nu + 1) / 2) / math.sqrt(nu * math.pi) / math.gamma(nu / 2) * (1 + u * u / nu) ** (-(nu + 1) / 2)
            assert found[k][name] == pytest.approx(1 - 2 * np.trapezoid(density, u), abs=1e-6)


def test_monte_carlo_interval_covers(spark):
    rng = random.Random(5)
    rows = [(g, rng.uniform(0, 5), 100.0, 20.0) for g in "xy" for _ in range(60)]
    (one, two) = sorted(stats.monte_carlo_mean(spark.createDataFrame(rows, "g string, a double, e double, s double"), "a", "e", "s", "g").collect())
    for r, own in ((one, rows[:60]), (two, rows[60:])):
        a = np.array([x[1] for x in own])
        assert r["point"] == pytest.approx(a.mean())
        # The ratio's standard error to first order.
        half = 1.96 * 20 * math.sqrt(((a - a.mean()) ** 2).sum()) / (100 * 60)
        assert r["high"] - r["point"] == pytest.approx(half, rel=0.15) and r["point"] - r["low"] == pytest.approx(half, rel=0.15)


def test_natural_breaks_against_all_splits():
    rng = random.Random(6)
    for n, k in ((6, 2), (9, 3), (11, 4)):
        x = sorted(rng.sample(range(100), n))
        w = [rng.randrange(1, 5) for _ in x]

        def within(low, high):
            v, m = np.array(x[low:high], float), np.array(w[low:high], float)
            return (m * (v - (m @ v) / m.sum()) ** 2).sum()

        best = min(sum(within(a, b) for a, b in itertools.pairwise((0, *cuts, n))) for cuts in itertools.combinations(range(1, n), k - 1))
        found = classify.jenks(x, w, k)
        ends = [x.index(e) + 1 for e in found[1:]]
        assert found[0] == x[0] and ends[-1] == n and len(ends) == k
        assert sum(within(a, b) for a, b in itertools.pairwise((0, *ends))) == pytest.approx(best)
