"""Mixing rates at their optimum: every domain meets its target."""

import numpy as np
import pytest

from lodestone.llm import catalog, mixing

TARGETS = np.array([0.10, 0.02, 0.82, 0.06])


@pytest.fixture(scope="module")
def members(spark):
    draw = np.random.default_rng(4)
    p = mixing.softmax(2.5 * draw.normal(size=(3000, 4)) + np.log([0.25, 0.05, 0.6, 0.1]))
    rows = [(int(n), list(map(float, x))) for n, x in zip(draw.integers(1, 2000, 3000), p)]
    return spark.createDataFrame(rows, "n_tokens long, membership array<double>"), p, np.array([n for n, _ in rows], float)


def test_gap_of_every_domain(members):
    table, p, n = members
    dual, gaps = mixing.fit_rates(table, 4, TARGETS)
    got = (n * mixing.rates_of(p, dual, 0.0)) @ p / n.sum()
    assert np.abs(got - TARGETS).max() < 1e-4 and np.allclose(got - TARGETS, gaps)


def test_optimum_with_least_rate(members):
    """With rates of 1 at least the targets may be out of reach: the slope of every rate must then say so."""
    table, p, n = members
    dual, gaps = mixing.fit_rates(table, 4, None, 0.85, 1.0, True, mixing.MIX_PULL)
    r = mixing.rates_of(p, dual, 1.0, mixing.MIX_PULL)
    slope = p @ (gaps / np.maximum(n @ p / n.sum(), 1e-6)) + mixing.MIX_PULL * (r - 1)
    assert (slope[r <= 1] > -1e-4).all() and np.abs(slope[r > 1]).max(initial=0) < 1e-4


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while not free.all():
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if w.max() < 1e-12:
            break
        free[w.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                break
            bad = free & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x += step * (z - x)
            free &= x > 1e-15
            x[~free] = 0
        x = z
    return x


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_targets_are_met(spark, sf):
    """op9's rates leave no more of the targets than plain nonnegative least squares over the documents does, to 1e-4."""
    rows = catalog.op9_mixing(spark, f"/root/testdata/{sf}").toPandas()
    p, n, r = np.stack(rows["membership"]), rows["n_tokens"].to_numpy(float), rows["rate"].to_numpy()
    want = np.array([catalog.MIX_TARGETS[d] for d in sorted(catalog.MIX_TARGETS)])
    gap = np.abs((n * r) @ p / n.sum() - want).max()
    a = (p * n[:, None] / n.sum()).T
    best = np.abs(a @ nonnegative_least_squares(a, want) - want).max()
    assert (r >= 0).all() and gap <= best + 1e-4 and gap <= 1e-4
