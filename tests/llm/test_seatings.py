import math

import numpy as np
import pytest

from willowfold.llm import pitman_yor, seatings


def law(n, discount, y):
    """The probability of each number of tables, from 1, by the recurrence."""
    logs = np.array([-math.inf, 0.0])
    for m in range(1, n):
        stay = logs[1:] + np.log(m - discount * np.arange(1, m + 1))
        logs = np.concatenate([[-math.inf], np.logaddexp(np.append(stay, -math.inf), logs)])
    p = logs[1:] + np.arange(1, n + 1) * math.log(y)
    p = np.exp(p - p.max())
    return p / p.sum()


@pytest.mark.parametrize(("n", "discount"), [(257, 0.05), (257, 0.6), (300, 0.85), (1500, 0.3), (1500, 0.75), (1500, 0.9)])
def test_integral_gives_the_law(n, discount):
    y = np.array([1e-3, 0.1, 1.0, 7.0, 60.0, 500.0, 4e3, 1e5])
    least, most, weights = seatings._by_integral(np.full(len(y), float(n)), discount, y)
    for a, b, own, x in zip(least, most, weights, y, strict=True):
        got = np.zeros(n)
        got[a - 1 : b] = own[: b - a + 1] / own.sum()
        assert abs(got - law(n, discount, x)).sum() < 1e-4


def test_draws_and_likelihood_agree_with_the_law():
    rng = np.random.default_rng(0)
    for n in (70, 200, 900):
        p = law(n, 0.7, 12.0)
        mean, sd = (p * np.arange(1, n + 1)).sum(), math.sqrt((p * np.arange(1, n + 1) ** 2).sum() - (p * np.arange(1, n + 1)).sum() ** 2)
        got = seatings.drawn(rng, np.full(4000, n), 0.7, np.full(4000, 12.0))
        assert abs(got.mean() - mean) < 5 * sd / math.sqrt(4000) and abs(got.std() / sd - 1) < 0.1
    a, b = seatings.log_stirling(900, 0.7), seatings.log_stirling(900, 0.68)
    for t in (1, 2, 9, 80, 500):
        value = seatings.log_likelihood(np.array([900, 200]), np.array([t, 3]), 0.7)
        assert abs(value(0.68) - value(0.7) - (b[900, t] - a[900, t]) - (b[200, 3] - a[200, 3])) < 1e-4


def test_frequent_pairs_are_seated_whole():
    """As many sweeps as the job makes bring pairs of any size to their law; a bound on the customers of a sweep left them near one table."""
    counts, share, houses, discount, strength, others = np.array([300, 90, 100_000]), np.array([0.3, 0.2, 0.05]), 300, 0.7, 1.5, 300.0
    tables = pitman_yor.Tables(np.tile(counts, houses), np.repeat(np.arange(houses), 3), houses)
    rng = np.random.default_rng(6)
    for _ in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        tables.sweep(rng, discount, strength, np.tile(share, houses), np.full(houses, others))
    got = tables.tables.reshape(houses, 3).mean(axis=0)
    held = others + got.sum()
    for n, p, mean in zip((300, 90), share, got, strict=False):
        want = law(n, discount, (strength + discount * held) * p)
        assert abs(mean / (want * np.arange(1, n + 1)).sum() - 1) < 0.05
    assert 0.9 < got[2] / (1 + (strength + discount * held) * share[2] / discount) < 1.1  # the limit of many customers: one and a Poisson number
