"""Replica exchange: prices of changes, brute force on six words, and no worse than one plain chain."""

from itertools import permutations, product

import numpy as np
import pytest

from stratalex.operators.anneal import Problem, exchange


def made(seed, n, m):
    rng = np.random.default_rng(seed)
    table = lambda k: (x := rng.random((k, k)) ** 4) / x.sum(axis=1, keepdims=True)
    cribs = rng.random((n, m)) < 0.3
    cribs[0] = False
    return Problem(table(n), table(m), cribs, rng.random((n, n)) < 0.4, rng.random((m, m)) < 0.5)


def plain(problem, image):
    """All parts of the cost one by one."""
    n, m = len(problem.p), len(problem.q)
    a, b, c, d = problem.weights
    gap = sum((problem.p[i, j] - problem.q[image[i], image[j]]) ** 2 for i in range(n) for j in range(n))
    broken = sum(problem.cribs[i].any() and not problem.cribs[i, image[i]] for i in range(n))
    moved = sum(abs(i - image[i]) for i in range(n)) / n
    pairs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 20)) if problem.topics[i, j] or problem.topics[j, i]]
    torn = sum(not (problem.together[image[i], image[j]] or problem.together[image[j], image[i]]) for i, j in pairs)
    return a * gap + b * broken + c * moved + d * torn / max(1, len(pairs))


def test_a_change_costs_what_the_whole_says():
    problem, rng = made(1, 30, 34), np.random.default_rng(2)
    image = rng.integers(0, 34, 30)
    for _ in range(300):
        i, new = int(rng.integers(30)), int(rng.integers(34))
        other = image.copy()
        other[i] = new
        assert problem.cost(other) - problem.cost(image) == pytest.approx(problem.delta(image, i, new), abs=1e-9)
        assert problem.cost(other) == pytest.approx(plain(problem, other), abs=1e-9)
        image = other


def test_the_walk_knows_its_cost():
    problem, rng = made(3, 12, 12), np.random.default_rng(4)
    for swaps in (True, False):
        start = problem.start()
        image, cost, best, least = problem.walk(start, problem.cost(start), 0.05, 3000, rng, swaps)
        assert problem.cost(image) == pytest.approx(cost) and problem.cost(best) == pytest.approx(least)
        assert not swaps or sorted(image) == sorted(start)


def test_six_words_by_all_mappings(spark):
    for seed in (5, 6):
        problem = made(seed, 6, 6)
        least = min(problem.cost(np.array(x)) for x in permutations(range(6)))
        got = exchange(spark, problem, chains=2, levels=4, steps=4000, rounds=4).collect()
        assert [r.cost for r in got] == [pytest.approx(least)] * 2
        assert all(problem.cost(np.array(r.image)) == pytest.approx(r.cost) for r in got)
    problem = made(7, 4, 5)
    least = min(problem.cost(np.array(x)) for x in product(range(5), repeat=4))
    assert min(r.cost for r in exchange(spark, problem, chains=2, levels=4, steps=4000, rounds=4, swaps=False).collect()) == pytest.approx(least)


def test_no_worse_than_one_chain(spark):
    problem = made(8, 40, 40)
    start = problem.start()
    image, cost, heats = start, problem.cost(start), np.geomspace(1.0, 0.001, 20)
    rng, least = np.random.default_rng(0), np.inf
    for heat in heats:
        image, cost, _, low = problem.walk(image, cost, float(heat), 500, rng, True)
        least = min(least, low)
    got = exchange(spark, problem, chains=2, levels=6, steps=10_000, rounds=5).collect()
    assert min(r.cost for r in got) <= least + 1e-9
