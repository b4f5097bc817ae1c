"""Searches for several goals and by a model of the score, against exhaustive search on planted scores."""

from itertools import product

import numpy as np
import pytest

from tidebars.plans import optimise

RANGES = [(0, 30), (0, 30)]
EVERY = list(product(range(31), range(31)))


def beaten(goals):
    return [any(all(x >= y for x, y in zip(o, own)) and tuple(o) != tuple(own) for o in goals) for own in goals]


def test_fronts_by_the_definition():
    rng = np.random.default_rng(2)
    for size, goals in ((1, 1), (40, 2), (60, 3)):
        rows = rng.integers(0, 6, (size, goals)).astype(float)
        left = list(range(size))
        for front in optimise.fronts(rows):
            assert front == [k for k, b in zip(left, beaten(rows[left].tolist())) if not b]
            left = [k for k in left if k not in front]
        assert not left


def test_crowding():
    assert optimise.crowding(np.array([[0.0, 10.0], [1.0, 5.0], [4.0, 4.0], [10.0, 0.0]])).tolist() == [np.inf, 1.0, 1.4, np.inf]
    assert optimise.crowding(np.array([[1.0], [1.0], [1.0]]))[1] == 0


def test_nondominated_settings_are_those_of_the_whole_range():
    goals = lambda p: (float(-((p[0] - 5) ** 2) - (p[1] - 20) ** 2), float(-((p[0] - 9) ** 2) - (p[1] - 20) ** 2))
    rated = []

    def score(settings):
        rated.extend(settings)
        return {p: goals(p) for p in settings}

    found = optimise.nondominated(score, RANGES, lambda p: True, population=24, generations=16, mutation=0.2)
    assert len(rated) == len(set(rated)) < len(EVERY) / 2
    best = [p for p, b in zip(EVERY, beaten([goals(p) for p in EVERY])) if not b]
    assert best == [(x, 20) for x in range(5, 10)] and [p for p, _ in found] == best
    again = optimise.nondominated(lambda s: {p: goals(p) for p in s}, RANGES, lambda p: True, population=24, generations=16, mutation=0.2)
    assert again == found
    with pytest.raises(ValueError):
        optimise.nondominated(score, RANGES, lambda p: False)


def test_a_model_finds_the_best_in_fewer_ratings():
    planted = lambda p: -(((p[0] - 22) / 10) ** 2) - ((p[1] - 7) / 10) ** 2 + 0.1 * np.cos(p[0])
    best = max((p for p in EVERY if p[0] + p[1] < 40), key=planted)
    for seed in range(4):
        rated = []

        def score(settings):
            rated.extend(settings)
            return {p: float(planted(p)) for p in settings}

        found = optimise.modelled(score, RANGES, lambda p: p[0] + p[1] < 40, first=8, rounds=40, batch=2, seed=seed)
        assert len(rated) == len(set(rated)) <= 88 and all(sum(p) < 40 for p in rated)
        assert found[-1][0] == best and [s for _, s in found] == sorted(s for _, s in found)


def test_the_model_goes_through_what_is_rated():
    at = [(0, 0), (10, 3), (20, 20), (30, 9)]
    model = optimise.Surrogate(at, [1.0, 5.0, 2.0, 2.5], RANGES)
    mean, deviation = model.at_settings([*at, (1, 29)])
    assert deviation[:4].max() < deviation[4]
    flat = optimise.Surrogate(at, [3.0] * 4, RANGES)
    assert np.allclose(flat.at_settings([(5, 5)])[0], 3.0)
    one = optimise.modelled(lambda s: {p: 1.0 for p in s}, [(0, 1)], lambda p: True, first=8, rounds=8)
    assert one == [((0,), 1.0)]


def test_few_candidates_of_wide_ranges():
    found = optimise.modelled(lambda s: {p: float(-abs(p[0] - 700)) for p in s}, [(0, 100_000)], lambda p: True, first=6, rounds=10, batch=2, candidates=500)
    assert found[-1][1] > found[0][1] or found[0][1] > -300
