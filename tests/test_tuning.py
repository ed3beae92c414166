"""The density-ratio search on known surfaces."""

import math
import random

from barloom.operators import tuning

SPACE = {"a": tuning.Parameter("float", -5.0, 5.0), "b": tuning.Parameter("log", 1e-4, 1.0), "c": tuning.Parameter("int", 1, 50), "d": tuning.Parameter("choice", "x", "y", "z")}


def surface(p):
    return -((p["a"] - 1.5) ** 2) - (math.log10(p["b"]) + 2) ** 2 - ((p["c"] - 30) / 10) ** 2 - (p["d"] != "y")


def test_search_beats_as_many_random_trials():
    wins, found, plain = 0, [], []
    for seed in range(20):
        best, value, done = tuning.search(SPACE, lambda p: iter([surface(p)]), 60, seed)
        assert value == max(surface(t[0]) for t in done if t[2]) == surface(best) and len(done) == 60
        pick = random.Random(seed + 1000)
        by_chance = max(surface({k: q.draw(pick) for k, q in SPACE.items()}) for _ in range(60))
        wins += value > by_chance
        found.append(value)
        plain.append(by_chance)
    assert wins >= 16 and sum(found) > sum(plain)


def test_draws_stay_in_their_ranges_and_repeat_by_seed():
    pick = random.Random(1)
    for _ in range(300):
        near = {k: p.near([p.draw(pick) for _ in range(3)], pick) for k, p in SPACE.items()}
        assert -5 <= near["a"] <= 5 and 1e-4 <= near["b"] <= 1.0000001 and near["c"] in range(1, 51) and isinstance(near["c"], int) and near["d"] in "xyz"
    run = lambda: tuning.search(SPACE, lambda p: iter([surface(p)]), 15, 3)[0]
    assert run() == run()


def test_poor_trials_stop_early():
    asked = []

    def folds(p):
        for k in range(5):
            asked.append(k)
            yield surface(p) + k * 1e-9

    best, value, done = tuning.search(SPACE, folds, 50, 2)
    stopped = [t for t in done if not t[2]]
    assert 10 < len(stopped) < 42 and len(asked) < 5 * 50 - 3 * len(stopped)
    assert max(t[1] for t in stopped) <= value and all(t[2] for t in done[: tuning.STARTUP])
