"""Parameter search by density ratios (tree-structured Parzen estimators), with poor trials stopped early.

After some random trials each parameter is drawn from a density over the values of
the best tenth of the trials, and of a number of draws the one is tried whose
density there is largest against that over all other trials.
"""

import math
import random
import statistics
from collections.abc import Callable, Iterator

#: Random trials before the first density, draws for each trial, and the share of trials that count as good.
STARTUP, DRAWS, GOOD = 10, 24, 0.1


class Parameter:
    """A range of numbers ('int', 'float', or 'log' for a float by its logarithm) or a list of choices."""

    def __init__(self, kind: str, *values):
        self.kind, self.values = kind, values
        if kind != "choice":
            low, high = values
            self.low, self.high = (math.log(low), math.log(high)) if kind == "log" else (float(low), float(high))

    def draw(self, pick: random.Random):
        if self.kind == "choice":
            return pick.choice(self.values)
        return self._out(pick.uniform(self.low, self.high))

    def _out(self, x: float):
        x = min(max(x, self.low), self.high)
        return int(round(x)) if self.kind == "int" else math.exp(x) if self.kind == "log" else x

    def _in(self, v) -> float:
        return math.log(v) if self.kind == "log" else float(v)

    def _kernels(self, seen: list) -> list[tuple[float, float]]:
        """Centre and width of each value's kernel: as wide as the larger gap to its neighbours, within bounds that narrow with their number."""
        at = sorted(map(self._in, seen))
        whole = max(self.high - self.low, 1e-12)
        ends = [self.low, *at, self.high]
        return [(x, min(max(x - a, b - x, whole / min(100, 1 + len(at))), whole)) for a, x, b in zip(ends, at, ends[2:])]

    def near(self, seen: list, pick: random.Random):
        """A draw from the density over values seen, in which the whole range counts as one more."""
        at = pick.randrange(len(seen) + 1)
        if at == len(seen):
            return self.draw(pick)
        return seen[at] if self.kind == "choice" else self._out(pick.gauss(*self._kernels(seen)[at]))

    def density(self, value, seen: list) -> float:
        if self.kind == "choice":
            return (seen.count(value) + 1) / (len(seen) + len(self.values))
        x = self._in(value)
        kernels = sum(math.exp(-(((x - v) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi)) for v, s in self._kernels(seen))
        return (kernels + 1 / max(self.high - self.low, 1e-12)) / (len(seen) + 1)


def search(space: dict[str, Parameter], objective: Callable[[dict], Iterator[float]], trials: int, seed: int = 42) -> tuple[dict, float, list]:
    """(parameters, value, all trials) of the largest last value of objective.

    objective gives one value after another, each better known than the one before (the
    mean over more folds). A trial whose value is below the median of the trials so far
    at the same place is stopped there, and its value counts as it is.
    """
    pick, done, steps = random.Random(seed), [], []
    for number in range(trials):
        if number < STARTUP:
            params = {k: p.draw(pick) for k, p in space.items()}
        else:
            ranked = sorted(done, key=lambda t: -t[1])
            n = max(1, math.ceil(GOOD * len(ranked)))
            params = {}
            for k, p in space.items():
                good, rest = ([t[0][k] for t in part] for part in (ranked[:n], ranked[n:]))
                params[k] = max((p.near(good, pick) for _ in range(DRAWS)), key=lambda v: p.density(v, good) / p.density(v, rest))
        value, whole = float("-inf"), True
        for place, value in enumerate(objective(params)):
            if len(steps) <= place:
                steps.append([])
            earlier = list(steps[place])
            steps[place].append(value)
            if number >= STARTUP and earlier and value < statistics.median(earlier):
                whole = False
                break
        done.append((params, value, whole))
    best = max((t for t in done if t[2]), key=lambda t: t[1])
    return best[0], best[1], done
