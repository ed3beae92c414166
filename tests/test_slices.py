"""Series cut into slices: threshold bars against the fold, numbers, halos and carried values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ob
from barloom.operators import slices, thresholds

TRADES = "symbol string, id long, time long, price double, qty double, is_buyer_maker boolean"


def tape(spark, n, seed, values=None, symbols="ab"):
    rng, rows = random.Random(seed), []
    for s in symbols:
        time = 1_700_000_000_000
        for i in range(n):
            time += rng.choice([0, 1, 40, 400, 5000])
            rows.append((s, i, time, 100 + rng.randint(-50, 50) / 10, rng.choice(values) if values else rng.random(), rng.random() < 0.5))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TRADES).repartition(4)


def same(a, b):
    key = lambda r: (r.symbol, r.bar_idx)
    a, b = sorted(a.select(b.columns).collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == pytest.approx(q, rel=1e-12) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)
    return len(b)


@pytest.mark.parametrize("case", [
    {"threshold": 5.0, "values": [0.1, 0.2, 0.3, 0.5, 1.0]},  # many sums exactly at the threshold
    {"threshold": 3.0, "values": None},
    {"threshold": 0.3, "values": [0.1, 0.2, 0.0]},
    {"threshold": 7.0, "values": [0.0, 0.0, 0.01, 9.0, 30.0]},  # trades larger than a bar
    {"threshold": 1e9, "values": None},  # a bar that never closes
    {"threshold": 0.0, "values": [0.0, 1.0]},
])
def test_threshold_bars_of_the_fold(spark, case):
    t = tape(spark, 1500, 1, case["values"])
    want = ob.folded_bars(t, rule="threshold", value="volume", threshold=case["threshold"]).cache()
    n = same(ob.bars(t, "volume", threshold=case["threshold"], rows=60, bucket=10_000), want)
    assert n or case["threshold"] == 1e9
    same(ob.bars(t, "volume", threshold=case["threshold"]), want)


def test_dollar_bars_of_the_fold(spark):
    t = tape(spark, 3000, 2, [0.25, 0.5, 1.0], "abc")
    assert same(ob.bars(t, "dollar", threshold=500.0, rows=100, bucket=20_000), ob.folded_bars(t, rule="threshold", value="dollar", threshold=500.0)) > 100
    assert ob.bars(t.where("false"), "dollar").count() == 0


def test_threshold_bars_spread_one_symbol_over_tasks(spark):
    t = tape(spark, 4000, 3, None, "a")
    halo = thresholds._with_halo(t, "volume", 3.0, 100, 10_000)
    by = halo.groupBy("slice").agg(F.count_if("own").alias("own"), F.count("*").alias("all")).collect()
    assert len(by) > 25 and sum(r.own for r in by) == 4000
    assert max(r.own for r in by) < 400 and max(r.all - r.own for r in by) < 60


def test_next_openings_of_a_plain_loop():
    rng = random.Random(4)
    for _ in range(60):
        v = np.array([rng.choice([0.0, 0.1, 0.2, 0.3, 0.7, 1.1]) for _ in range(rng.randint(1, 40))])
        limit = rng.choice([0.0, 0.3, 0.6, 1.0, 1.2, 5.0])
        want = []
        for i in range(len(v)):
            total, at = 0.0, len(v) + 1
            for j in range(i, len(v)):
                total += v[j]
                if total >= limit:
                    at = j + 1
                    break
            want.append(at)
        assert thresholds.next_openings(v, limit).tolist() == want


def test_numbers_along_a_symbol(spark):
    t = tape(spark, 500, 5)
    got = {(r.symbol, r.id): r.number for r in slices.numbered(t, 5000).collect()}
    rows = sorted((r.symbol, r.time, r.id) for r in t.collect())
    want, at = {}, {}
    for s, _, i in rows:
        want[s, i] = at.get(s, 0)
        at[s] = want[s, i] + 1
    assert got == want


def test_last_known_value_across_slices(spark):
    rng, rows = random.Random(6), []
    for s in "ab":
        rows += [(s, i, rng.choice([None] * 9 + [float(i)])) for i in range(100)]
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, x double").repartition(3)
    got = {(r.symbol, r.bar_idx): r.y for r in slices.last_known(b, "y", F.col("x"), 7).collect()}
    want, now = {}, {}
    for s, i, x in rows:
        now[s] = x if x is not None else now.get(s)
        want[s, i] = now[s]
    assert got == want
